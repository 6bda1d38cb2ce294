"""Column functions on the structured data of pages: a depth-capped walk of parsed JSON within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions.text import bound

MOST_DEPTH = 10


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    plain = lambda told: F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string")
    return bound(F.schema_of_variant(value), lambda told: plain(told).when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").otherwise("number"))


def node(block: Column, path: Column, key: Column, value: Column, is_open: bool | Column) -> Column:
    is_open = is_open if isinstance(is_open, Column) else F.lit(is_open)
    return F.struct(block.alias("block"), path.alias("path"), key.alias("key"), kind(value).alias("kind"), value.alias("v"), is_open.alias("open"))


def children(x: Column) -> Column:
    """An object's values by key, an array's by place; none of anything else."""
    none = F.lit(None).cast("string")
    entries = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))
    items = F.try_variant_get(x["v"], "$", "array<variant>")
    of_object = F.transform(entries, lambda e: node(x["block"], F.concat(x["path"], F.lit("."), e["key"]), e["key"], e["value"], True))
    of_array = F.transform(items, lambda e, i: node(x["block"], F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), none, e, True))
    return F.coalesce(F.when(x["kind"] == "object", of_object).when(x["kind"] == "array", of_array), F.slice(F.array(x), 1, 0))


def json_nodes(html: Column, depth: int = MOST_DEPTH) -> Column:
    """All nodes of the page's JSON-LD blocks, each before those within it, in order of blocks, keys and places: block (from 0), path (from
    $), key (of an object's value, else null), kind, v (the value as a variant), open. Blocks that can't be parsed have none; what lies
    deeper than the cap stays within its node, which is then still open.

    Each step puts the children of the nodes found last behind them; nodes known before stay, so the expression grows with the depth only."""
    blocks = F.transform(H.every(html, H.JSON_LD, 1), lambda b, i: F.struct(i.cast("long").alias("i"), F.try_parse_json(b).alias("v")))
    nodes = F.transform(F.filter(blocks, lambda b: b["v"].isNotNull()), lambda b: node(b["i"], F.lit("$"), F.lit(None).cast("string"), b["v"], True))
    closed = lambda x: F.struct(*[x[c].alias(c) for c in ("block", "path", "key", "kind", "v")], F.lit(False).alias("open"))
    for _ in range(depth):
        nodes = F.flatten(F.transform(nodes, lambda x: F.when(x["open"], F.concat(F.array(closed(x)), children(x))).otherwise(F.array(x))))
    return nodes


def text_of(value: Column) -> Column:
    """A string or number as text, anything else as JSON; null of null."""
    return value.cast("string")


def strings_of_objects(html: Column) -> Column:
    """The strings that are values of objects, at whatever depth; strings within arrays are not."""
    held = F.filter(json_nodes(html), lambda x: (x["kind"] == "string") & x["key"].isNotNull())
    return F.transform(held, lambda x: text_of(x["v"]))

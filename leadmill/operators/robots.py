"""Robots rules: a first-match prefix join of page addresses with their sites' rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import extract


def unquoted(path: Column) -> Column:
    """Percent escapes resolved (left as they are where one is malformed), without the mark of an empty query."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), r"\?$", "")


def own_rules(rules: DataFrame, agent: str) -> DataFrame:
    """origin, seq, allow, prefix: of each origin the first group of rules(origin, agent, seq, allow, path_prefix) whose agent is part of ours,
    without one that of '*'. An empty prefix fits all paths and forbids nothing; '*' within a prefix is a sign like others."""
    name = agent.split("/")[0].lower()
    common = F.col("agent") == "*"
    fits = rules.where(common | ((F.col("agent") != "") & F.contains(F.lit(name), F.lower("agent"))))
    first = fits.groupBy("origin").agg(F.min(F.struct(common.alias("common"), "seq", "agent")).alias("g")).select("origin", "g.agent")
    mine = fits.join(first.hint("merge"), ["origin", "agent"])
    prefix = F.coalesce("path_prefix", F.lit(""))
    return mine.select("origin", "seq", (F.col("allow") | (prefix == "")).alias("allow"), unquoted(prefix).alias("prefix"))


def allowed(pages: DataFrame, rules: DataFrame, agent: str = "*", ignore: bool = False, deals: int = 16) -> DataFrame:
    """Whether each page may be fetched: by its origin's first rule for the agent (least seq; of equal ones the longest prefix, then the
    allowing one) whose prefix its path and query have; without one, or where rules are ignored, it may. One row a distinct (page_id, url).

    A path is joined by equality with rules on (origin, its prefix of each length that rules use), and the first match is one minimum a
    page. Each rule is copied to so many deals and each page has one, so a hot origin's pages spread over that many tasks."""
    origin, path = extract(F.col("url"), r"^(https?://[^/?#]+)"), F.coalesce(extract(F.col("url"), r"^https?://[^/?#]+([^#]*)"), F.lit("/"))
    if ignore:
        return pages.select("page_id", "url").distinct().select("page_id", F.lit(True).alias("allowed"))
    mine = own_rules(rules, agent)
    lengths = sorted({0, *(r[0] for r in mine.select(F.char_length("prefix")).distinct().collect())})  # at most as many as an address is long
    own = pages.select("page_id", "url", origin.alias("origin"), unquoted(path).alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(deals)).alias("deal"))
    usable = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length("path"))
    starts = own.withColumn("n", F.explode(usable)).select("page_id", "url", "origin", "deal", F.substring("path", F.lit(1), F.col("n")).alias("prefix"))
    copied = mine.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    met = starts.hint("merge").join(copied.select("origin", "deal", "prefix", "seq", "allow"), ["origin", "deal", "prefix"], "left")
    order = F.when(F.col("seq").isNotNull(), F.struct("seq", -F.char_length("prefix"), ~F.col("allow")))
    return met.groupBy("page_id", "url").agg(F.min(order).alias("first")).select("page_id", F.coalesce(~F.col("first.col3"), F.lit(True)).alias("allowed"))

"""The walk of structured data against one in plain Python, over random and odd JSON."""

import json
import random

from pyspark.sql import functions as F

from leadmill.functions.structured import json_nodes, strings_of_objects
from leadmill.operators import industry, profiles


def drawn(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice(["@type", "name", "email", "a b", "é", "x.y"]) + str(i): drawn(rng, depth - 1) for i in range(rng.randrange(4))}
    if depth and kind < 0.6:
        return [drawn(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(['say "no"\n', "漢字", "", "a\\b", 1, -2.5, 10**12, True, False, None])


def walk(value, block, path="$", key=None):
    if isinstance(value, dict):
        for k in sorted(value, key=lambda k: k.encode()):
            yield from walk(value[k], block, f"{path}.{k}", k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, block, f"{path}[{i}]")
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
        yield block, path, key, kind, None if value is None else json.dumps(value) if kind in ("boolean", "number") else value


def tag(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_random_json(spark):
    rng = random.Random(9)
    pages = [[drawn(rng, 5) for _ in range(rng.randrange(4))] for _ in range(60)]
    rows = [(i, "".join(tag(json.dumps(v, ensure_ascii=i % 2 == 0)) for v in values)) for i, values in enumerate(pages)]
    got = {}
    for r in profiles.json_tree(spark.createDataFrame(rows, "page_id long, html string")).collect():
        got.setdefault(r.page_id, []).append((r.block, r.path, r.key, r.kind, r.value))
    for i, values in enumerate(pages):
        assert got.get(i, []) == [x for b, v in enumerate(values) for x in walk(v, b)]


def test_odd_and_deep_json(spark):
    deep = "[" * 12 + '"x"' + "]" * 12
    rows = [(1, None), (2, ""), (3, tag("{bad")), (4, tag(deep)), (5, tag('{"a":"b"}') * 2), (6, tag("{}") + tag("[]") + tag("7"))]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    got = [tuple(r) for r in profiles.json_tree(frame).orderBy("page_id", "block").collect()]
    assert got == [(4, 0, "$" + "[0]" * 10, None, "array", '[["x"]]'), (5, 0, "$.a", "a", "string", "b"), (5, 1, "$.a", "a", "string", "b"), (6, 2, "$", None, "number", "7")]
    whole = frame.where("page_id = 4").select(F.size(json_nodes(F.col("html"), 13))).first()[0]
    assert whole == 13 and [r[0] for r in frame.orderBy("page_id").select(strings_of_objects(F.col("html"))).collect()] == [None, [], [], [], ["b", "b"], []]


def test_industry_of_the_first_object_that_tells_one(spark):
    data = [({"@type": "School", "b": {"industry": "銀行"}}, "education"), ({"sector": "銀行", "businessType": "病院"}, "finance"), ({"@graph": [{"@type": ["School"]}, {"@type": "学校"}]}, "education"), ({"@type": "Organization", "z": 5}, None)]
    rows = spark.createDataFrame([(i, tag(json.dumps(d))) for i, (d, _) in enumerate(data)], "page_id long, html string")
    assert [r[0] for r in rows.orderBy("page_id").select(industry.structured_industry(F.col("html"))).collect()] == [w for _, w in data]

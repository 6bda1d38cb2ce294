"""Near duplicates: no pass over the sketch for a document, no round over edges that are stars."""

import random

import numpy as np

from leadmill.llm import components, jaccard_join


class Sketch(np.ndarray):
    def mean(self, *args, **more):
        raise AssertionError("the whole sketch is read for one document")


def test_prefix_reads_no_whole_sketch():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 9, jaccard_join.SKETCH).astype(np.float32)
    for n in (1, 2, 40, 700):
        found = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        prefix, matches = jaccard_join.prefix_of(found, sketch.view(Sketch), sketch.mean(), 85)
        load = sketch[(found >> np.uint64(44)).astype(np.int64)]
        order = np.lexsort((found, load))
        assert prefix.tolist() == found[order][: len(prefix)].tolist() and len(prefix) == n - -(-85 * n // 100) + matches


def test_stars_take_no_round(spark, monkeypatch):
    """Before, edges that name their components already took a whole round to see it."""
    written = []
    staged = components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or staged(df, name))
    edges = spark.range(1, 40).selectExpr("id as a", "id % 3 * 0 as b").where("a < 20").unionByName(spark.range(50, 60).selectExpr("id as a", "49L as b"))
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**dict.fromkeys(range(20), 0), **dict.fromkeys(range(49, 60), 49)} and written == ["edges"]


def test_rounds_pass_no_nodes_through_the_driver(spark, monkeypatch):
    """Before, each round's joins had no strategy, so Spark sent tables of nodes to the driver and on to all executors."""
    staged, plans = components.staged, []

    def watched(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(components, "staged", watched)
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(900, k) for k in range(700, 740)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(400):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
    rounds = [p for p in plans if "Join" in p]
    assert rounds and all(p.count("Join ") == p.count("strategy=shuffle_hash") for p in rounds)

"""Connected components by alternating stars, as joins and aggregates over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm._shared import staged


def are_stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges(a, b), a > b, either has one edge to a smaller node or none: such edges name the components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not held.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a, b): component is the smallest node reachable.

    Each round points every node's larger neighbours to the smallest one, then every node's smaller ones; the rounds needed
    grow with the logarithm of the longest path, and edges that are stars already need none. The edges of a round are a staged
    table, so a lost executor costs little. The joins name their strategy: Spark would broadcast the small ones, and tables of nodes
    then pass through the driver, round after round. Repeated edges, loops and edges with a null end change nothing; without edges there
    are no rows.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not are_stars(edges):
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max(F.col("b") > F.col("a")).alias("has_larger"))
        large = edges.join(near.select(F.col("a").alias("b"), "m").hint("shuffle_hash"), "b").select("a", F.col("m").alias("b"))
        kept = near.where("has_larger and m < a").select("a", F.col("m").alias("b"))  # a hub stays tied to its own least
        large = large.unionByName(kept).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("shuffle_hash"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = staged(small.distinct(), "edges")
    # of stars, each larger end has one edge and no smaller end has any
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

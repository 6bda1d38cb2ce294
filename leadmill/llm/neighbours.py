"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to a few dimensions by Gaussian (2-stable) directions: a neighbour at distance r lies at a projected distance
whose square is r^2 times a chi-square variable. A kd-tree over the projections deals the rows into cells, which large cells (as of
equal vectors) divide into blocks of bounded size. Each query first searches a block of its own cell, which bounds the distance of
its k-th neighbour; then the blocks of all cells whose box is near enough. Within a block the rows stand in the leaves of a kd-tree
of its own: leaves are taken by projected distance, their rows verified by the distance on the original vectors, and the search
ends when the next projected distance p fails the test P(chi2 <= p^2 / r_k^2) < confidence, r_k being the k-th distance so far. So
each true neighbour is met with at least that probability, and found distances are exact.

The tree's planes are fitted on a bounded sample (sample_rows); every row is indexed. The driver holds the planes, the sample and one
box a cell, at most 2^MOST_LEVELS. Queries meet a cell in blocks of block_queries. Vectors that are null, zero, empty, hold
null or non-finite components or have another length than the commonest (ties: the longest) take no part. Repeated rows are rows
of their own, told apart by place; ties go to the smaller id, null ids last. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm._shared import numbered, staged
from leadmill.llm.vectors import block, finite, lists, of_one_length

MOST_LEVELS = 9
LEAF = 64


def chi_square_quantile(share: float, dims: int) -> float:
    """x with P(chi-square of dims <= x) = share, by bisection on the series of the incomplete gamma function."""

    def below(x: float) -> float:
        term = total = 1 / (a := dims / 2)
        while term > 1e-16 * total:
            term *= x / 2 / (a := a + 1)
            total += term
        return total * math.exp(dims / 2 * math.log(x / 2) - x / 2 - math.lgamma(dims / 2)) if x else 0.0

    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


class Tree:
    """Planes of a kd-tree over projected rows: node i splits at value[i] on dimension axis[i] into 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.axis, self.value = np.zeros((1 << levels) - 1, int), np.full((1 << levels) - 1, np.inf)
        parts = {0: sample}
        for node in range(len(self.axis)):
            own = parts.pop(node, sample[:0])
            if len(own):
                self.axis[node] = axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.value[node] = np.median(own[:, axis])
                right = own[:, axis] > self.value[node]
                parts |= {2 * node + 1: own[~right], 2 * node + 2: own[right]}

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), int)
        for _ in range(self.levels):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.value[node])
        return node - len(self.axis)


def leaves(p: np.ndarray) -> list[np.ndarray]:
    """Row numbers by leaf: halves by the widest dimension until at most LEAF rows are left."""
    out, open_ = [], [np.arange(len(p))]
    while open_:
        own = open_.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(p[own], axis=0)))
        order = own[np.argpartition(p[own, axis], len(own) // 2)]
        open_ += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


class Block:
    """Rows of one block behind a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, p: np.ndarray) -> None:
        parts = leaves(p)
        order = np.concatenate(parts)
        self.ids, self.rows, self.v, self.p = ids[order], rows[order], v[order], p[order]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.low, self.high = np.minimum.reduceat(self.p, self.starts[:-1]), np.maximum.reduceat(self.p, self.starts[:-1])

    def search(self, row: int, v: np.ndarray, p: np.ndarray, bound: float, k: int, quantile: float) -> tuple[list, list[int], list[float]]:
        """Ids, rows and distances of the k nearest rows at most bound away. The bound shrinks to the k-th distance met."""
        box = np.sqrt((np.maximum(np.maximum(self.low - p, p - self.high), 0) ** 2).sum(axis=1))
        order = np.argsort(box, kind="stable")
        slack = 1e-9 * (1 + float(np.abs(p).max()))  # equal vectors may differ by rounding here
        best_d, best_i, best_id, done, take = np.empty(0), np.empty(0, int), np.empty(0), 0, 1
        while done < len(order):
            reach = bound * math.sqrt(quantile) + slack
            if box[order[done]] > reach:  # the stopping test, for all rows that are left
                break
            own = np.concatenate([np.arange(self.starts[j], self.starts[j + 1]) for j in order[done : done + take]])
            done, take = done + take, 2 * take
            own = own[((self.p[own] - p) ** 2).sum(axis=1) <= reach * reach]
            own = own[self.rows[own] != row]
            d = np.concatenate([best_d, np.sqrt(((self.v[own] - v) ** 2).sum(axis=1))])
            i, ids = np.concatenate([best_i, own]), np.concatenate([best_id, self.ids[own]])
            first = np.lexsort((ids, d))[:k]
            best_d, best_i, best_id = d[first], i[first], ids[first]
            if len(best_d) == k:
                bound = min(bound, float(best_d[-1]))
        near = best_d <= bound
        return best_id[near].tolist(), self.rows[best_i[near]].tolist(), best_d[near].tolist()


def nearest(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            dims: int = 8, confidence: float = 0.97, block_rows: int = 16_384,
            block_queries: int = 1_024, sample_rows: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), the neighbour's key, score (its Euclidean distance) of the k nearest rows found for each row where is_query
    holds, the query's own row apart."""
    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    own = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), asked)
    own, d = of_one_length(own.where(finite(F.col("v")) & F.exists("v", lambda c: c != 0)), "v")
    spark = df.sparkSession
    if not d:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    n, quantile = own.count(), chi_square_quantile(confidence, dims)
    directions = np.random.default_rng(2).standard_normal((d, dims))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), lists(block(b, "v", d) @ directions)], ["h", "p"])

    drawn = own.select(F.xxhash64("v").alias("h"), "v").mapInArrow(projected, "h long, p array<double>").orderBy("h").limit(sample_rows)
    tree = Tree(np.array([r["p"] for r in drawn.collect()]), min(MOST_LEVELS, max(0, math.ceil(math.log2(n / block_rows)))))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = block(b, "v", d) @ directions
            yield pa.RecordBatch.from_arrays([*b.columns, lists(p), pa.array(tree.cells(p).astype(np.int32))], [*b.schema.names, "p", "cell"])

    rows = staged(numbered(own).mapInArrow(project, "key long, v array<double>, asked boolean, row_id long, p array<double>, cell int"), "neighbours")
    boxes = rows.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("p")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(dims)]).collect()
    boxes.sort(key=lambda r: r["cell"])
    cells = np.array([r["cell"] for r in boxes])
    low, high = (np.array([[r[f"{name}{j}"] for j in range(dims)] for r in boxes]) for name in ("low", "high"))
    n_blocks = {r["cell"]: max(1, math.ceil(r["n"] / block_rows)) for r in boxes}
    queries = rows.where("asked").select(*[F.col(c).alias(c) for c in ("row_id", "key", "v", "p", "cell")])  # columns of their own

    def found(visits: DataFrame, first_only: bool) -> DataFrame:
        """What the queries meet in the cells they visit (row_id, key, v, p, cell, bound), in blocks of rows by blocks of queries."""
        at = {r[0]: max(1, math.ceil(r[1] / block_queries)) for r in visits.groupBy("cell").count().collect()}  # one number a cell
        plan = spark.createDataFrame([(c, 1 if first_only else n_blocks[c], at[c], n_blocks[c]) for c in sorted(at)], "cell int, visited int, parts int, n_blocks int")
        deal = lambda m: F.pmod(F.xxhash64("row_id"), m).cast("int")
        fixed = F.broadcast(plan)  # at most 2^MOST_LEVELS rows
        left = rows.join(fixed, "cell").withColumn("part", deal(F.col("n_blocks"))).where("part < visited").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = visits.join(fixed, "cell").withColumn("q", deal(F.col("parts"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("visited") - 1)))

        def search(its: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(its) and len(asked):
                ids = its["key"].astype("float64").fillna(np.inf).to_numpy() if its["key"].isna().any() else its["key"].to_numpy()
                tied = Block(ids, its["row_id"].to_numpy(), np.stack(its["v"].to_numpy()), np.stack(its["p"].to_numpy()))
                for row, name, v, p, bound in asked[["row_id", "key", "v", "p", "bound"]].itertuples(index=False):
                    ids_, rows_, far = tied.search(row, np.asarray(v), np.asarray(p), bound, k, quantile)
                    out += [(row, name, None if i == np.inf else int(i), r, x) for i, r, x in zip(ids_, rows_, far, strict=True)]
            return pd.DataFrame(out, columns=["row_id", "query_id", "id", "near", "score"]).astype({"id": "Int64", "query_id": "Int64"})

        by = ["cell", "part", "q"]
        pairs = left.select("row_id", "key", "v", "p", *by).groupBy(*by).cogroup(right.select("row_id", "key", "v", "p", "bound", *by).groupBy(*by))
        return pairs.applyInPandas(search, "row_id long, query_id long, id long, near long, score double")

    home = staged(found(queries.withColumn("bound", F.lit(math.inf)), True), "neighbours-home")
    bounds = staged(home.groupBy("row_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(math.inf).alias("bound")), "neighbours-bounds")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, reach = block(b, "p", dims), b.column("bound").to_numpy() * math.sqrt(quantile)
            away = np.sqrt(sum(np.maximum(np.maximum(low[:, j] - p[:, j, None], p[:, j, None] - high[:, j]), 0) ** 2 for j in range(dims)))
            q, c = np.nonzero(away <= (reach + 1e-9 * (1 + np.abs(p).max(axis=1)))[:, None])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(q)).columns, pa.array(cells[c].astype(np.int32))], [*b.schema.names, "cell"])

    bounded = queries.select("row_id", "key", "v", "p").join(bounds.hint("merge"), "row_id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
    visits = staged(bounded.mapInArrow(visit, "row_id long, key long, v array<double>, p array<double>, bound double, cell int"), "neighbours-visits")
    order = Window.partitionBy("row_id").orderBy("score", F.col("id").asc_nulls_last())
    # what the first block gave stays: with its bound the test may now reject some of it
    every = found(visits, False).unionByName(home).dropDuplicates(["row_id", "near"])
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")

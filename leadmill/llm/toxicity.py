"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms (lower-cased words, their beginnings with how often these come, its size), each hashed to one of 2**bits buckets. Its
log-odds are

    b + sum_i w_i + 1/2 sum_f ((sum_i v_if)**2 - sum_i v_if**2)

over its buckets i: beside a weight of its own, each pair of terms has the product of two learned vectors, so that two terms
can mean together what neither means alone. Buckets are screened by a chi-squared test against the label first.

Training is a bounded fit: at most ``sample_docs`` labelled documents, those with the smallest hash of doc_id. Scoring reads
every text whole; nothing is shuffled. Null and empty texts score as a text without terms. Without labelled rows the score is
0. Repeated rows are scored alike; of rows that share a labelled doc_id the one with the least buckets is learned from, as toxic if
any label of it says so. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm._shared import blocks

TERM = re.compile(r"\w+")
#: Lengths of the word beginnings that are terms too, how many distinct words with one beginning are told apart, and how
#: many sizes of documents are.
STEMS, MOST, SIZES = (5, 7), 4, 24


def hashed(term: str, bits: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def size_terms(bits: int) -> list[int]:
    """The buckets of the terms for a document's size."""
    return [hashed(f"size {k}", bits) for k in range(SIZES)]


def buckets(text: str | None, bits: int) -> np.ndarray:
    """The distinct buckets of a text's terms: its words, the beginnings of longer words (``stem k``: in k distinct words at
    least), and the size of its vocabulary as a power of two."""
    words: set[str] = set()
    for b in blocks(text or ""):
        words.update(TERM.findall(b.lower()))
    terms = list(words)
    for n in STEMS:
        stems = Counter([w[:n] for w in words if len(w) > n])
        terms += [f"{s} {k}" for s, c in stems.items() for k in range(1, min(c, MOST) + 1)]
    terms.append(f"size {min(SIZES - 1, len(words).bit_length())}")
    mask = (1 << bits) - 1
    return np.unique(np.fromiter(map(zlib.crc32, [t.encode("utf-8", "surrogatepass") for t in terms]), dtype=np.int64, count=len(terms)) & mask)


@dataclass
class Model:
    bits: int
    bias: float = -30.0
    #: Bucket of each kept feature (sorted), its weight and its vector.
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vector: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def features(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.kept, found)  # both are sorted, so what lies beyond the end comes last
        at = at[at < len(self.kept)]
        return at[self.kept[at] == found[: len(at)]]

    def score(self, text: str | None) -> float:
        i = self.features(buckets(text, self.bits))
        v = self.vector[i]
        z = self.bias + self.weight[i].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int, factors: int = 6, epochs: int = 40, rate: float = 0.3, decay: float = 3e-4, least_df: int = 3, least_chi2: float = 12.0, seed: int = 7) -> Model:
    """Fit by AdaGrad on batches of the log loss. rows: buckets of each document."""
    n, pos = len(rows), int(labels.sum())
    if not 0 < pos < n:
        return Model(bits, bias=-30.0 if not pos else 30.0)
    df, with_label = np.zeros(1 << bits), np.zeros(1 << bits)
    for r, label in zip(rows, labels, strict=True):
        df[r] += 1
        with_label[r] += label
    present = np.flatnonzero(df)
    df, with_label = df[present], with_label[present]
    expected = df * pos / n
    chi2 = (with_label - expected) ** 2 / expected + (with_label - expected) ** 2 / np.maximum(df - expected, 1e-9)
    kept = present[(df >= least_df) & ((chi2 >= least_chi2) | np.isin(present, size_terms(bits)))]
    m = len(kept)
    number = np.full(1 << bits, -1, dtype=np.int32)
    number[kept] = np.arange(m)
    rows = [f[f >= 0] for f in (number[r] for r in rows)]
    feature, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(f) for f in rows])])
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(m), rng.normal(0, 0.02, (m, factors)), float(np.log(pos / (n - pos)))
    gw, gv, gb = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for batch in np.array_split(order, max(1, n // 256)):
            lengths = starts[batch + 1] - starts[batch]
            f = np.concatenate([feature[starts[k] : starts[k + 1]] for k in batch])
            r = np.repeat(np.arange(len(batch)), lengths)
            vf = v[f]
            total = np.stack([np.bincount(r, weights=vf[:, k], minlength=len(batch)) for k in range(factors)], axis=1)
            square = np.bincount(r, weights=(vf**2).sum(axis=1), minlength=len(batch))
            z = b + np.bincount(r, weights=w[f], minlength=len(batch)) + 0.5 * ((total**2).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch) * 16
            dw = np.bincount(f, weights=g[r], minlength=m) + decay * w
            each = g[r][:, None] * (total[r] - vf)
            dv = np.stack([np.bincount(f, weights=each[:, k], minlength=m) for k in range(factors)], axis=1) + decay * v
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.3 * rate * dv / np.sqrt(gv)
            b -= rate * g.sum() / gb**0.5
    return Model(bits, b, kept, w, v)


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, sample_docs: int = 12_000) -> Model:
    """Fit on docs(doc_id, text) with labels(doc_id, toxic). The driver holds the sample's buckets, never texts."""
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "buckets": [buckets(t, bits).astype("<i4").tobytes() for t in pdf["text"]]})

    # at most sample_docs rows of two numbers are broadcast
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int"), "text")
    one = rows.mapInPandas(run, "doc_id long, toxic int, buckets binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("buckets").alias("buckets"))
    # in parts, so that the driver's JVM never holds the whole sample
    parts = one.select(F.xxhash64("doc_id").alias("order"), "doc_id", "toxic", "buckets").repartition(16, "doc_id").toLocalIterator()
    got = sorted((r["order"], r["doc_id"], r["toxic"], bytes(r["buckets"])) for r in parts)
    return fit([np.frombuffer(b, dtype="<i4") for *_, b in got], np.array([t > 0 for _, _, t, _ in got], dtype=float), bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: more likely toxic) of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [model.score(t) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")


def flagged(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """docs with the score of each text in one more column; all other columns pass through."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, of("text"))

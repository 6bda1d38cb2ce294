"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1-, 2- and 3-grams of letters (words are padded by a blank, n-grams never hold a blank
inside). A document's distance to a language is the sum, over its own most frequent n-grams, of how far each is out of place
in the language's profile; an n-gram that the profile lacks costs the profile's length. The language with the least distance
wins, ties by name.

Training counts n-grams in Spark over a sample of labelled rows of about ``sample_docs`` documents (chosen by a hash of
doc_id); prediction reads every text whole, in blocks. Null texts and texts without a letter: ``und`` with score 0. Without
labelled rows every text is ``und``. Repeated rows are predicted alike. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm._shared import blocks

BITS = 21
BLANK = np.uint64(0)


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for anything but a letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, in no order."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]  # one blank between words
    letter = codes != BLANK
    codes += np.uint64(1)  # so that a blank differs from no character
    pairs = (codes[:-1] << np.uint64(BITS)) | codes[1:]
    triples = (codes[:-2] << np.uint64(2 * BITS)) | pairs[1:]
    return np.concatenate((codes[letter], pairs[letter[:-1] | letter[1:]], triples[letter[1:-1]]))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts; a long text is counted block by block."""
    parts = [np.unique(grams(b), return_counts=True) for b in blocks(text)]
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


def train(labelled: DataFrame, size: int = 400, sample_docs: int = 40_000) -> dict[str, list[int]]:
    """Profiles by language from labelled(doc_id, text, lang)."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = max(1, labelled.count())
    part = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1, sample_docs / n))) if n > sample_docs else labelled

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                keys, counts = counted(" ".join(texts))
                yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": counts})

    sums = part.select("lang", "text").mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = sums.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect()  # size rows a language
    out: dict[str, list[int]] = {}
    for r in best:
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.keys = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64).astype(np.uint64))
        self.rank = np.full((len(self.names), len(self.keys) + 1), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            own = np.array(profiles[name], dtype=np.int64).astype(np.uint64)
            self.rank[i, np.searchsorted(self.keys, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return "und", 0.0
        best = top(*counted(text), self.size)
        if not len(best):
            return "und", 0.0
        at = np.searchsorted(self.keys, best)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != best)] = len(self.keys)
        rank = self.rank[:, at]
        distance = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(best)))).sum(axis=1)
        k = int(distance.argmin())
        return self.names[k], float(1 - distance[k] / (self.size * len(best)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = 400) -> DataFrame:
    """doc_id, lang_pred, score (1: every n-gram in place, 0: none known) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Classifier(profiles, size)
        for pdf in batches:
            found = [model.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")

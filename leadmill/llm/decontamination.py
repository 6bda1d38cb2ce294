"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised to lower-case letters and digits with one blank between words. A text holds an item where some segment of
``segment`` characters of the item (the whole item, if it is shorter) matches with at most k edits. Then the two share at least
(m - q + 1) - k * q of the segment's q-grams, all on diagonals (text position minus item position) within k of each other. So
shared q-grams are sorted into overlapping bands of diagonals, and in each band a window slides over their item positions:
where as many as the bound asks for begin within one segment, every segment that holds them is verified. One passes when it
equals the text; where no segment of an item does, by an alignment limited to the band.

So an excerpt of ``segment`` normalised characters with at most k edits is surely caught, wherever it begins. Items under q normalised
characters can't be told from chance inside a text; they match only texts that hold nothing else.

The index of a block of items (about ``block_chars`` characters, or one longer item; a fixed bound) goes to every task; a larger
benchmark takes more passes over the texts, one a block. Nothing is shuffled. Texts are read whole, in blocks that overlap.
Null and empty texts match nothing, null and empty items are matched by nothing. Items without item_id count too; their item_id stays null. Repeated rows
of either table give repeated results (items with one id are one item). Other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def characters() -> np.ndarray:
    """For each code point its lower-case letter or digit, 0 for anything else."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normalised(text: str, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0: a blank) and the position of each in the text; inside: what precedes the text ends in a word."""
    if text.isascii():
        codes = characters()[:128][np.frombuffer(text.encode("ascii"), dtype=np.uint8)]
    else:
        codes = characters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    keep = codes != 0
    keep[1:] |= keep[:-1]
    if inside and len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return codes[at], at


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram: hashes of powers of two, doubled up and joined."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        width, power = 1, BASE
        part = codes.astype(np.uint64) + np.uint64(1)
        out, done, rest = None, 0, q
        while rest:
            if rest & 1:
                own = part[done : done + n]
                out = own.copy() if out is None else out * power + own
                done += width
            rest >>= 1
            if rest:
                part = part[:-width] * power + part[width:]
                width, power = 2 * width, power * power
        out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(33))


def aligned(own: np.ndarray, begin: np.ndarray, codes: np.ndarray, low: np.ndarray, m: int, k: int, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each segment own[begin : begin + m] the least number of edits to a stretch of codes (k + 1: more than k) and the end of the first such
    one. Banded: the stretch begins at one of the 2k + 2 diagonals (text position minus item position) from low on, and the alignment
    stays within k of them. All segments are aligned together, a letter a step."""
    starts, far = 2 * k + 2, k + 1
    width = starts + 2 * k
    cell = np.arange(width)
    edits, ends = np.full(len(begin), far), np.zeros(len(begin), dtype=np.int64)
    for a in range(0, len(begin), rows):
        first = begin[a : a + rows]
        origin = (first + low[a : a + rows] - k)[:, None] + cell  # text position of each cell before the first letter
        row = np.where((cell >= k) & (cell < k + starts) & (origin >= 0) & (origin <= len(codes)), 0, far)
        for i in range(1, m + 1):
            at = origin + i
            out = (at < 0) | (at > len(codes))
            new = row + (codes[np.clip(at - 1, 0, len(codes) - 1)] != own[first + i - 1][:, None]) + ((at < 1) | out) * far
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a letter of the segment alone
            new[out] = far
            row = np.minimum(np.minimum.accumulate(new - cell, axis=1) + cell, far)  # letters of the text alone
            row[out] = far
        edits[a : a + rows], ends[a : a + rows] = row.min(axis=1), (origin + m)[np.arange(len(first)), row.argmin(axis=1)]
    return edits, ends


class Index:
    """The q-grams of a block of items, one entry a position."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, segment: int, edit_rate: float):
        self.q, self.codes, self.ids = q, [], []
        #: Short items by their codes.
        self.short: dict[bytes, list[int]] = {}
        least = min([0, *(i for i, _ in items if i is not None)])
        #: Numbers that stand for items without an id.
        self.nameless: set[int] = set()
        for n, (item, text) in enumerate(items):
            if item is None:
                item = least - 1 - n
                self.nameless.add(item)
            codes = np.trim_zeros(normalised(text or "")[0])
            if 0 < len(codes) < q:
                self.short.setdefault(codes.tobytes(), []).append(item)
            elif len(codes):
                self.codes.append(codes)
                self.ids.append(item)
        grams = [qgrams(c, q) for c in self.codes]
        keys = np.concatenate([np.zeros(0, dtype=np.uint64), *grams])
        number = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, dtype=np.int32), *(np.arange(len(g), dtype=np.int32) for g in grams)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.number, self.place = keys[order], number[order], place[order]
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self.keys >> np.uint64(42)] = True
        self.length = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.m = np.minimum(segment, self.length)
        self.k = np.minimum((edit_rate * self.m).astype(np.int64), (self.m - q) // q)
        self.bound = self.m - q + 1 - self.k * q
        self.longest = max((len(c) for c in self.codes), default=0)
        self.reach = int((self.m + 2 * self.k).max(initial=0)) + q

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in the codes, items and positions there of shared q-grams, of items with enough of them."""
        grams = qgrams(codes, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(42)])
        low = np.searchsorted(self.keys, grams[at], "left")
        known = low < len(self.keys)
        known[known] = self.keys[low[known]] == grams[at[known]]
        at, low = at[known], low[known]
        n = np.searchsorted(self.keys, grams[at], "right") - low
        which = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else low
        at, number, place = np.repeat(at, n), self.number[which], self.place[which].astype(np.int64)
        _, which, shared = np.unique(number, return_inverse=True, return_counts=True)
        enough = shared[which] >= self.bound[number]
        return at[enough], number[enough].astype(np.int64), place[enough]

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, segments' item positions, least diagonals): by item, every segment that shares as many q-grams as the bound asks for within a
        band, with that band's least diagonal. They are all those that can match."""
        at, number, place = self.hits(codes)
        if not len(at):
            return
        found = []
        width = 2 * (2 * self.k[number] + 1)
        for shift in (0, 1):  # bands overlap by half: any 2k + 1 diagonals lie within one
            band = (at - place + shift * (width // 2) + width * (1 + self.longest // width)) // width
            order = np.lexsort((at, place, band, number))
            n, b, p, w = number[order], band[order], place[order], width[order]
            once = np.ones(len(order), dtype=bool)
            once[1:] = (n[1:] != n[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])
            n, b, p, w = n[once], b[once], p[once], w[once]
            last = np.arange(len(n)) + self.bound[n] - 1
            fits = last < len(n)
            i, j = np.flatnonzero(fits), last[fits]
            near = (n[i] == n[j]) & (b[i] == b[j]) & (p[j] - p[i] <= self.m[n[i]] - self.q)
            i, j = i[near], j[near]
            low = np.maximum(0, p[j] + self.q - self.m[n[j]])  # of the first segment that holds them all
            many = np.minimum(p[i], self.length[n[i]] - self.m[n[i]]) - low + 1
            begin = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            diagonal = b[i] * w[i] - shift * (w[i] // 2) - w[i] * (1 + self.longest // w[i])
            found.append(np.unique(np.stack([np.repeat(n[i], many), begin, np.repeat(diagonal, many)], axis=1), axis=0))
        every = np.unique(np.concatenate(found), axis=0)
        for item in np.unique(every[:, 0]):
            own = every[every[:, 0] == item]
            yield int(item), own[:, 1], own[:, 2]

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, start, end, edits, segments) of one block of codes; the segments are those that match: all that equal the text, and if
        none does, all with at most k edits."""
        for item, begin, low in self.candidates(codes):
            own, m, k = self.codes[item], int(self.m[item]), int(self.k[item])
            equal, start = np.zeros(len(begin), dtype=bool), np.zeros(len(begin), dtype=np.int64)
            for step in range(2 * (2 * k + 1)):  # along each diagonal of the band
                t = begin + low + step
                inside = np.flatnonzero((t >= 0) & (t + m <= len(codes)) & ~equal)
                inside = inside[codes[t[inside]] == own[begin[inside]]]
                for part in np.array_split(inside, max(1, len(inside) * m // (1 << 20))):
                    same = part[(codes[t[part][:, None] + np.arange(m)] == own[begin[part][:, None] + np.arange(m)]).all(axis=1)]
                    equal[same], start[same] = True, t[same]
            if equal.any():
                yield item, int(start[equal].min()), int(start[equal].max()) + m, 0, len(np.unique(begin[equal]))
                continue
            edits, end = aligned(own, begin, codes, low + k, m, k)
            hit = edits <= k
            if hit.any():
                yield item, int(np.maximum(0, end[hit] - m).min()), int(end[hit].max()), int(edits[hit].min()), len(np.unique(begin[hit]))

    def scan(self, text: str | None) -> dict[int, tuple[int, int, int, int]]:
        """By item: start and end (code points of the text) of what its matched segments span, the least edits, segments."""
        found: dict[int, tuple[int, int, int, int]] = {}
        if not text:
            return {}
        codes, at, inside, total = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), False, 0
        for b in range(0, len(text), BLOCK):
            new, where = normalised(text[b : b + BLOCK], inside)
            inside, total = bool(len(new)) and bool(new[-1]), total + len(new)
            behind = max(0, len(codes) - self.reach)
            codes, at = np.concatenate((codes[behind:], new)), np.concatenate((at[behind:], where + b))
            for number, start, end, edits, segments in self.matches(codes):
                item = self.ids[number]
                a, z, e, n = found.get(item, (len(text), 0, 1 << 30, 0))
                found[item] = (min(a, int(at[start])), max(z, int(at[end - 1]) + 1), min(e, edits), n + segments)
        if self.short and 0 < total <= self.q:
            whole = np.trim_zeros(codes)
            for item in self.short.get(whole.tobytes(), []):
                a, z = np.flatnonzero(codes)[[0, -1]]
                found[item] = (int(at[a]), int(at[z]) + 1, 0, 1)
        return found


def indexes(benchmark: DataFrame, q: int, segment: int, edit_rate: float, block_chars: int) -> Iterator[Index]:
    """Indexes of bounded size that together hold benchmark(item_id, text)."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.xxhash64("text"))), F.lit(n)) == b).orderBy("item_id").collect()
        yield Index([(r["item_id"], r["text"]) for r in part], q, segment, edit_rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, segment: int = 64, edit_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start, end, edits, segments: a row for each text of docs(doc_id, text) and item that it holds."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, start long, end long, edits int, segments int"
    for index in indexes(benchmark, q, segment, edit_rate, block_chars):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, None if i in sent.value.nameless else i, *m) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, m in sorted(sent.value.scan(t).items())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits", "segments"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, segment: int = 64, edit_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, all their columns, whose text holds no item."""
    def filtered(rows: DataFrame, index: Index) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def holds(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(sent.value.scan(t)) for t in texts], dtype=bool)

        return rows.where(~holds("text"))

    for index in indexes(benchmark, q, segment, edit_rate, block_chars):
        docs = filtered(docs, index)
    return docs

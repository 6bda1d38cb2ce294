"""Best-fit packing with large-item matching.

Documents are encoded, ended with id 0, and only those longer than the capacity are cut. Packing works on the histogram of
piece lengths, which has at most ``capacity`` entries whatever the corpus holds:

* lengths above a third of the capacity: at most two fit in a sequence. From the longest down, each is matched greedily with
  the longest other large piece that still fits;
* smaller lengths, from the longest down, go to the sequences with the smallest gap that takes them, else to new ones.

All pieces of one length are interchangeable, so the plan moves whole runs of equal sequences at a time. Each piece then
finds its place from its rank among the pieces of its length. Ranks are dealt in two levels (length, bucket), so a length
that a third of all pieces share never meets in one task.

Null and empty texts are one piece holding the final id alone. Repeated rows are packed as often as they come. Other columns
are ignored.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm._shared import blocks, gapless_rank, numbered, plain, staged

LONGEST_WORD = 2000


class IdEncoder:
    """Ids of a text as the tokenizer gives them, as little-endian unsigned 32-bit bytes.

    ranks_path names the same vocabulary as ranks. Plain texts are encoded with it, faster; where no two white-space
    characters follow each other, with a splitting pattern that needs no look-ahead.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ranked = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            single = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s")
            self.ranked = [tiktoken.Encoding(f"ranks-{k}", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for k, p in enumerate((single, public_tokenizers.PATTERN))]

    def encode(self, text: str) -> bytes:
        words = text.split()
        if not self.ranked or not plain(text) or max(map(len, words), default=0) > LONGEST_WORD:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        inner = len(text) - sum(map(len, words)) - text[0].isspace() - text[-1].isspace()
        encoding = self.ranked[not words or inner >= len(words)]
        return b"".join(encoding.encode_to_numpy(b, disallowed_special=()).astype("<u4").tobytes() for b in blocks(text))


@functools.cache
def encoder_for(path: str, ranks_path: str | None) -> IdEncoder:
    """One a Python worker."""
    return IdEncoder(path, ranks_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of docs(doc_id, text); the first piece takes the remainder."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(tokenizer_path, ranks_path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = (encoder.encode(text) if text else b"") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs of equal sequences (first number, count, gap), and where the ranks of each length go."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        #: (length, first rank, end rank, pieces a sequence, first sequence, first offset)
        self.places: list[tuple[int, int, int, int, int, int]] = []
        #: Sorted (gap, first sequence, count).
        self.open: list[tuple[int, int, int]] = []
        self.next_rank: dict[int, int] = {}

    def put(self, length: int, per: int, first: int, count: int, gap: int) -> None:
        """per pieces of a length in each of count sequences from first, whose gap is given."""
        rank = self.next_rank.get(length, 0)
        self.places.append((length, rank, rank + per * count, per, first, self.capacity - gap))
        self.next_rank[length] = rank + per * count
        if gap - per * length:
            bisect.insort(self.open, (gap - per * length, first, count))

    def new(self, count: int) -> int:
        self.made += count
        return self.made - count


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """counts: pieces of each length from 1 to capacity. The size of the plan follows the number of lengths."""
    plan, left = Plan(capacity), {k: v for k, v in counts.items() if v}
    if any(not 1 <= k <= capacity for k in left):
        raise ValueError("lengths must be between 1 and the capacity")
    large = sorted(k for k in left if 3 * k > capacity)
    pairs: list[tuple[int, int, int]] = []
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        n = min(left[a], left[b]) if b and b != a else left[a] // 2 if b else left[a]
        if b == a and left[a] == 1:  # the last of its length can't be matched with itself
            b, n = (large[at - 1], 1) if at > 0 else (0, 1)
        pairs.append((a, b, n))
        for k in (a, b) if b else (a,):
            left[k] -= n
        large = [k for k in large if left[k]]
    for a, b, n in pairs:
        first = plan.new(n)
        if b == a:
            plan.put(a, 2, first, n, capacity)
        elif not b:
            plan.put(a, 1, first, n, capacity)
        else:  # a, then b behind it: what a leaves is filled at once
            plan.put(a, 1, first, n, capacity)
            plan.open.remove((capacity - a, first, n))
            plan.put(b, 1, first, n, capacity - a)
    for s in sorted((k for k, v in left.items() if v), reverse=True):
        c = left[s]
        while c:
            at = bisect.bisect_left(plan.open, (s, -1, -1))
            if at == len(plan.open):
                per = capacity // s
                n, first = -(-c // per), plan.made
                plan.new(n)
                bisect.insort(plan.open, (capacity, first, n))
                continue
            gap, first, n = plan.open.pop(at)
            per = gap // s
            full = min(n, c // per)
            if full:
                plan.put(s, per, first, full, gap)
                c -= per * full
            if full < n and c and c < per:
                plan.put(s, c, first + full, 1, gap)
                full, c = full + 1, 0
            if full < n:
                bisect.insort(plan.open, (gap, first + full, n - full))
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, ranks_path: str | None = None, rows_a_bucket: int = 20_000) -> DataFrame:
    """The pieces of token_pieces() with sequence_id and offset (gapless from 0 in each sequence).

    The driver holds the histogram and the plan, bounded by the capacity; the plan is broadcast (a few thousand rows).
    """
    spark = docs.sparkSession
    pieces = staged(numbered(token_pieces(docs, tokenizer_path, capacity, end_id, ranks_path)), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    ranked = gapless_rank(pieces, "length", max(16, sum(counts.values()) // rows_a_bucket), "rank")
    schema = "length long, rank_from long, rank_to long, per long, first_sequence long, first_offset long"
    if len(plan.places) > 64 * capacity:
        raise ValueError("the plan is larger than its bound")
    places = F.broadcast(spark.createDataFrame(plan.places, schema))
    r = F.col("rank") - F.col("rank_from")
    here = (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(places, here).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_sequence") + F.floor(r / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (r % F.col("per")) * ranked["length"]).cast("long").alias("offset"),
    )

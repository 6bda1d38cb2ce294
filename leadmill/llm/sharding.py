"""Sharding by a minimax contiguous partition, with DataFrame functions only.

Rows with equal texts are one atomic group (a row without a text is a group of its own). Groups stand in the order of the
64-bit hash of their text; two texts with one hash, should they occur, share a group. The smallest capacity with which the
ordered groups fill at most ``n_shards`` contiguous shards is found by binary search, each value checked greedily, and the
shards are cut there. Where a huge group forces a capacity far above the mean, the cuts stay as near to equal shares as that
capacity allows.

The driver never holds the groups. It holds the sizes of ranges of the order (4,096 at first) and splits only those ranges
through which a cut may pass, until no cut passes through a range of several groups; so the capacity is exact. The cuts are
``n_shards - 1`` hash values, hence a shard is found by comparisons, without a join.

Null text: size 8 and text_crc32 0. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm._shared import gapless_rank, numbered, staged

BITS = 12


class Range(NamedTuple):
    """Groups whose hash, shifted right by shift bits, is prefix."""

    low: int  # the smallest hash it may hold
    shift: int
    size: int
    groups: int


def needed(ranges: list[Range], capacity: int, whole: bool) -> tuple[int, list[int]]:
    """Shards that the greedy check fills, and the ranges of several groups that its cuts meet.

    whole: ranges aren't cut (an upper bound); otherwise those of several groups are cut anywhere (a lower bound).
    """
    shards, used, met = 1, 0, []
    for i, r in enumerate(ranges):
        if used + r.size <= capacity:
            used += r.size
            continue
        if r.groups > 1:
            met.append(i)
        if whole or r.groups == 1:
            if r.size > capacity:
                return 1 << 62, met  # never fits
            shards, used = shards + 1, r.size
        else:
            more = -(-(used + r.size - capacity) // capacity)
            shards, used = shards + more, used + r.size - more * capacity
    return shards, met


def smallest(ranges: list[Range], n_shards: int, low: int, whole: bool) -> int:
    """Binary search for the smallest capacity, from low, that at most n_shards shards of the greedy check need."""
    high = max(low, sum(r.size for r in ranges))
    while low < high:
        mid = (low + high) // 2
        if needed(ranges, mid, whole)[0] <= n_shards:
            high = mid
        else:
            low = mid + 1
    return low


def cut(ranges: list[Range], n_shards: int, capacity: int) -> list[int]:
    """First ranges of shards 1, 2, ...: each shard as near to its equal share of the rest as the capacity allows."""
    n = len(ranges)
    rest, end, total = [0] * (n + 1), n, 0
    ends = [0] * n
    for i in range(n - 1, -1, -1):  # ends[i]: where a greedy shard from i ends
        total += ranges[i].size
        while total > capacity:
            end -= 1
            total -= ranges[end].size
        ends[i] = end
        rest[i] = 1 + rest[end]
    cuts, used, left = [], 0, sum(r.size for r in ranges)
    for i, r in enumerate(ranges):
        open_shards = n_shards - len(cuts) - 1
        full = used + r.size > capacity
        fair = used + r.size / 2 > (left + used) / (open_shards + 1)
        if used and open_shards and (full or fair and rest[i] <= open_shards):
            cuts.append(i)
            used = 0
        used += r.size
        left -= r.size
    return cuts


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the first hashes of shards 1, 2, ... for groups(key long, size long), each key once."""
    top = 64 - BITS

    def summed(rows: DataFrame, prefix: Column, *by: str) -> list:
        return rows.groupBy(*by, prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()

    found = summed(groups, F.shiftright("key", top))
    ranges = sorted(Range(r["prefix"] << top, top, r["size"], r["groups"]) for r in found)
    if not ranges:
        return 0, []
    least = max(groups.agg(F.max("size")).first()[0], -(-sum(r.size for r in ranges) // n_shards))
    while True:
        capacity = smallest(ranges, n_shards, least, whole=True)
        lower = smallest(ranges, n_shards, least, whole=False)
        met = set(needed(ranges, lower, False)[1]) | set(needed(ranges, capacity - 1, True)[1]) if lower < capacity else set()
        if not met:
            return capacity, [ranges[i].low for i in cut(ranges, n_shards, capacity)]
        split = [ranges[i] for i in sorted(met)]
        own = reduce(lambda c, k: c.when(F.shiftright("key", split[k].shift) == split[k].low >> split[k].shift, k), range(1, len(split)), F.when(F.shiftright("key", split[0].shift) == split[0].low >> split[0].shift, 0))
        finer = reduce(lambda c, k: c.when(F.col("own") == k, F.shiftright("key", max(0, split[k].shift - BITS))), range(1, len(split)), F.when(F.col("own") == 0, F.shiftright("key", max(0, split[0].shift - BITS))))
        parts = summed(groups.withColumn("own", own).where("own is not null"), finer, "own")
        kept = [r for i, r in enumerate(ranges) if i not in met]
        ranges = sorted(kept + [Range(p["prefix"] << (s := max(0, split[p["own"]].shift - BITS)), s, p["size"], p["groups"]) for p in parts])


def shard_of(key: Column, cuts: list[int]) -> Column:
    return reduce(lambda c, x: c + (key >= F.lit(x)).cast("int"), cuts, F.lit(0))


def shard_documents(docs: DataFrame, n_shards: int = 24, overhead: int = 8, rows_a_bucket: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) for docs(doc_id, text)."""
    text = F.col("text").cast("binary")
    rows = numbered(docs.select("doc_id", "text")).select(
        "row_id",
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.lit("no text"), "doc_id", "row_id")).alias("key"),
    )
    rows = staged(rows, "shard-rows")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = minimax_cuts(groups, n_shards)
    dealt = rows.withColumn("shard", shard_of(F.col("key"), cuts).cast("int"))
    return gapless_rank(dealt, "shard", max(16, rows.count() // rows_a_bucket), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")

"""Cooldowns over a whole log: which sends pass, when each must be the cooldown or more after the last that passed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.operators.ordering import running
from leadmill.sources.staging import written


def pointers(log: DataFrame, gap_us: int, parts: int | None = None) -> DataFrame:
    """(site, place, next, id): the sends of log(id, site, sent_at) numbered by site in order of time and id, each with the place of the first
    one at least gap_us later (beyond the last place where there is none). A range lookup over the sorted run: for each send a mark stands at
    its time plus the gap, before the sends of that moment, and the sends up to the mark are counted."""
    at = F.unix_micros("sent_at")
    both = log.where("sent_at is not null").select("site", "id", F.explode(F.array(
        F.struct(at.alias("at"), F.lit(1).alias("kind")), F.struct((at + gap_us).alias("at"), F.lit(0).alias("kind")))).alias("m")).select("site", "id", "m.at", "m.kind")
    counted = running(both, "site", ["at", "kind", "id"], "count", F.col("kind"), parts)
    return counted.groupBy("site", "id").agg(F.max(F.when(F.col("kind") == 1, F.col("count"))).alias("place"), (F.max(F.when(F.col("kind") == 0, F.col("count"))) + 1).alias("next"))


def cooled_down(log: DataFrame, days: int, parts: int | None = None) -> DataFrame:
    """id, site of the sends of log(id, site, sent_at) that a cooldown lets through: the first to each site, and each that comes the cooldown
    or more after the last one let through. Ids are unique; sends without a time are left out; sends without a site are one site's.

    Each send points to the first one after its cooldown, so those that pass are the chain from a site's first send. Pointer doubling
    finds all of it: in each round what is reached grows by the pointers' targets, and the pointers by twice their reach. A chain is no
    longer than the log's time span in cooldowns, so the rounds are known beforehand, at most its binary logarithm. No row holds a site."""
    gap = days * 86_400_000_000
    if gap <= 0:
        return log.where("sent_at is not null").select("id", "site")
    jump = written(pointers(log.withColumn("site", F.struct("site")), gap, parts), "cooldown")
    first, last = log.agg(F.min(F.unix_micros("sent_at")), F.max(F.unix_micros("sent_at"))).first()
    reached = jump.where("place = 1").select("site", "place")
    step = jump.select("site", "place", "next")
    for _ in range(math.ceil(math.log2((last - first) // gap + 2)) if first is not None else 0):
        onward = reached.hint("merge").join(step, ["site", "place"]).select("site", F.col("next").alias("place"))
        reached = written(reached.unionByName(onward).distinct(), "cooldown-reached")
        further = step.select("site", F.col("place").alias("next"), F.col("next").alias("after"))
        step = written(step.hint("merge").join(further, ["site", "next"]).select("site", "place", F.col("after").alias("next")), "cooldown-step")
    return jump.hint("merge").join(reached, ["site", "place"], "left_semi").select("id", F.col("site.site").alias("site"))

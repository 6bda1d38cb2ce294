"""Numbers, running sums and neighbours in the order of a group, however many rows a group has.

A window over a group brings the whole group to one task. Here rows are dealt by ranges of (group, order), so a hot group spreads
over many parts, each in order; windows run within a part of a group, and what the group's earlier parts hold comes from one row a
part. The dealt table is written, so that parts stay as they are when a task runs again. Of a group there are at most as many parts as
the deal has partitions, which bounds the windows over parts. Rows that tie in the whole order are numbered in no fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.sources.staging import written


def dealt(df: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """df with __part, its range of (group, order)."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()), "ordered")


def within(group: str, order: list[str]) -> Window:
    return Window.partitionBy(group, "__part").orderBy(*order)


def joined(rows: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """Rows with what is known of their part of the group; null groups are a group too."""
    same = rows[group].eqNullSafe(parts["__g"]) & (rows["__part"] == parts["__p"])
    return rows.join(parts.hint("merge"), same).drop("__g", "__p", "__part")


def running(df: DataFrame, group: str, order: list[str], name: str, value: Column | None = None, parts: int | None = None) -> DataFrame:
    """df with the sum of value (without one, of rows: numbers from 1) over the group's rows up to this one."""
    rows = dealt(df.withColumn("__v", (F.lit(1) if value is None else value).cast("long")), group, order, parts)
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.sum("__v").alias("__s"))
    base = sums.select("__g", "__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    own = F.sum("__v").over(within(group, order).rowsBetween(Window.unboundedPreceding, 0))
    return joined(rows.withColumn("__own", own), base, group).withColumn(name, F.col("__base") + F.col("__own")).drop("__v", "__own", "__base")


def preceding(df: DataFrame, group: str, order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with the value of the group's row before this one, null for the first."""
    rows = dealt(df, group, order, parts)
    last = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"))
    base = last.select("__g", "__p", F.lag("__last").over(Window.partitionBy("__g").orderBy("__p")).alias("__before"))
    place, own = F.row_number().over(within(group, order)), F.lag(value).over(within(group, order))
    both = joined(rows.withColumn("__own", own).withColumn("__first", place == 1), base, group)
    return both.withColumn(name, F.when(F.col("__first"), F.col("__before.v")).otherwise(F.col("__own"))).drop("__own", "__first", "__before")

"""Streams over the folders that logs and page snapshots are written to. Each returns a query; available ends it once all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadmill.operators import outreach
from leadmill.operators.outreach import hourly_counts
from leadmill.operators.pages import site_profiles
from leadmill.operators.profiles import company_profiles
from leadmill.sources.staging import written
from leadmill.sources.tables import parsed_lines


def started(writer, available: bool) -> StreamingQuery:  # noqa: ANN001
    return (writer.trigger(availableNow=True) if available else writer).start()


def ingested(spark: SparkSession, folder: str, schema: str, good: str, bad: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """JSON-lines logs to a table of rows and one of lines that can't be read. Each batch writes a folder of its own, so a repeated batch replaces its rows."""
    rows = parsed_lines(spark.readStream.text(folder), schema)

    def store(batch: DataFrame, number: int) -> None:
        batch.where("bad is null").drop("bad").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("bad is not null").select("bad").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return started(rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), available)


def first_of_cooldown(sends: DataFrame, days: int = 30) -> DataFrame:
    """Of a stream of send requests(email, sent_at) the first to each address within the cooldown; the state holds that window. Given at
    once; a request that comes within the cooldown prolongs nothing. leadmill.streaming.cooldown is the exact rolling one."""
    return sends.withWatermark("sent_at", f"{days} days").dropDuplicatesWithinWatermark(["email"])


def counted_hours(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Sends by hour and status of a stream of log rows, late ones counted up to a delay."""
    return hourly_counts(log.withWatermark("sent_at", late))


def sliding_hours(log: DataFrame, cap: int, late: str = "2 hours") -> DataFrame:
    """Sends of each hour that begins every five minutes, and whether they are over the cap; in append mode once none of it can come."""
    return outreach.sliding_hours(log.withWatermark("sent_at", late), cap)


def latest_states(log: DataFrame) -> DataFrame:
    """The last status of each site of a stream of changes (site, send_status, sent_at, id); one row of state a site."""
    last = F.max_by(F.struct(F.col("send_status").alias("status"), "id"), F.struct("sent_at", "id"))
    return log.groupBy("site").agg(last.alias("s")).select("site", "s.status", "s.id")


def upserted(rows: DataFrame, path: str, key: str, order: list[str], buckets: int = 64) -> None:
    """Put rows into the table at path, which keeps of each key the row of the greatest order (then of the greatest other values).

    The table is parted by a hash of the key, and only the parts that rows fall into are read, merged and replaced. The merge is a maximum, so
    rows that come again or out of order change nothing: a batch can be repeated, and one that was stopped half-way mends when it is."""
    spark = rows.sparkSession
    parted = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    hit = [r[0] for r in parted.select("__bucket").distinct().collect()]  # at most so many buckets
    if not hit:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        parted = parted.unionByName(spark.read.schema(parted.schema).parquet(path).where(F.col("__bucket").isin(hit)))
    others = [c for c in rows.columns if c != key and c not in order]
    last = F.max(F.struct(*order, *others)).alias("r")
    merged = written(parted.groupBy(key, "__bucket").agg(last).select(key, "r.*", "__bucket"), "upsert")  # the parts are read before they are replaced
    merged.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)


def kept_states(log: DataFrame, path: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """The last status of each site of a stream of changes (site, send_status, sent_at, id), kept in a table that holds one row a site."""
    change = log.select("site", "sent_at", "id", F.col("send_status").alias("status"))

    def store(batch: DataFrame, number: int) -> None:
        upserted(batch, path, "site", ["sent_at", "id"])

    return started(change.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), available)


def kept_profiles(spark: SparkSession, folder: str, out: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Page snapshots (page_id, url, html, fetched_at), file by file as they come, to a table that holds the whole profile of each page's
    latest snapshot."""
    pages = spark.readStream.schema("page_id long, url string, html string, fetched_at timestamp").parquet(folder)

    def store(batch: DataFrame, number: int) -> None:
        of_page = F.max(F.struct("fetched_at", "url", "html")).alias("p")
        latest = written(batch.where("page_id is not null").groupBy("page_id").agg(of_page).select("page_id", "p.*"), "snapshots")
        found = company_profiles(latest.drop("fetched_at")).join(latest.select("page_id", "fetched_at").hint("merge"), "page_id")
        upserted(found, out, "page_id", ["fetched_at"])

    return started(pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), available)


def extracted(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Page snapshots, file by file as they come, to profile rows; the checkpoint keeps a file from being read twice."""
    pages = spark.readStream.schema(schema).parquet(folder)
    return started(site_profiles(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), available)

"""Stored tables, target lists, logs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the columns of a target list, in order of precedence, and the marks of such a name. Fixed values.
URL_COLUMNS, URL_MARKS = ["トップページURL", "URL", "Url", "url", "Homepage", "homepage"], ("url", "homepage")
NAME_COLUMNS = ["法人名", "Company", "companyName", "company_name", "会社名", "企業名"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def send_log(events: DataFrame) -> DataFrame:
    """The send log that the event table stands for."""
    status = F.create_map(*[F.lit(x) for p in {"purchase": "success", "view": "failed", "error": "error", "click": "captcha_blocked", "signup": "queued"}.items() for x in p])
    mode = F.when(F.col("user_id") % 3 == 0, "direct").when(F.col("user_id") % 3 == 1, "browser")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("site"), status[F.col("event_type")].alias("send_status"), mode.alias("mode"), F.col("ts").cast("timestamp").alias("sent_at"))


def read_targets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A CSV list of targets with its columns and two more, target_url and target_name, found by the header; without a URL column an error."""
    rows = spark.read.option("header", True).csv(path)
    known = [c for c in URL_COLUMNS if c in rows.columns] or [c for c in rows.columns if any(m in c.lower() for m in URL_MARKS)]
    if not known:
        raise ValueError(f"no URL column among {rows.columns}")
    names = [c for c in NAME_COLUMNS if c in rows.columns]
    url = F.trim(F.col(f"`{known[0]}`"))
    named = rows.withColumn("target_name", F.trim(F.col(f"`{names[0]}`")) if names else F.lit(None).cast("string")).where((url != "") & (F.lower(url) != "nan"))
    named = named.withColumn("target_url", F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url)))
    return named if limit is None else named.limit(limit)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """lines(value) of JSON with the columns of schema and bad (the line, where it can't be read)."""
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(F.trim("value") != "").select(row.alias("r")).select("r.*").withColumnRenamed("_corrupt_record", "bad")


def read_json_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines log, and the lines that can't be read."""
    rows = parsed_lines(spark.read.text(path), schema)
    return rows.where("bad is null").drop("bad"), rows.where("bad is not null").select("bad")


def append_json(df: DataFrame, path: str) -> None:
    """The rows appended to a JSON-lines log."""
    df.write.mode("append").json(path)


def ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Known columns that exist, in their order, then the others."""
    return df.select(*[F.col(f"`{c}`") for c in order if c in df.columns], *[F.col(f"`{c}`") for c in df.columns if c not in order])


def write_ordered_csv(df: DataFrame, path: str, order: list[str]) -> None:
    ordered(df, order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def logged(sends: DataFrame, as_of: str) -> DataFrame:
    """Send rows (form_url, send_status, sent_at, ...) as they are stored: with base_url, sent_at defaulted and the day that parts the log."""
    base = F.nullif(F.regexp_extract("form_url", r"^(https?://[^/?#]+)", 1), F.lit(""))
    rows = sends.withColumn("base_url", base).withColumn("sent_at", F.coalesce("sent_at", F.lit(as_of).cast("timestamp")))
    return rows.withColumn("sent_date", F.to_date("sent_at"))


def append_log(sends: DataFrame, path: str, as_of: str) -> None:
    """Send rows appended to a log that is parted by day. Rows are dealt by ranges of (day, site, time) and sorted so within files, so a day's
    files cover few sites each and their row groups short times: the footers' least and greatest values stand in for an index."""
    order = ["sent_date", "base_url", "sent_at"]
    rows = logged(sends, as_of).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("append").partitionBy("sent_date").parquet(path)


def read_log(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None, **equal: object) -> DataFrame:
    """The stored sends of a range of days (both included) that have the given values; None asks nothing. Days choose folders, values the row
    groups that are read."""
    log = spark.read.parquet(path)
    for test, day in ((F.col("sent_date") >= F.lit(first_day).cast("date"), first_day), (F.col("sent_date") <= F.lit(last_day).cast("date"), last_day)):
        log = log.where(test) if day else log
    for column, value in equal.items():
        log = log if value is None else log.where(F.col(column) == value)
    return log


def queue_export(queue: DataFrame) -> DataFrame:
    """Pending rows of a review queue(url, form_url, captcha_type, company_name, required_fields, status, notes) under the headings of the export."""
    pending = queue.where("status = 'pending'")
    return pending.select(
        F.col("company_name").alias("Company"), F.col("url").alias("URL"), F.col("form_url").alias("Form URL"), F.col("captcha_type").alias("CAPTCHA Type"),
        F.array_join("required_fields", ", ").alias("Required Fields"), F.col("notes").alias("Notes"),
    )


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as path and text."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("html"))

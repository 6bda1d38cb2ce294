"""Registered queries on what is stored and read back: target lists, logs, exports; each writes to the shared folder first."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import companies, forms, outreach
from leadmill.sources import derived, tables
from leadmill.sources.staging import shared_folder
from leadmill.sources.tables import read_table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def target_list(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a list of targets, written as CSV and read by its header."""
    path, key = place(spark, "targets"), F.col("c_custkey").cast("string")
    url = F.when(F.col("c_custkey") % 5 == 0, " ").when(F.col("c_custkey") % 5 == 1, F.concat(F.lit(" c"), key, F.lit(".example.jp "))).otherwise(F.concat(F.lit("http://c"), key, F.lit(".example.jp/")))
    rows = read_table(spark, d, "customer").select(F.col("c_name").alias("法人名"), url.alias("Company url"), F.col("c_mktsegment").alias("小業種"))
    rows.write.option("header", True).csv(path)
    return tables.read_targets(spark, path).select("target_name", "target_url", F.col("小業種").alias("segment"))


FOUND["s1_target_list"] = (target_list, """SELECT c_name AS target_name, CASE c_custkey % 5 WHEN 1 THEN 'https://c' || c_custkey || '.example.jp' ELSE 'http://c' || c_custkey || '.example.jp/' END AS target_url,
 c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0""")


def json_log(bad: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Events as a JSON-lines log, appended in two goes, in which each seventh line is cut off; its rows or its bad lines."""

    def read(spark: SparkSession, d: str) -> DataFrame:
        path = place(spark, "log")
        events = read_table(spark, d, "events").select("event_id", "user_id", "event_type")
        whole = events.where("event_id % 7 > 0")
        tables.append_json(whole.where("event_id % 2 = 0"), path)
        tables.append_json(whole.where("event_id % 2 = 1"), path)
        events.where("event_id % 7 = 0").select(F.concat(F.lit('{"event_id":'), "event_id", F.lit(',"user')).alias("value")).write.mode("append").text(path)
        rows, wrong = tables.read_json_log(spark, path, "event_id long, user_id long, event_type string")
        return wrong if bad else rows

    return read


FOUND["s2_s3_json_log"] = (json_log(False), "SELECT event_id, user_id, event_type FROM events WHERE event_id % 7 > 0")
FOUND["s2_bad_lines"] = (json_log(True), """SELECT '{"event_id":' || event_id || ',"user' AS bad FROM events WHERE event_id % 7 = 0""")


def export(spark: SparkSession, d: str) -> DataFrame:
    """Profile columns in the order of the export, written as CSV and read back with the place of each column."""
    path = place(spark, "export")
    rows = read_table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_name").alias("companyName"), F.concat(F.lit("c"), "c_custkey", F.lit('@x, "y"')).alias("email"))
    tables.write_ordered_csv(rows, path, ["url", "email", "companyName"])
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("email", "companyName", F.lit(",".join(back.columns)).alias("columns"))


FOUND["s4_ordered_export"] = (export, """SELECT 'c' || c_custkey || '@x, "y"' AS email, c_name AS companyName, 'email,companyName,balance' AS columns FROM customer""")


def pending(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.contact_sites(read_table(spark, d, "customer"))
    queue = forms.guarded_forms(rows, companies.basic_names(rows).select("page_id", F.col("name").alias("company_name"), F.lit(None).cast("string").alias("email")))
    out = tables.queue_export(queue.select("url", "form_url", F.col("captcha").alias("captcha_type"), "company_name", "required_fields", "status", "notes"))
    return out.toDF(*[c.lower().replace(" ", "_") for c in out.columns])


FOUND["s7_pending_export"] = (pending, """SELECT NULL::VARCHAR AS company, f AS url, f AS form_url, t AS captcha_type, 'name, mail' AS required_fields, 'CAPTCHA detected during crawl. Manual intervention required.' AS notes
 FROM (SELECT 'https://q' || c_custkey || '.example.jp/ask?form=2#top' AS f, CASE c_custkey % 3 WHEN 0 THEN 'recaptcha_v2' ELSE 'hcaptcha' END AS t FROM customer WHERE c_custkey % 3 < 2)""")


def decoded(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Café "), "c_name")
    content = F.when(F.col("c_custkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return read_table(spark, d, "customer").select("c_custkey", tables.decoded(content).alias("text"))


FOUND["s8_decoded_texts"] = (decoded, "SELECT c_custkey, 'Café ' || c_name AS text FROM customer")


def stored_sends(spark: SparkSession, d: str) -> DataFrame:
    """Sends of four days to some sites, from the stored log, newest first."""
    path = place(spark, "sends")
    log = tables.send_log(read_table(spark, d, "events")).where("sent_at is not null").withColumn("form_url", F.concat(F.lit("https://h"), F.col("site") % 20, F.lit(".example.jp/contact")))
    tables.append_log(log, path, outreach.AS_OF)
    found = tables.read_log(spark, path, "2024-01-10", "2024-01-13", base_url="https://h7.example.jp", send_status=None)
    return outreach.found_sends(found, 30, 2).select("id", "send_status", F.date_format("sent_date", "yyyy-MM-dd").alias("day"))


FOUND["l1_l2_stored_sends"] = (stored_sends, """SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'failed' WHEN 'error' THEN 'error' WHEN 'click' THEN 'captcha_blocked' WHEN 'signup' THEN 'queued' END AS send_status,
 strftime(ts, '%Y-%m-%d') AS day FROM events WHERE user_id % 20 = 7 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-13' ORDER BY ts DESC, event_id DESC LIMIT 30 OFFSET 2""")


def weaker_names(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.name_pages(read_table(spark, d, "customer"))
    return companies.completed(rows, companies.chosen(companies.candidates(rows))).select("page_id", "company_name", "method", "confidence")


NAME = "replace(c_name, '#', '')"
FOUND["c5_c6_c15_c21_to_c23_names"] = (weaker_names, f"""SELECT c_custkey AS page_id, CASE c_custkey % 6 WHEN 0 THEN '合同会社' || {NAME} WHEN 1 THEN '株式会社山田商店' || c_custkey WHEN 2 THEN '株式会社名古屋' WHEN 3 THEN '株式会社N' || c_custkey WHEN 4 THEN '株式会社' || {NAME} ELSE {NAME} || '商店・略称:Y(ワイ)' END AS company_name,
 CASE c_custkey % 6 WHEN 0 THEN 'dt_merged' WHEN 1 THEN 'text_pattern_label' WHEN 2 THEN 'business_name' ELSE 'table_field' END AS method, CASE c_custkey % 6 WHEN 0 THEN 0.97 WHEN 1 THEN 0.82 WHEN 2 THEN 0.82 ELSE 0.99 END::DOUBLE AS confidence FROM customer""")

"""Sources, sinks and streams on small folders."""

import datetime as dt
import json

from pyspark.sql import functions as F

from leadmill.operators import outreach
from leadmill.sources import tables
from leadmill.streaming import streams

LOG = "site long, send_status string, sent_at timestamp, id long"


def written(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(folder)


def test_targets(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("トップページURL,法人名,小業種\n a.jp ,株式会社A,x\nhttp://b.jp,B,y\nnan,C,z\n,D,z\n", encoding="utf-8")
    rows = tables.read_targets(spark, str(path)).collect()
    assert [(r.target_url, r.target_name, r["小業種"]) for r in rows] == [("https://a.jp", "株式会社A", "x"), ("http://b.jp", "B", "y")]
    assert tables.read_targets(spark, str(path), 1).count() == 1
    path.write_text("My homepage address\nx.jp\n", encoding="utf-8")
    assert tables.read_targets(spark, str(path)).first().target_url == "https://x.jp"


def test_json_log_keeps_bad_lines(spark, tmp_path):
    folder = written(tmp_path / "log", "a.jsonl", [{"site": 1, "send_status": "success"}, "{broken\n", "\n", {"site": 2}])
    good, bad = tables.read_json_log(spark, folder, "site long, send_status string")
    assert sorted((r.site, r.send_status) for r in good.collect()) == [(1, "success"), (2, None)] and [r.bad for r in bad.collect()] == ["{broken"]
    tables.append_json(good, str(tmp_path / "out"))
    tables.append_json(good, str(tmp_path / "out"))
    assert tables.read_json_log(spark, str(tmp_path / "out"), "site long")[0].count() == 4


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", "c")], "z long, url string, email string")
    assert tables.ordered(rows, ["email", "url", "none"]).columns == ["email", "url", "z"]
    tables.write_ordered_csv(rows, str(tmp_path / "csv"), ["email", "url"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"email": "c", "url": "b", "z": "1"}
    queue = spark.createDataFrame([("u", "f", "image", "A", ["name", "mail"], "pending", "n"), ("u", "f", "image", "A", None, "completed", "n")], "url string, form_url string, captcha_type string, company_name string, required_fields array<string>, status string, notes string")
    assert [r["Required Fields"] for r in tables.queue_export(queue).collect()] == ["name, mail"]


def test_append_log_by_day(spark, tmp_path):
    sends = spark.createDataFrame([(1, "https://a.jp/f?x", "success", None), (2, "b", "failed", dt.datetime(2024, 1, 2, 3))], "id long, form_url string, send_status string, sent_at timestamp")
    tables.append_log(sends, str(tmp_path / "log"), "2024-01-30 12:00:00")
    got = {r.id: (r.base_url, str(r.sent_date)) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {1: ("https://a.jp", "2024-01-30"), 2: (None, "2024-01-02")}


def test_snapshots_of_two_encodings(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.html").write_bytes("é漢".encode())
    (tmp_path / "p" / "b.html").write_bytes("é".encode("latin-1"))
    assert sorted(r.html for r in tables.read_snapshots(spark, str(tmp_path / "p")).collect()) == sorted(["é漢", "é"])


def test_streamed_logs_and_quarantine(spark, tmp_path):
    folder = written(tmp_path / "in", "1.jsonl", [{"site": 1}, "broken{\n"])
    run = lambda: streams.ingested(spark, folder, "site long", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination()
    run()
    written(tmp_path / "in", "2.jsonl", [{"site": 2}])
    run()
    assert sorted(r.site for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2] and [r.bad for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["broken{"]


def streamed(spark, tmp_path, name, batches, schema, operator, mode):
    """The rows of a memory sink after the batches, one file each, were read in turn."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        written(folder, f"{k}.json", rows)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = operator(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_cooldown_counts_and_states(spark, tmp_path):
    sends = [[{"email": "a", "sent_at": "2024-01-01T00:00:00Z"}, {"email": "a", "sent_at": "2024-01-02T00:00:00Z"}], [{"email": "b", "sent_at": "2024-01-03T00:00:00Z"}, {"email": "a", "sent_at": "2024-01-04T00:00:00Z"}]]
    assert sorted(r.email for r in streamed(spark, tmp_path, "cool", sends, "email string, sent_at timestamp", streams.first_of_cooldown, "append").collect()) == ["a", "b"]
    row = lambda i, site, status, at: {"id": i, "site": site, "send_status": status, "sent_at": f"2024-01-01T{at}Z"}
    logs = [[row(1, 7, "queued", "00:10:00"), row(2, 8, "queued", "01:10:00")], [row(3, 7, "success", "00:50:00"), row(4, 7, "queued", "00:40:00")]]
    states = streamed(spark, tmp_path, "states", logs, LOG, streams.latest_states, "complete")
    assert {r.site: (r.status, r.id) for r in states.collect()} == {7: ("success", 3), 8: ("queued", 2)}
    hours = streamed(spark, tmp_path, "hours", logs, LOG, streams.counted_hours, "complete").collect()
    batch = outreach.hourly_counts(spark.read.schema(LOG).json(str(tmp_path / "hours"))).collect()
    assert sorted(map(tuple, hours)) == sorted(map(tuple, batch)) and sum(r.n for r in hours) == 4


def test_extracted_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.jp/", "<title>T</title><form action=/x>contact</form>"), (2, "https://a.jp/b", None)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.extracted(spark, str(tmp_path / "in"), "page_id long, url string, html string", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.page_id: (r.title, r.form_url, r.crawl_status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("T", "https://a.jp/x", "success"), 2: (None, "https://a.jp/b", "error")} and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_found_sends_and_limits(spark):
    log = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (2, "a", dt.datetime(2024, 1, 1)), (3, "b", dt.datetime(2024, 1, 2))], "id long, mode string, sent_at timestamp")
    assert [r.id for r in outreach.found_sends(log, 5, mode="a").collect()] == [2, 1] and [r.id for r in outreach.found_sends(log, 1, 1).collect()] == [2]
    assert outreach.delayed(spark.range(4).withColumn("place", F.col("id") + 1), 30, "1970-01-01 00:00:00").agg(F.max("at_seconds")).first()[0] == 6

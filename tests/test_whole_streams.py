"""Streams against their batch twins: late data, restarts, repeated batches, changed pages."""

import json
import random

from pyspark.sql import functions as F

from leadmill.operators import cooldown, outreach, profiles
from leadmill.sources import derived
from leadmill.streaming import cooldown as rolling
from leadmill.streaming import streams

LOG = "id long, site long, send_status string, sent_at timestamp"
DAY = 86_400
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_of(seed, n, sites=3, days=12):
    rng = random.Random(seed)
    return [{"id": i, "site": 0 if i % 3 else rng.randrange(sites), "send_status": rng.choice(["success", "failed"]), "sent_at": 1_704_067_200 + rng.randrange(days * DAY) // 1800 * 1800} for i in range(n)]


def file_of(folder, name, rows):
    folder.mkdir(exist_ok=True)
    stamp = lambda s: __import__("datetime").datetime.fromtimestamp(s, __import__("datetime").UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    (folder / name).write_text("".join(json.dumps(r | {"sent_at": stamp(r["sent_at"])}) + "\n" for r in rows))


def walked(rows, days):
    passed, last = set(), {}
    for r in sorted(rows, key=lambda r: (r["sent_at"], r["id"])):
        if r["site"] not in last or r["sent_at"] - last[r["site"]] >= days * DAY:
            last[r["site"]] = r["sent_at"]
            passed.add((r["id"], r["site"]))
    return passed


def test_cooldown_of_a_hot_site(spark):
    rows = rows_of(1, 600)
    log = spark.createDataFrame([(r["id"], r["site"] or None, r["sent_at"]) for r in rows], "id long, site long, s long").select("id", "site", F.timestamp_seconds("s").alias("sent_at")).repartition(4)
    for days in (1, 3, 30):
        found = cooldown.cooled_down(log, days, parts=13)
        assert {(r.id, r.site or 0) for r in found.collect()} == walked(rows, days)
        assert "collect_list" not in found._jdf.queryExecution().toString()
    assert cooldown.cooled_down(log.limit(0), 1).count() == 0 and cooldown.cooled_down(log, 0).count() == 600


def test_rolling_cooldown_with_late_data_and_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = sorted(rows_of(2, 90), key=lambda r: r["sent_at"] + random.Random(r["id"]).randrange(DAY - 1800))  # late by less than the delay
    flush = [{"id": -1, "site": 99, "send_status": "x", "sent_at": rows[-1]["sent_at"] + 99 * DAY}]
    for k in range(3):
        file_of(tmp_path / "in", f"{k}.json", rows[k * 30 : k * 30 + 30])

    def run():
        sends = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = rolling.cooled_down(sends, days=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()

    try:
        run()
        file_of(tmp_path / "in", "3.json", flush)  # the query starts anew from its checkpoint
        run()
        got = {(r.id, r.site) for r in spark.read.parquet(str(tmp_path / "out")).where("id >= 0").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = cooldown.cooled_down(spark.read.schema(LOG).json(str(tmp_path / "in")).where("id >= 0"), 2)
    assert got == walked(rows, 2) == {tuple(r) for r in batch.collect()}


def test_kept_states_of_repeated_and_mixed_batches(spark, tmp_path):
    rows = rows_of(3, 120, sites=20)
    log = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, site long, send_status string, s long").select("id", "site", "send_status", F.timestamp_seconds("s").alias("sent_at"))
    table = str(tmp_path / "table")
    parts = [log.where(F.col("id") % 3 == k).select("site", "sent_at", "id", F.col("send_status").alias("status")) for k in (2, 0, 1)]
    for batch in (*parts, parts[0], parts[0].limit(0), parts[1]):  # out of order, again, empty
        streams.upserted(batch, table, "site", ["sent_at", "id"], buckets=4)
    want = sorted(map(tuple, outreach.latest_state(log).select("site", "status", "id").collect()))
    assert sorted(map(tuple, spark.read.parquet(table).select("site", "status", "id").collect())) == want
    for k in range(3):
        file_of(tmp_path / "in", f"{k}.json", rows[k::3])
        streams.kept_states(spark.readStream.schema(LOG).json(str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "kept")).select("site", "status", "id").collect())) == want


def test_sliding_hours_in_append_mode(spark, tmp_path):
    rows = sorted(rows_of(4, 80, days=1), key=lambda r: r["sent_at"])
    for k in range(2):
        file_of(tmp_path / "in", f"{k}.json", rows[k::2] if k else rows[::2])
    file_of(tmp_path / "in", "z.json", [{"id": -1, "site": 1, "send_status": "x", "sent_at": rows[-1]["sent_at"] + 9 * DAY}])
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = streams.sliding_hours(source, 3, late="2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    batch = outreach.sliding_hours(spark.read.schema(LOG).json(str(tmp_path / "in")).where("id >= 0"), 3)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_kept_profiles_of_changed_pages(spark, tmp_path):
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey < 17")
    pages = derived.company_pages(customers).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    changed = pages.where("page_id in (1, 2)").withColumn("html", F.lit("<title>株式会社新規 | 会社概要</title><p>new@fresh.example.jp</p>")).withColumn("fetched_at", F.lit("2024-01-02").cast("timestamp"))
    old = changed.where("page_id = 2").withColumn("html", F.lit("<p>old@old.example.jp</p>")).withColumn("fetched_at", F.lit("2023-01-01").cast("timestamp"))
    run = lambda: streams.kept_profiles(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    changed.unionByName(old).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    latest = pages.where("page_id not in (1, 2)").unionByName(changed).drop("fetched_at")
    want = profiles.company_profiles(latest)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("email = 'new@fresh.example.jp'").count() == 2

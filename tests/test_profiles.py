"""The one-pass profile against the operators that go row by row, on derived and odd pages; the stored log's plan."""

import pytest
from pyspark.sql import functions as F

from leadmill.operators import companies, emails, forms, industry, outreach, profiles
from leadmill.sources import derived, tables

SF = "/root/testdata/sf0.001"
ODD = [None, "", "<form", "no markup 株式会社A", "<form><input name=mail></form>" * 3, "<p>" + "a@b.co x1@h.jp " * 200 + "</p>", "<table><tr><td>会社名<td>株式会社甲</tr><tr><td>会社名<td>乙商店</table><footer>x1@h.jp</footer>"]


@pytest.fixture(scope="module")
def pages(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey < 48")
    parts = [derived.company_pages(customers), derived.name_pages(customers), derived.contact_sites(customers), spark.createDataFrame([(i, f"https://h.jp/{i}", t) for i, t in enumerate(ODD)], "page_id long, url string, html string")]
    rows = parts[0]
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("page_id", F.col("page_id") + 1000 * k))
    return rows.cache()


def test_profile_is_what_the_operators_find(pages):
    got = {r.page_id: r for r in profiles.company_profiles(pages).collect()}
    assert len(got) == pages.count()
    mail = {r.page_id: (r.email, r.confidence) for r in emails.ranked(pages).collect()}
    name = {r.page_id: (r.company_name, r.confidence) for r in companies.completed(pages, companies.chosen(companies.candidates(pages))).collect()}
    trade = {r.page_id: (r.industry, r.confidence) for r in industry.best_industries(pages).collect()}
    form = {r.page_id for r in forms.scored_forms(pages).collect()}
    for i, r in got.items():
        assert (r.email, r.email_confidence) == mail.get(i, (None, None))
        assert (r.company_name, r.name_confidence) == name.get(i, (None, None))
        assert (r.industry, r.industry_confidence) == trade[i] and (r.form_method == "enhanced_detector") == (i in form)


def test_repeated_ids_are_rows_like_others(pages):
    few = pages.where("page_id < 8")
    twice = profiles.company_profiles(few.unionByName(few))
    assert twice.count() == 16 and twice.distinct().count() == 8
    mixed = profiles.company_profiles(few.withColumn("page_id", F.lit(None).cast("long")))
    assert sorted(str(r.email) for r in mixed.collect()) == sorted(str(r.email) for r in twice.distinct().collect())
    plan = twice._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan and profiles.company_profiles(few.limit(0)).count() == 0


def test_stored_log_is_pruned(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    log = tables.send_log(events).withColumn("form_url", F.concat(F.lit("https://h"), F.col("site"), F.lit(".jp/contact")))
    path = str(tmp_path / "log")
    tables.append_log(log, path, outreach.AS_OF)
    tables.append_log(log.limit(3).withColumn("sent_at", F.lit(None).cast("timestamp")), path, outreach.AS_OF)
    found = tables.read_log(spark, path, "2024-01-05", "2024-01-06", base_url="https://h1.jp")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(sent_date" in plan and "EqualTo(base_url,https://h1.jp)" in plan
    want = log.where("site = 1 and to_date(sent_at) between '2024-01-05' and '2024-01-06'").count()
    assert found.count() == want > 0 and tables.read_log(spark, path).count() == events.count() + 3
    assert tables.read_log(spark, path, first_day="2024-01-30", last_day="2024-01-30").where("sent_at = timestamp '2024-01-30 12:00:00'").count() >= 3

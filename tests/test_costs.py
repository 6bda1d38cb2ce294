"""What an operator reads is worked out once a page, and pages are dealt over all cores."""

import time

from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions import text
from leadmill.operators import companies, emails, forms, industry, merging, outreach, profiles
from leadmill.sources import derived

CUSTOMERS = "/root/testdata/sf0.001/customer.parquet"


def test_pages_are_dealt_over_all_cores(spark):
    customers = spark.read.parquet(CUSTOMERS)
    for source in (derived.company_pages, derived.linked_pages, derived.graph_pages, derived.contact_sites, derived.name_pages, derived.model_replies):
        made = source(customers)
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > customers.rdd.getNumPartitions()
        assert made.count() == customers.count() * (2 if source is derived.contact_sites else 1)


def patterns(df):
    """How many searches by a regular expression the optimised plan writes out."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_")


def test_no_search_is_written_out_again(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 26)
    html = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"))
    most = {forms.multi_step: 100, forms.form_fields: 100, forms.analysed_forms: 100, emails.candidates: 150, companies.candidates: 400, industry.page_industries: 40}
    got = {(f.__module__, f.__name__): (patterns(f(html)), n) for f, n in most.items()}
    got["labels"] = patterns(merging.from_labels(html.withColumnRenamed("html", "reply"))), 120
    assert all(written <= n for written, n in got.values()), got


def test_names_beside_legal_forms_in_time(spark):
    """3,000 pages; worked out anew for each legal form, this took over 20 s of one core."""
    text = F.concat(F.repeat(F.lit("会社 案内 と 説明 "), 100), F.lit("株 式会社 花"), F.col("id").cast("string"))
    rows = spark.range(0, 3000, 1, 1).select(text.alias("t"), F.concat(F.lit("花"), F.col("id").cast("string")).alias("n"))
    start = time.monotonic()
    got = rows.select(companies.surely_completed(F.col("t"), F.col("n")).alias("x"), "n").collect()
    assert time.monotonic() - start < 20 and all(r.x == "株式会社" + r.n for r in got)


def test_filter_on_a_profile_works_nothing_out_again(spark):
    """Recipients are filtered by their address; before, the filter wrote the address and the page out again."""
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 26)
    found = profiles.company_profiles(derived.company_pages(spark.read.parquet(CUSTOMERS))).select("page_id", "email", "company_name")
    assert patterns(outreach.recipients(found, "{company_name}", "{email}")) == patterns(found)


def test_profile_is_found_one_value_after_the_other(spark):
    """No step of the plan holds all searches: together they are too wide for generated code."""
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 26)
    html = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"))
    steps, plan = [], profiles.company_profiles(html)._jdf.queryExecution().optimizedPlan()
    while plan.children().size():
        steps.append(plan.toString().count("regexp_"))
        plan = plan.children().head()
    own = [a - b for a, b in zip(steps, [*steps[1:], 0], strict=True)]
    assert max(own) < 0.8 * sum(own) and sum(n > 0 for n in own) >= 4, own


def test_long_runs_without_an_address_in_time(spark):
    """A run of 300,000 signs of an address; sought from each of its signs, it took over a minute."""
    page = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("https://a.example.jp").alias("url"), F.concat(F.lit("<p>x@y.jp "), F.repeat(F.lit("abc"), 100000)).alias("text"))
    start = time.monotonic()
    got = page.select(emails.mails("m", F.col("text"), F.lit("")).alias("m")).first().m
    assert [m.raw for m in got] == ["x@y.jp"] and time.monotonic() - start < 10


def test_quick_patterns_find_what_the_plain_ones_find(spark):
    texts = ["a@b.com1@c.jp", "a@b.co@c.com", "%@-.co", "xx a.b+c@d-e.example.jp.", "@@a@b.jp", "a@b", "1@2.jp-x@y.jp", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(H.every(F.col("t"), text.EMAIL).alias("plain"), H.every(F.col("t"), text.EMAILS).alias("quick")).collect()
    assert all(r.plain == r.quick for r in both)
    words = ["e-mail", "Q&A", "会 社", "item"]
    held = spark.createDataFrame([("an e-mail",), ("Q&A",), ("会社",), ("x 会 社",), ("ite",), ("items",)], "t string")
    assert [r[0] for r in held.select(F.rlike("t", F.lit(text.any_of(words)))).collect()] == [True, True, False, True, False, True]

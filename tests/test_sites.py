"""Rules, walks and orders of whole sites on rows that the tables lack: hot sites, ties, repeated rows, nulls."""

import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from leadmill.operators import ordering, pages, reach, robots

RULE = "origin string, agent string, seq int, allow boolean, path_prefix string"
PAGE = "page_id long, url string, html string"


def test_links_however_written(spark):
    html = "<a href='/a'>x</a><A HREF=/b>y</A><!-- <a href='/c'>z</a> --><script>'<a href=\"/d\">'</script><a\nhref = \"?q=1\">w</a><a href='//h.jp/e#f'>v</a><a href='HTTPS://other.jp/'>u</a><a href='/a'>again</a>"
    rows = spark.createDataFrame([(1, "https://h.jp/x/y", html), (2, "https://h.jp/z", None), (3, None, html)], PAGE)
    want = {(1, f"https://h.jp{p}") for p in ("/a", "/b", "/x/y?q=1", "/e")}
    assert {tuple(r) for r in pages.site_links(rows).collect()} == want
    assert {r.target for r in pages.site_links(rows, ("/a", "?")).collect()} == {"https://h.jp/b", "https://h.jp/e"}


ROBOTS = {
    "https://a.jp": ["User-agent: *", "Disallow: /x", "Allow: /x/y", "Disallow: /%7Ejoe", "", "User-agent: leadbot", "Allow: /x/y", "Disallow: /x", "Disallow: /q?"],
    "https://b.jp": ["User-agent: otherbot", "Disallow: /", "", "User-agent: *", "Disallow:"],
    "https://c.jp": ["User-agent: lead", "Disallow: /a%2fb", "Disallow: /100%", "Allow: /", "", "User-agent: *", "Disallow: /"],
    "https://d.jp": ["User-agent: *", "Allow: /d", "Disallow: *"],
}


def table_of_rules(spark):
    rows, agent = [], None
    for origin, lines in ROBOTS.items():
        for i, line in enumerate(lines):
            key, _, value = (x.strip() for x in line.partition(":"))
            if key == "User-agent":
                agent = value
            elif key:
                rows.append((origin, agent, i, key == "Allow", value))
    return spark.createDataFrame([*rows, (None, "*", 1, False, "/"), ("https://a.jp", None, 0, False, "/")], RULE).repartition(3)


@pytest.mark.parametrize("agent", ["*", "LeadBot/2.0", "otherbot", "third"])
def test_rules_as_the_standard_parser_reads_them(spark, agent):
    paths = ["", "/", "/x", "/x/y", "/x/yz?q=1", "/~joe", "/%7ejoe/a", "/q?a=b", "/q", "/a/b", "/a%2Fb", "/100%", "/d/e", "/é", "/a+b", "/d#part"]
    urls = [o + p for o in [*ROBOTS, "https://none.jp"] for p in paths]
    got = {r.page_id: r.allowed for r in robots.allowed(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] * 2, PAGE), table_of_rules(spark), agent).collect()}
    for i, url in enumerate(urls):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(ROBOTS.get("/".join(url.split("/")[:3]), []))
        assert got[i] == parser.can_fetch(agent, url), (agent, url)


def test_rules_of_one_hot_origin_spread_out(spark):
    rows = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.jp/x/"), F.col("id")).alias("url"), F.lit("").alias("html"))
    found = robots.allowed(rows, table_of_rules(spark), "leadbot", deals=16)
    assert found.where("not allowed").count() == 4000 and "collect_list" not in found._jdf.queryExecution().toString()
    assert robots.allowed(rows, table_of_rules(spark), ignore=True).where("allowed").count() == 4000
    assert robots.allowed(rows.limit(0), table_of_rules(spark)).count() == 0 and robots.allowed(rows.limit(3), table_of_rules(spark).limit(0)).where("allowed").count() == 3
    odd = spark.createDataFrame([(1, None, ""), (None, "https://b.jp/", "")], PAGE)
    assert sorted(r.allowed for r in robots.allowed(odd, table_of_rules(spark)).collect()) == [True, True]


def test_walk_with_rules_roots_and_odd_pages(spark):
    link = lambda *to: "".join(f"<a href='{t}'>t</a>" for t in to)
    rows = [(1, "https://h.jp/", link("/a", "/b", "/gone", "/a")), (2, "https://h.jp/a#x", "<FORM>" + link("/c")), (3, "https://h.jp/b", link("/d")), (4, "https://h.jp/c", None), (5, "https://h.jp/d", "<form>"), (5, "https://h.jp/d", "<form>"), (6, None, "x"), (7, "https://one.jp/", "")]
    table = spark.createDataFrame(rows, PAGE).repartition(3)
    walk = lambda **k: {(r.site, r.place): (r.url.removeprefix("https://h.jp"), r.page_id, r.hop, r.has_form) for r in reach.reached(table, **k).collect()}
    full = {("h.jp", 1): ("/", 1, 0, False), ("h.jp", 2): ("/a", 2, 1, True), ("h.jp", 3): ("/b", 3, 1, False), ("h.jp", 4): ("/gone", None, 1, False), ("h.jp", 5): ("/c", 4, 2, False), ("h.jp", 6): ("/d", 5, 2, True), ("one.jp", 1): ("https://one.jp/", 7, 0, False)}
    assert walk() == full
    assert walk(most=1) == {k: v for k, v in full.items() if k[1] <= 2} and walk(others=1) == {k: v for k, v in full.items() if k[1] <= 2 or k[0] == "one.jp"} | {("h.jp", 3): ("/c", 4, 2, False)}
    rules = spark.createDataFrame([("https://h.jp", "*", 1, False, "/b")], RULE)
    assert [v[0] for k, v in sorted(walk(rules=rules).items()) if k[0] == "h.jp"] == ["/", "/a", "/b", "/gone", "/c"]
    roots = spark.createDataFrame([("h.jp", "https://h.jp/b"), ("h.no", "https://h.no/")], "site string, url string")
    assert {k: v[0] for k, v in walk(roots=roots).items()} == {("h.jp", 1): "/b", ("h.jp", 2): "/d", ("h.no", 1): "https://h.no/"}
    assert reach.reached(table.limit(0)).count() == 0


@pytest.fixture
def crowded(spark):
    """Nine tenths of the rows in one group, some without a group, values with ties."""
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), rng.randrange(300), i, i % 7) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "site string, at long, id long, v long").repartition(5)


def test_running_sums_of_a_hot_group(crowded):
    rows, df = crowded
    got = {r.id: (r.n, r.total) for r in ordering.running(ordering.running(df, "site", ["at", "id"], "n", parts=16), "site", ["at", "id"], "total", F.col("v"), parts=16).collect()}
    for site in {r[0] for r in rows}:
        total = 0
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == site), key=lambda r: r[1:3]), 1):
            total += v
            assert got[i] == (n, total)
    assert len(got) == 3000 and ordering.running(df.limit(0), "site", ["at"], "n").count() == 0


def test_preceding_rows_of_a_hot_group(crowded):
    rows, df = crowded
    got = {r.id: r.before for r in ordering.preceding(df, "site", ["at", "id"], "at", "before", parts=16).collect()}
    for site in {r[0] for r in rows}:
        before = None
        for _, at, i, _ in sorted((r for r in rows if r[0] == site), key=lambda r: r[1:3]):
            assert got[i] == before
            before = at


def test_no_part_of_a_hot_group_is_large(crowded):
    sizes = ordering.dealt(crowded[1], "site", ["at", "id"], 16).groupBy("site", "__part").count().orderBy(F.desc("count")).collect()
    assert sizes[0]["count"] < 3 * 3000 / 16

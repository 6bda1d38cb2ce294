"""The page and outreach operators on small inputs that the generated tables lack."""

import pytest
from pyspark.sql import functions as F

from leadmill.functions.text import normalised_email
from leadmill.operators import outreach, pages


def test_contact_links(spark):
    hrefs = [f'<a href="/n{k}">n</a>' for k in range(7)]
    named = ["/contact/", "/contact.html", "/contact-us", "/INQUIRY.php", "/form", "/about/otoiawase.html", "/x.php?a=1&amp;form=2"]
    html = (
        "".join(hrefs) + "".join(f"<a class='c' href='{h}'>x</a>" for h in named) + "<a href=/q>Get a <b>Quo</b>te</a><A HREF='/jp#top'>お問い合わせ</A><a href='/open'>not closed"
        + "<a href='https://other.example/contact'>contact</a><a href='mailto:a@b.cc'>contact</a><!-- <a href='/contact'>x</a> --><a href='#contact'>contact</a><a data-href='/no'>contact</a><a href='/the'>the</a><a href='/and'>and</a>"
    )
    got = pages.contact_links(spark.createDataFrame([(1, "https://h.example/dir/page", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    want = ["/contact/", "/contact.html", "/contact-us", "/INQUIRY.php", "/form", "/about/otoiawase.html", "/x.php?a=1&form=2", "/q", "/jp"]
    assert [r.target for r in got if r.is_priority] == [f"https://h.example{p}" for p in want]
    assert [r.target for r in got if not r.is_priority] == [f"https://h.example/n{k}" for k in range(5)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("info＠firma．jp", ["info@firma.jp"]), ("a [at] firma [dot] jp, b(at)firma.jp", ["a@firma.jp", "b@firma.jp"]), ("info&#64;firma&#46;jp", ["info@firma.jp"]), ("a@example.com b@sample.net", ["a@example.com", "b@sample.net"]),
        ("noreply@x.jp no-reply@x.jp a@test.de dummy@x.jp a@dummy.de placeholder@x.jp test@testing.de", []), ("03-1234-5678info@x.jp", ["info@x.jp"]), ("<a href='mailto:A.B@x.jp?subject=c'>", ["a.b@x.jp"]), ("a+b@x.jp 12@x.jp", ["a+b@x.jp", "12@x.jp"]),
    ],
)
def test_addresses(spark, text, want):
    got = pages.addresses(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").orderBy("pos").collect()
    assert [r.email for r in got] == want


@pytest.mark.parametrize("raw, want", [("mailto:Info（代表）＠x．jp?subject=y", "info@x.jp"), ("担当sales@x.jp", "sales@x.jp"), ("(info@x.jp)", "info@x.jp"), ("no sign", None)])
def test_normalised_email(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(normalised_email(F.col("raw"))).first()[0] == want


def test_mailable_and_history(spark):
    frame = lambda rows: spark.createDataFrame(rows, "email string, day string").select("email", F.col("day").cast("timestamp").alias("sent_at"))
    history = frame([("old@x.jp", "2023-12-31 12:00:00"), ("new@x.jp", "2024-01-10 00:00:00"), ("new@x.jp", "2023-01-01 00:00:00")])
    targets = spark.createDataFrame([("old@x.jp",), ("new@x.jp",), ("a@Example.com",), ("a@mail.example.com",), ("a@localhost",), ("",), (None,)], "email string")
    assert sorted(r.email for r in outreach.mailable(targets, history).collect()) == ["a@mail.example.com", "old@x.jp"]
    after = outreach.upserted_history(history, frame([("old@x.jp", "2024-01-30 00:00:00"), ("b@x.jp", "2024-01-01 00:00:00")]))
    assert {r.email: str(r.sent_at.date()) for r in after.collect()} == {"old@x.jp": "2024-01-30", "new@x.jp": "2024-01-10", "b@x.jp": "2024-01-01"}
    assert {r.email for r in outreach.evicted_history(after, older_than_days=25).collect()} == {"old@x.jp", "new@x.jp"} and outreach.evicted_history(after).count() == 0


def test_cap_of_the_day(spark):
    log = spark.createDataFrame([("2024-01-30 01:00:00", "success")] * 4 + [("2024-01-30 01:00:00", "failed"), ("2024-01-29 01:00:00", "success")], "at string, send_status string").select(F.col("at").cast("timestamp").alias("sent_at"), "send_status")
    rows = spark.range(50).select("id", (F.col("id") % 5).alias("segment"))
    assert [(r.id, r.place) for r in outreach.capped_today(rows, 10, "id", log).orderBy("id").collect()] == [(k, k + 1) for k in range(6)]
    assert outreach.capped_today(rows, 3, "id", log).count() == 0 and outreach.capped_today(rows, 10, "id", log.where("false")).count() == 10


def test_profiles_lists_and_footers(spark):
    rows = [(1, None), (2, ""), (3, "<p>no form</p>"), (4, "<form action='/search'>Find</form><FORM method=post class=contact action='/send?a=1&amp;b=2'>"), (5, "<form action=s><input type=submit value=Inquiry></form>"), (6, "<dl><dt>t<dd>one<dt>u<dd>two</dl><ul><li>three<li>four</ul><link rel=x>"), (7, "<p>" + "a" * 80 + "b" * 20)]
    frame = spark.createDataFrame([(i, "https://h.example/p/q", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.form_url.removeprefix("https://h.example"), r.form_method, r.crawl_status) for r in pages.site_profiles(frame).collect()}
    home = ("/p/q", "homepage_fallback", "success")
    assert got == {1: (*home[:2], "error"), 2: (*home[:2], "error"), 3: home, 4: ("/send?a=1&b=2", "basic_detector", "success"), 5: ("/p/s", "basic_detector", "success"), 6: home, 7: home}
    assert [r.item for r in pages.list_items(frame.where("page_id = 6")).orderBy("pos").collect()] == ["one", "two", "three", "four"]
    assert pages.sections(frame.where("page_id = 7")).first().footer == "b" * 20

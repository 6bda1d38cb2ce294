"""Column functions and operators against values written by hand."""

import pytest
from pyspark.sql import functions as F

from leadmill.functions import text
from leadmill.operators import companies, emails, forms, industry, merging, pages


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw, want", [("0312345678", "03-1234-5678"), ("(090) 1234 5678", "090-1234-5678"), ("+81 3123456789", "03-1234-56789"), ("123456789012", "1234-5678-9012"), ("1234567890123", "12345-6789-0123"), ("12345", "12345"), ("none", "none"), ("", ""), (None, None)])
def test_phones(spark, raw, want):
    assert one(spark, text.formatted_phone, raw) == want


@pytest.mark.parametrize("f, raw, want", [(text.formatted_address, " A B@x.jp", "ab@x.jp"), (text.formatted_person, " ann  LEE ", "Ann Lee"), (text.formatted_person, "山田  a", "山田 a"), (text.formatted_company, "acme co ltd", "Acme CO LTD"), (text.formatted_message, " a\r\n\r\n\r\rb ", "a\n\nb")])
def test_formats(spark, f, raw, want):
    assert one(spark, f, raw) == want


@pytest.mark.parametrize("url, want", [(" http://x.jp ", "http://x.jp"), ("x.jp/a", "https://x.jp/a"), ("https://x.jp", "https://x.jp"), (" nan", None), ("", None), (None, None)])
def test_cleaned_urls(spark, url, want):
    assert [r.url for r in pages.cleaned_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()] == [want] * (want is not None)


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("http://a.com/x/y?z=1", "?q=2", "http://a.com/x/y?q=2"), ("http://a.com/x/y", "../up", "http://a.com/up"), ("http://a.com/x/y", "../../../up", "http://a.com/up"), ("http://a.com/x/y", "./b/../c#f", "http://a.com/x/c"), ("http://a.com", "b", "http://a.com/b"), ("http://a.com/x/", "..", "http://a.com/"),
        ("http://a.com/x/y", "//b.com/z", "http://b.com/z"), ("http://a.com/x/y", "/z/./w", "http://a.com/z/w"), ("http://a.com/x/y", "mailto:a@b.c", None), ("http://a.com/x/y", "#top", None), ("http://a.com/x/y", "https://b.com/../q", "https://b.com/../q"), ("http://a.com/d/e.html?k=/v/", "f", "http://a.com/d/f"),
    ],
)
def test_joined_urls(spark, base, href, want):
    assert spark.createDataFrame([(base, href)], "b string, h string").select(pages.joined_url(F.col("b"), F.col("h")).alias("u")).first().u == want


@pytest.mark.parametrize("name, want", [("株式会社A", True), ("A", False), ("ab1", False), ("Acme", True), ("これは名前です", False), ("あ" * 31, False), ("一般社団法人" + "あ" * 40, True), ("一覧メニュー", False), ("東京から大阪まで", False), ("名。前", False), ("必須項目", False)])
def test_valid_names(spark, name, want):
    assert one(spark, companies.valid, name) is want


@pytest.mark.parametrize("label, want", [("会社名", 100), ("会 社 名", 100), ("貴社の会社名", 95), ("Company", 95), ("住所", None), ("団体", 85), ("団体概要", None), ("電話 (tel)", None), ("備考", None), ("", None)])
def test_label_boost(spark, label, want):
    assert one(spark, companies.label_boost, label) == want


@pytest.mark.parametrize("raw, want", [("株式会社山田 代表 山田太郎", "株式会社山田"), ("株式会社山田商店", "株式会社山田商店"), ("山田商店 代表", "山田商店 代表"), ("株式会社大田区センター", "株式会社大田")])
def test_unmixed(spark, raw, want):
    assert one(spark, companies.unmixed, raw) == want


def test_name_helpers(spark):
    assert one(spark, companies.clean, "ＡＢＣ　（株）\n x") == "ABC (株) x"
    assert one(spark, companies.without_seo, "山田不動産東京") == "山田不動産" and one(spark, companies.without_seo, "山田東京") == "山田"
    assert one(spark, companies.repaired, "株式会社".encode().decode("latin-1")) == "株式会社" and one(spark, companies.repaired, "Café") == "Café" and one(spark, companies.repaired, "abc") == "abc" and one(spark, companies.repaired, "漢é") == "漢é"
    assert one(spark, companies.completeness, "株式会社　山田　略称：Y（ワイ）・グループ") == 100 and one(spark, companies.completeness, "山田・商店") == 10


def page(spark, html, url="https://h.jp/"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


@pytest.mark.parametrize(
    "html, want",
    [
        ("<title>山田商店 | ようこそ</title><p>株式会社 山田商店へ</p>", ("株式会社山田商店", "title", 0.84)), ("<p>有限会社 有限会社 合同会社</p><footer>Copyright © 2024 山田商店街</footer>", ("有限会社山田商店街", "footer", 0.82)), ("<footer>Copyright (C) 山田オンライン All Rights Reserved</footer>", ("山田オンライン", "footer", 0.91)),
        ("<p>会社名：山田商店</p>", ("株式会社山田商店", "text_pattern_label", 0.82)), ("<table><tr><td>会社名<td>2019年6月3日</table>", None), ("<table><tr><td>住所<td>株式会社A</table>", None), ("<p>none</p>", None), ("<h1>弁護士法人八千代での相談なら</h1>", ("弁護士法人八千代", "h1_smart_split", 0.94)), ("<h1>名古屋の探偵事務所なら山田</h1>", ("株式会社名古屋", "business_name", 0.82)), ("<dl><dt>会社名 合同会社山田 代表 山田<dt>x</dl>", ("合同会社山田", "dt_merged", 0.97)), (None, None), ("", None),
    ],
)
def test_names(spark, html, want):
    rows = companies.completed(page(spark, html), companies.chosen(companies.candidates(page(spark, html)))).collect()
    assert [(r.company_name, r.method, r.confidence) for r in rows] == ([want] if want else [])


def test_ranked_addresses(spark):
    html = "<p>1@ b1@x.jp c2@x.jp</p><div><label>Mail</label><span>z9@h.jp</span></div><footer>c2@x.jp</footer><p>d@x.jp 10 items</p>"
    r = emails.ranked(page(spark, html)).first()
    assert (r.email, r.confidence, r.n_emails) == ("z9@h.jp", 0.72, 4) and r.candidates.split(",")[1] == "c2@x.jp:regex_plain:45"
    assert emails.ranked(page(spark, None)).count() == 0 == emails.ranked(page(spark, "no sign")).count()


@pytest.mark.parametrize("text, want", [("金融と銀行と病院", "finance"), ("病院 銀行", "finance"), ("it", None), ("", None), (None, None)])
def test_best_match(spark, text, want):
    assert one(spark, industry.best_match, text) == want


@pytest.mark.parametrize("text, want", [("冠婚葬祭業", "other_services"), ("製造業", "manufacturing"), ("農業", "農業"), ("なし", None), ("", None), (None, None)])
def test_mapped(spark, text, want):
    assert one(spark, industry.mapped, text) == want


@pytest.mark.parametrize("raw, want", [("「株式会社A」", "株式会社A"), ("株式会社A（東京）", "株式会社A"), ("N/A", None), ("[x] 有限会社B", "有限会社B"), ("`c`", "c"), ("", None), (None, None)])
def test_cleaned_values(spark, raw, want):
    assert one(spark, merging.cleaned_value, raw) == want
    assert one(spark, lambda c: merging.cleaned_value(c, rewrite=True), "有限会社B") == "株式会社B"


@pytest.mark.parametrize("html, want", [("grecaptcha.render(x)", "recaptcha_v2"), ("<script src='recaptcha/api.js?render=k'>", "recaptcha_v3"), ("hcaptcha", "hcaptcha"), ("<p>captcha</p><img>", "image"), ("captcha", None)])
def test_captcha(spark, html, want):
    assert one(spark, forms.captcha_type, html) == want


def test_forms_of_odd_pages(spark):
    for html in (None, "", "<form", "<form><form><input name=a required><select name='b'></form>", "<FORM ACTION='x'><INPUT NAME=Mail TYPE=EMAIL>"):
        rows = page(spark, html)
        assert forms.scored_forms(rows).count() >= 0 and forms.analysed_forms(rows).count() >= 0 and forms.multi_step(rows).count() >= 0
    assert [(r.name, r.required) for r in forms.form_fields(page(spark, "<form><form><input name=a required><select name='b'></form>")).orderBy("field_pos").collect()] == [("a", True), ("b", False)]

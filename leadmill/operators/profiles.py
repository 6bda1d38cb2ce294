"""The wide profile of company pages, its values as rows, and summaries of many profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions.structured import json_nodes, text_of
from leadmill.operators import companies, emails, forms, industry
from leadmill.operators.pages import crawl_status, host


def company_profiles(pages: DataFrame) -> DataFrame:
    """One row a page row: best address, name, industry and form with their confidences. Each is found and ranked within the row, so that
    nothing is joined or shuffled, repeated ids are rows like others, and the same expressions serve a stream. A page without html has none
    of them but the default industry."""
    html, url = F.col("html"), F.col("url")
    # one after the other: together they are too wide for generated code and take twice as long, and a filter on one of them would work it out again
    mailed = pages.select("page_id", "url", "html", F.explode(F.array(emails.best_in_row(html, url))).alias("mail"))
    named = mailed.select("page_id", "url", "html", "mail", F.explode(F.array(companies.best_in_row(html))).alias("name"))
    placed = named.select("page_id", "url", "html", "mail", "name", industry.best_in_row(html).alias("trade"))
    found = placed.select("page_id", "url", host(url).alias("host"), crawl_status(html).alias("crawl_status"), "mail", "name", "trade.industry", "trade.conf", forms.best_in_row(html, url).alias("form"))
    share = lambda points: points / F.lit(100.0)
    return found.select(
        "page_id", "host", "crawl_status", "mail.email", share(F.col("mail.score")).alias("email_confidence"), "name.company_name", share(F.col("name.conf")).alias("name_confidence"),
        F.coalesce("industry", F.lit(industry.DEFAULT)).alias("industry"), share(F.coalesce("conf", F.lit(30))).alias("industry_confidence"),
        F.col("url").alias("form_url"), F.when(F.col("form").isNotNull(), "enhanced_detector").otherwise("homepage_fallback").alias("form_method"),
    )


def values(profiles: DataFrame) -> DataFrame:
    """page_id, field, value, conf (hundredths) of the fields that a model can supply."""
    each = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.coalesce(F.round(100 * F.col(c)), F.lit(0)).cast("int").alias("conf")) for f, c in (("company_name", "name_confidence"), ("email", "email_confidence"), ("industry", "industry_confidence"))]
    return profiles.select("page_id", F.explode(F.array(*each)).alias("c")).select("page_id", "c.*")


def crawl_summary(profiles: DataFrame) -> DataFrame:
    """Counts and shares of all profiles, and of those found among successful ones, in one aggregate."""
    ok, failed = (F.count_if(F.col("crawl_status") == x) for x in ("success", "error"))
    n, skipped, forms_found = F.count("*"), F.count_if(F.col("crawl_status") == "skipped"), F.count_if(F.coalesce(F.col("form_url"), F.lit("")) != "")
    share = lambda part, of: F.round(100.0 * part / of, 1)
    found = {c: F.count(c) for c in ("email", "company_name")}
    return profiles.agg(
        n.alias("total"), ok.alias("successful"), share(ok, n).alias("successful_pct"), failed.alias("failed"), share(failed, n).alias("failed_pct"), skipped.alias("skipped"),
        forms_found.alias("forms_found"), share(forms_found, n).alias("forms_found_pct"), *[x.alias(f"{c}_found") for c, x in found.items()], *[share(x, ok).alias(f"{c}_pct") for c, x in found.items()],
        F.count_if(F.col("form_method") == "enhanced_detector").alias("forms_detected"), F.count_if(F.col("form_method") == "homepage_fallback").alias("forms_fallback"),
    )


def extraction_metrics(merged: DataFrame) -> DataFrame:
    """By field: values found, their mean confidence, model uses and the share of those that gave a value."""
    found, used = F.col("value").isNotNull(), F.col("used_model")
    rows = merged.groupBy("field").agg(F.count_if(found).alias("n_found"), F.sum(F.when(found, F.round(100 * F.col("confidence")).cast("long"))).alias("points"), F.count_if(used).alias("n_model"), F.count_if(used & found).alias("n_gave"))
    rate = F.round(100.0 * F.col("n_gave") / F.greatest("n_model", F.lit(1)), 1)
    return rows.select("field", "n_found", F.round(F.col("points") / F.col("n_found") / 100, 4).alias("mean_confidence"), "n_model", rate.alias("model_success_rate"))


def excerpts(pages: DataFrame) -> DataFrame:
    """What a model would be asked about a page: title, og title, headings, footer and body, each cut to its share."""
    html = F.col("html")
    title = H.inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))
    heads = F.array_join(F.transform(F.slice(H.every(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1", 1), 1, 3), lambda x: H.inner_text(x)), " ")
    parts = (("TITLE", title, 200), ("OG", H.meta_content(html, "og:title"), 200), ("H1", heads, 200), ("FOOTER", H.footer_text(html), 400), ("BODY", H.inner_text(H.outside_scripts(html), " "), 500))
    return pages.select("page_id", F.concat_ws("\n", *[F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.substring(x, 1, n))) for name, x, n in parts]).alias("excerpt"))


def shredded(pages: DataFrame) -> DataFrame:
    """page_id, kind, pos, label, value of the labelled parts of a page: table rows, definition pairs, siblings, headings and meta tags."""
    html = F.col("html")
    part = lambda kind, rows, label, value: F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("pos"), label(x).alias("label"), value(x).alias("value")))
    cells = F.filter(F.transform(F.flatten(F.transform(H.every(html, H.TABLE, 1), lambda t: H.every(t, H.ROW, 1))), lambda r: F.transform(H.every(r, H.CELL, 1), lambda x: H.inner_text(x))), lambda c: F.size(c) >= 2)
    a, b = lambda x: H.inner_text(x["a"]), lambda x: H.inner_text(x["b"])
    metas = F.filter(H.every(html, H.META), lambda t: H.attribute(t, "name|property") != "")
    rows = F.concat(
        part("table", cells, lambda c: c[0], lambda c: c[1]), part("dl", H.every_pair(html, H.PAIR, 1, 2), a, b), part("sibling", H.every_pair(html, H.SIBLINGS, 2, 4), a, b),
        part("heading", H.every_pair(html, H.HEADING, 1, 2), a, b), part("meta", metas, lambda t: H.attribute(t, "name|property"), lambda t: H.attribute(t, "content")),
    )
    return pages.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


def json_tree(pages: DataFrame) -> DataFrame:
    """page_id, block, path, key, kind, value of every scalar in the structured data of a page, at whatever depth; containers beyond the cap are
    given as JSON."""
    leaves = F.filter(json_nodes(F.col("html")), lambda x: ~x["kind"].isin("object", "array") | x["open"])
    rows = pages.select("page_id", F.explode(F.transform(leaves, lambda x: F.struct(x["block"], x["path"], x["key"], x["kind"], text_of(x["v"]).alias("value")))).alias("x"))
    return rows.select("page_id", "x.*")


def json_values(pages: DataFrame) -> DataFrame:
    """page_id, block, key, value of every string that is an object's value in the structured data of a page."""
    return json_tree(pages).where("kind = 'string' and key is not null").select("page_id", "block", "key", "value")

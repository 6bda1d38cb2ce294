"""Addresses of pages: nine detectors, normal form, score and ranking, in one pass over each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions.structured import strings_of_objects
from leadmill.functions.text import EMAIL, EMAILS, any_of, bound, listed, normalised_email, plain_signs, valid_email

#: Words that tell an address, those that raise its score, and the detectors' base scores. Fixed values.
KEYWORDS = ["email", "mail", "e-mail", "メール", "メールアドレス", "contact", "お問い合わせ", "連絡先", "電子メール", "eメール", "inquiry", "お問合せ"]
CONTEXT = ["mail", "email", "contact", "inquiry", "メール", "お問い合わせ", "連絡先"]
BASE = {"mailto_link": 45, "definition_list": 38, "label_value_pair": 37, "table_cell": 35, "list_item_email": 32, "regex_plain": 25, "text_scanning": 20, "dom_inspection": 30, "jsonld_schema": 35}
CONTACT_CLASS = r"""(?is)<(div|span)\s[^>]*class\s*=\s*["'][^"']*(?:email|contact)[^"']*["'][^>]*>(.*?)</\1\s*>"""
FOUND = "array<struct<method:string,raw:string,snippet:string>>"


def told(text: Column, words: list[str] = KEYWORDS) -> Column:
    return F.lower(text).rlike(any_of(words))


def snippet(text: Column, mail: Column, around: int = 50) -> Column:
    """The address with what stands around it."""
    start = lambda at: F.greatest(at - around, F.lit(1))
    shown = lambda at: F.trim(F.regexp_replace(F.substring(text, start(at), at + F.length(mail) + around - start(at)), r"\s+", " "))
    return bound(F.instr(F.lower(text), F.lower(mail)), lambda at: F.when(at > 0, shown(at)).otherwise(""))


def mails(method: str, text: Column, context: Column) -> Column:
    """The addresses of one text as candidates with a context."""
    found = bound(plain_signs(text), lambda t: F.when(F.contains(t, F.lit("@")), H.every(t, EMAILS)).otherwise(F.array().cast("array<string>")))  # most texts hold none
    return F.transform(found, lambda m: F.struct(F.lit(method).alias("method"), m.alias("raw"), context.alias("snippet")))


def detected(html: Column) -> Column:
    """The candidates of all detectors, in their order."""
    each = lambda units, of: F.flatten(F.transform(units, of))
    none = F.array().cast(FOUND)
    links = F.filter(H.every_pair(html, H.LINK, 1, 2), lambda x: F.lower(H.attribute(F.concat(F.lit(" "), x["a"]), "href")).startswith("mailto:"))
    pairs = H.every_pair(html, H.PAIR, 1, 2)
    siblings = H.every_pair(html, H.SIBLINGS, 2, 4)
    rows = F.transform(each(H.every(html, H.TABLE, 1), lambda t: H.every(t, H.ROW, 1)), lambda r: F.transform(H.every(r, H.CELL, 1), lambda x: H.inner_text(x)))
    said = lambda a, b: F.substring(F.concat(H.inner_text(a), F.lit(":"), b), 1, 150)
    labelled = lambda method, x: F.when(told(x["a"]), bound(H.inner_text(x["b"]), lambda b: mails(method, b, said(x["a"], b)))).otherwise(none)
    row = lambda c: F.when((F.size(c) >= 2) & told(F.get(c, F.lit(0))), mails("table_cell", F.get(c, F.lit(1)), F.concat(F.get(c, F.lit(0)), F.lit(": "), F.get(c, F.lit(1))))).otherwise(none)
    item = lambda t: F.when(told(t), mails("list_item_email", t, F.substring(t, 1, 150))).otherwise(none)
    plain = F.transform(mails("regex_plain", html, F.lit("")), lambda c: F.struct(c["method"], c["raw"], snippet(html, c["raw"]).alias("snippet")))
    json = F.filter(strings_of_objects(html), lambda v: v.rlike(f"^(?:{EMAIL})"))
    return F.concat(
        each(links, lambda x: F.slice(mails("mailto_link", H.attribute(F.concat(F.lit(" "), x["a"]), "href"), F.substring(H.inner_text(x["b"]), 1, 100)), 1, 1)),
        each(pairs, lambda x: labelled("definition_list", x)), each(siblings, lambda x: labelled("label_value_pair", x)),
        each(rows, lambda c: F.concat(row(c), each(c, lambda t: mails("table_cell", t, F.substring(t, 1, 150))))),
        each(F.transform(H.every(html, H.ITEM, 1), lambda x: H.inner_text(x)), item), plain,
        each(F.filter(H.lines(html), lambda x: F.length(x) >= 5), lambda x: mails("text_scanning", x, F.substring(x, 1, 100))),
        each(H.every(html, CONTACT_CLASS, 2), lambda t: mails("dom_inspection", H.inner_text(t), F.substring(H.inner_text(t), 1, 100))),
        each(json, lambda v: mails("jsonld_schema", v, F.lit(""))),
    )


def likely(html: Column) -> Column:
    """Whether a page can hold an address at all."""
    return F.contains(html, F.lit("@")) | F.rlike(html, F.lit("(?i)＠|&#|&commat;|at[\\])）]"))


def normalised(html: Column) -> Column:
    """The candidates with their addresses in normal form, null if a text holds none, and their places."""
    return F.transform(detected(html), lambda c, i: F.struct(normalised_email(c["raw"]).alias("email"), i.alias("pos"), c["method"].alias("method"), c["snippet"].alias("snippet")))


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, method, email, snippet of every address that a detector finds, normalised and valid; in order of discovery."""
    page = bound(F.col("html"), lambda html: F.struct(H.footer_text(html).alias("footer"), F.filter(normalised(html), lambda c: valid_email(c["email"])).alias("all")))
    # sorted out before the rows are made: Spark would work out a column again for a filter on it
    rows = pages.where(likely(F.col("html"))).select("page_id", "url", F.explode(F.array(page)).alias("x")).select("page_id", "url", "x.footer", F.explode("x.all").alias("c"))
    return rows.select("page_id", "url", "footer", "c.pos", "c.method", "c.email", "c.snippet")


def score_of(email: Column, method: Column, snippet: Column, url: Column, footer: Column) -> Column:
    """Points of an address by its detector, the footer, the page's domain and the words around it, at most 100."""
    domain = lambda x: F.regexp_replace(F.lower(x), r"^[w.]+", "")
    same = domain(F.element_at(F.split(email, "@"), -1)) == domain(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    base = F.element_at(F.create_map(*[F.lit(x) for p in BASE.items() for x in p]), method)
    words = bound(F.lower(snippet), lambda low: F.size(F.filter(listed(CONTEXT), lambda w: F.contains(low, w))))
    score = base + F.when(F.contains(F.lower(footer), email), 15).otherwise(0) + F.when(same, 30).otherwise(0) + F.least(F.lit(20), 5 * words)
    return F.least(score, F.lit(100)).cast("long")


def scored(found: DataFrame) -> DataFrame:
    """One row a page and address, as its first detector found it, with its score."""
    first = found.groupBy("page_id", "email").agg(F.min(F.struct("pos", "method", "snippet", "url", "footer")).alias("c")).select("page_id", "email", "c.*")
    score = score_of(*(F.col(c) for c in ("email", "method", "snippet", "url", "footer")))
    return first.select("page_id", "email", F.col("pos").cast("long").alias("pos"), "method", "snippet", score.alias("score"))


def best_in_row(html: Column, url: Column) -> Column:
    """The best address of one page as a struct(email, score), null if none: what ranked() finds, without leaving the row. Candidates stand in order of
    address and discovery, so that the first of each address is the one behind another address."""
    inside = lambda x: F.filter(x["all"], lambda c, i: (i == 0) | (F.get(x["all"], i - 1)["email"] != c["email"]))
    score = lambda c, x: score_of(c["email"], c["method"], c["snippet"], x["url"], x["footer"])
    ranks = lambda x: F.transform(inside(x), lambda c: F.struct(score(c, x).alias("score"), (-c["pos"]).alias("place"), c["email"].alias("email")))
    page = F.struct(F.array_sort(F.filter(F.when(likely(html), normalised(html)), lambda c: valid_email(c["email"]))).alias("all"), H.footer_text(html).alias("footer"), url.alias("url"))
    return bound(page, lambda x: F.array_max(ranks(x)))


def ranked(pages: DataFrame) -> DataFrame:
    """The best address of each page (highest score, then first found), how many there are, and all in rank order."""
    order = F.struct((-F.col("score")).alias("s"), "pos", "email", "method", "score")
    best = scored(candidates(pages)).groupBy("page_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    joined = F.array_join(F.transform("all", lambda c: F.concat_ws(":", c["email"], c["method"], c["score"].cast("string"))), ",")
    top = F.col("all")[0]
    return best.select("page_id", top["email"].alias("email"), top["method"].alias("method"), (top["score"] / F.lit(100.0)).alias("confidence"), F.size("all").cast("long").alias("n_emails"), joined.alias("candidates"))

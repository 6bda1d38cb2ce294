"""Page operators: status, URL parts, links, shredded sections, addresses and the wide profile row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.html import ITEM, attribute, inner_text
from leadmill.functions.text import EMAIL, bound, extract, normalised_email, plain_signs, valid_email, visible_text

def host(url: Column) -> Column:
    return extract(url, r"^https?://([^/?#]+)")


def url_parts(pages: DataFrame) -> DataFrame:
    """Origin, host, path and query (null if none)."""
    url = F.col("url")
    return pages.select("page_id", extract(url, r"^(https?://[^/?#]+)").alias("origin"), host(url).alias("host"), F.coalesce(extract(url, r"^https?://[^/?#]+([^?#]*)"), F.lit("/")).alias("path"), extract(url, r"^[^?#]*\?([^#]*)").alias("query"))


def cleaned_urls(pages: DataFrame) -> DataFrame:
    """Trimmed, with a scheme where there is none; empty ones dropped."""
    bare = F.trim("url")
    return pages.where((bare != "") & (F.lower(bare) != "nan")).select("page_id", F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare)).alias("url"))


def first_urls(pages: DataFrame, n: int) -> DataFrame:
    """The first n cleaned URLs, by page_id."""
    return cleaned_urls(pages).orderBy("page_id", "url").limit(n)


def excluded(pages: DataFrame, patterns: list[str]) -> DataFrame:
    """All rows, those with one of the patterns in their URL marked as skipped."""
    hit = F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.col("url"), p))
    return pages.select("page_id", "url", F.when(hit, "skipped").otherwise("pending").alias("crawl_status"))


def without_dots(path: Column) -> Column:
    """An absolute path with . and .. resolved; a closing . or .. leaves its folder."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))
    joined = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), tail), "/"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), joined).otherwise(path)


def joined_url(base: Column, href: Column) -> Column:
    """An absolute URL without fragment; null where the link leaves http."""
    return bound(F.struct(base.alias("base"), F.regexp_replace(F.trim(href), r"#.*$", "").alias("href")), lambda x: resolved(x["base"], x["href"]))


def resolved(base: Column, href: Column) -> Column:
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.coalesce(extract(base, r"^https?://[^/?#]+([^?#]*)"), F.lit("/"))
    query = F.regexp_extract(href, r"^[^?]*(\?.*)$", 1)
    relative = bound(F.regexp_extract(href, r"^([^?]*)", 1), lambda t: F.when(t.startswith("/"), t).otherwise(F.concat(F.regexp_replace(path, r"[^/]*$", ""), t)))
    return (
        F.when(href == "", None).when(href.rlike(r"^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(href.startswith("?"), F.concat(origin, path, href)).otherwise(F.concat(origin, bound(relative, without_dots), query))
    )


#: Paths and link texts that lead to contact forms, as the reference lists them. Fixed values.
CONTACT_PATHS = (
    r"(?i)(/contact/?$|/contact\.html?/?$|/contact\.php/?$|/contact-us/?$|/contact_us/?$|/contactus/?$|/inquiry[0-9]*/?$|/inquiry[0-9]*\.html?/?$|/inquiry[0-9]*\.php/?$|/inquire/?$"
    r"|/inquiry-form/?$|/inquiry_form/?$|/inquiryform/?$|/form/?$|/form\.html?/?$|/form\.php/?$|/form-contact/?$|/[^\s]*お問い合わせ[^\s]*/?$|/[^\s]*問い合わせ[^\s]*/?$|/[^\s]*otoiawase[^\s]*/?$"
    r"|/[^\s]*toiawase[^\s]*/?$|/[^\s]*soudan[^\s]*/?$|/[^\s]*\?.*(inquiry|contact|form|CNo|uid)[^\s]*$|/contents/[^\s]*(inquiry|contact)[^\s]*$|/menu/[^\s]*\.php$|/contact-form/?$|/contact_form/?$|/contactform/?$)"
)
CONTACT_TEXTS = (
    "お問い合わせ|お問合せ|問い合わせ|ご相談|相談|お申し込み|申込|資料請求|お見積り|見積もり|コンタクト|メッセージ|お問い合わせフォーム"
    "|contact|inquiry|inquire|message|reach out|get in touch|contact us|send message|request|consultation|quote|estimate"
)
#: An opening tag up to its '>', after its name; the value of its href, in quotes or bare.
IN_TAG = r"""^(?:[^>"']+|"[^"]*"|'[^']*')*"""
HREF = r"""(?i)(?:^|[\s"'])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))"""


def anchors_with_text(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, target, text (lower case) of each link outside comments and scripts, however its href is quoted."""
    html = F.regexp_replace("html", r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    href = lambda tag: F.replace(F.trim(F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)])), F.lit("&amp;"), F.lit("&"))
    inside = lambda piece, tag: F.regexp_extract(F.substring(piece, F.length(tag) + 2, F.length(piece)), r"(?is)^(.*?)(?:</a[\s>]|\z)", 1)
    text = lambda piece, tag: F.lower(F.trim(F.regexp_replace(inside(piece, tag), r"<[^>]*>", "")))
    link = lambda piece: bound(F.regexp_extract(piece, IN_TAG, 0), lambda tag: F.struct(joined_url(F.col("url"), href(tag)).alias("target"), text(piece, tag).alias("text")))
    # targets are made before the rows: Spark would work out a column again for a filter on it
    links = F.transform(F.slice(F.split(html, r"(?i)<a\s"), F.lit(2), F.lit(1 << 30)), link)
    return pages.select("page_id", "url", F.posexplode(links).alias("pos", "x")).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "x.target", "x.text")


def site_links(pages: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Distinct links of a page to its own host, however they are written, without those that hold one of the patterns."""
    own = anchors_with_text(pages).where(host(F.col("url")) == host(F.col("target")))
    for pattern in exclude:
        own = own.where(~F.contains("target", F.lit(pattern)))
    return own.select("page_id", "target").distinct()


def own_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, target, is_priority of each link to the page's own host: whether its path or text tells of contact."""
    own = anchors_with_text(pages).where(host(F.col("url")) == host(F.col("target")))
    likely = F.rlike(F.regexp_extract("target", r"^https?://[^/?#]+(.*)$", 1), F.lit(CONTACT_PATHS)) | F.rlike("text", F.lit(CONTACT_TEXTS))
    return own.select("page_id", "pos", "url", "target", likely.alias("is_priority"))


def contact_links(pages: DataFrame, others: int = 5) -> DataFrame:
    """The page's links to other pages of its host: those that tell of contact, and the first others of the rest."""
    links = own_links(pages).where(F.col("target") != F.regexp_replace("url", r"#.*$", "")).drop("url")
    order = F.row_number().over(Window.partitionBy("page_id", "is_priority").orderBy("pos"))
    return links.withColumn("rn", order).where(F.col("is_priority") | (F.col("rn") <= others)).select("page_id", "pos", "target", "is_priority")


def sections(pages: DataFrame, *more: Column) -> DataFrame:
    """Title, first heading, footer (without one, the last fifth of the visible text) and visible text. The html goes no further."""
    text = visible_text(F.col("html"))
    tail = F.when(~F.rlike("html", F.lit(r"(?i)<footer[\s>]")), F.substring(text, F.floor(F.length(text) * 0.8).cast("int") + 1, F.length(text)))
    return pages.select(
        "page_id", "url", extract(F.col("html"), r"(?is)<title[^>]*>(.*?)</title>").alias("title"), extract(F.col("html"), r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"),
        F.nullif(F.coalesce(tail, visible_text(F.regexp_extract("html", r"(?is)<footer[^>]*>(.*?)(?:</footer>|\z)", 1))), F.lit("")).alias("footer"), F.length(text).cast("long").alias("text_chars"), *more,
    )


def visible_texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", visible_text(F.col("html")).alias("text"))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, level, pos, heading: the first three h1, and every h2 and h3."""
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("&amp;"), F.lit("&")), r"[ \t\r\n]+", " "), r"<[^>]*>", ""))
    each = lambda n, most: F.transform(F.slice(F.regexp_extract_all("html", F.lit(rf"(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}\s*>"), F.lit(1)), 1, most), lambda x, i: F.struct(F.lit(n).cast("long").alias("level"), i.cast("long").alias("pos"), text(x).alias("heading")))
    rows = pages.select("page_id", F.explode(F.concat(each(1, 3), each(2, 1 << 30), each(3, 1 << 30))).alias("h"))
    return rows.select("page_id", "h.*")


def page_sections(pages: DataFrame) -> DataFrame:
    """Header and footer text and the texts of images in them, of pages with one or the other."""
    part = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}\s*>|\z)", 1)
    images = F.transform(F.regexp_extract_all(F.concat(part("header"), part("footer")), F.lit(r"(?i)<img\s[^>]*>"), F.lit(0)), lambda t: attribute(t, "alt"))
    rows = pages.where(F.rlike("html", F.lit(r"(?i)<(?:header|footer)[\s>]")))
    return rows.select("page_id", F.nullif(inner_text(part("header"), " "), F.lit("")).alias("header"), F.nullif(inner_text(part("footer"), " "), F.lit("")).alias("footer"), F.array_join(images, ", ").alias("images"))


def list_items(pages: DataFrame) -> DataFrame:
    """Items of lists and of definitions."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ITEM), F.lit(1))).alias("pos", "item"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), visible_text(F.col("item")).alias("item"))


def addresses(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Candidate addresses by place: key, email, pos; valid ones only, each once."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(plain_signs(F.col(text)), F.lit(EMAIL), F.lit(0))).alias("pos", "raw"))
    mail = found.select(key, "pos", normalised_email(F.col("raw")).alias("email")).where(valid_email(F.col("email")))
    return mail.groupBy(key, "email").agg(F.min("pos").cast("long").alias("pos"))


def best_address(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The first address of each text, and how many there are."""
    return addresses(texts, key, text).groupBy(key).agg(F.min_by("email", "pos").alias("email"), F.count("*").alias("n_emails"))


def copyright_of(footer: str) -> Column:
    return F.trim(F.regexp_extract(footer, r"(?:&copy;|©) *([^&]+)", 1))


def copyright_name(pages: DataFrame) -> DataFrame:
    """The name in the footer's copyright line."""
    return sections(pages).select("page_id", copyright_of("footer").alias("company_name")).where("company_name <> ''")


#: Words of inquiry forms, as the reference lists them. Fixed values.
INQUIRY = "contact|inquiry|consult|request|form|message|reach|get in touch|問い合わせ|相談|お問合せ|コンタクト|フォーム|メッセージ|連絡|お申し込み"


def form_action(html: Column) -> Column:
    """The action of the page's first inquiry form, by its text, id, class, name or buttons; null if there is none."""
    forms = F.regexp_extract_all(html, F.lit(r"(?is)<form\s[^>]*>.*?(?:</form\s*>|(?=<form[\s>])|\z)"), F.lit(0))
    tag = lambda f: F.regexp_extract(f, r"^<[^>]*>", 0)
    buttons = lambda f: F.transform(F.regexp_extract_all(f, F.lit(r"""(?i)<(?:input|button)\s[^>]*type\s*=\s*["']?(?:submit|button)[^>]*>"""), F.lit(0)), lambda b: attribute(b, "value"))
    said = lambda f: F.lower(F.concat_ws(" ", F.regexp_replace(f, r"<[^>]*>", ""), *[attribute(tag(f), n) for n in ("id", "class", "name")], buttons(f)))
    found = F.filter(forms, lambda f: (F.trim(attribute(tag(f), "action")) != "") & F.rlike(said(f), F.lit(INQUIRY)))
    return F.replace(attribute(tag(F.get(found, F.lit(0))), "action"), F.lit("&amp;"), F.lit("&"))


def crawl_status(html: Column) -> Column:
    """success where there is content, else error."""
    return F.when(F.coalesce(F.trim(html), F.lit("")) == "", "error").otherwise("success")


def statuses(responses: DataFrame) -> DataFrame:
    """Status of stored fetches (id, http_status, content): success with content and status 200, else error with its message."""
    ok = (F.col("http_status") == 200) & (F.coalesce(F.trim("content"), F.lit("")) != "")
    return responses.select("id", F.when(ok, "success").otherwise("error").alias("crawl_status"), F.when(~ok, F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))).alias("message"))


def site_profiles(pages: DataFrame) -> DataFrame:
    """One row a page row, in one pass: status, host, sections, first address, copyright name, and the form URL with its method."""
    action, url = form_action(F.col("html")), F.col("url")
    form = F.coalesce(F.when(action.isNotNull(), joined_url(url, action)), url)
    text = plain_signs(F.col("html"))
    mails = F.filter(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), normalised_email), valid_email)
    shred = sections(pages, form.alias("form_url"), F.when(action.isNotNull(), "basic_detector").otherwise("homepage_fallback").alias("form_method"), crawl_status(F.col("html")).alias("crawl_status"), F.get(mails, F.lit(0)).alias("email"))
    return shred.select("page_id", host(url).alias("host"), "title", "h1", "email", F.nullif(copyright_of("footer"), F.lit("")).alias("company_name"), "form_url", "form_method", "crawl_status")

"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import contacts, industry, outreach, pages
from leadmill.sources.tables import read_table, send_log

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str]] = {}


def add(name: str, table: str, operator: Callable[..., DataFrame], sql: str, **parameters) -> None:
    FOUND[name] = (lambda spark, d: operator(read_table(spark, d, table), **parameters), sql)


def add_log(name: str, operator: Callable[..., DataFrame], sql: str, **parameters) -> None:
    FOUND[name] = (lambda spark, d: operator(send_log(read_table(spark, d, "events")), **parameters), f"WITH log AS ({LOG}) {sql}")


LOG = """SELECT event_id AS id, user_id AS site, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'failed' WHEN 'error' THEN 'error' WHEN 'click' THEN 'captcha_blocked' WHEN 'signup' THEN 'queued' END AS send_status,
 CASE WHEN user_id % 3 = 0 THEN 'direct' WHEN user_id % 3 = 1 THEN 'browser' END AS mode, ts AS sent_at FROM events"""
HOST = r"nullif(regexp_extract({}, '^https?://([^/?#]+)', 1), '')"


def visible(x: str) -> str:
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>", r"(?s)<[^>]*>"):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


HREF = r"regexp_replace(trim(href), '#.*$', '')"
SECTIONS = rf"""SELECT page_id, url, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '') AS h1,
 nullif({visible("regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1)")}, '') AS footer, CAST(length({visible("html")}) AS BIGINT) AS text_chars FROM pages"""
NAME = r"trim(regexp_extract(footer, '(?:&copy;|©) *([^&]+)', 1))"


def mails(table: str, key: str, text: str) -> str:
    clean = r"lower(translate(trim(raw), '＠．', '@.'))"
    for a, b in ((r"^mailto:", ""), (r"\?.*$", ""), (r"[\[(]at[\])]", "@"), (r"[\[(]dot[\])]", ".")):
        clean = f"regexp_replace({clean}, '{a}', '{b}', 'g')"
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return rf"""SELECT {key}, email, CAST(min(pos) AS BIGINT) AS pos FROM (SELECT {key}, pos, {clean} AS email FROM (SELECT {key}, i - 1 AS pos, a[i] AS raw FROM (SELECT {key}, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{mail}', 0) AS a FROM {table}))))
 WHERE regexp_matches(email, '^{mail}$') AND NOT regexp_matches(email, 'test@test|@test[.]|noreply|no-reply|placeholder|dummy@|@dummy') GROUP BY ALL"""


BEST = "SELECT {0}, arg_min(email, pos) AS email, count(*) AS n_emails FROM ({1}) GROUP BY {0}"

add("u1_clean_urls", "pages", pages.cleaned_urls, r"SELECT page_id, CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url) ELSE 'https://' || trim(url) END AS url FROM pages WHERE trim(url) <> '' AND lower(trim(url)) <> 'nan'")
add("u3_first_urls", "pages", pages.first_urls, r"SELECT page_id, CASE WHEN url LIKE 'http%' THEN trim(url) ELSE 'https://' || trim(url) END AS url FROM pages WHERE trim(url) <> '' AND lower(trim(url)) <> 'nan' ORDER BY page_id, url LIMIT 100", n=100)
add("u2_exclude_patterns", "pages", pages.excluded, "SELECT page_id, url, CASE WHEN contains(url, 'm.') OR contains(url, '.net') THEN 'skipped' ELSE 'pending' END AS crawl_status FROM pages", patterns=["m.", ".net"])
add("u4_url_parts", "pages", pages.url_parts, rf"SELECT page_id, string_split(url, '/')[1] || '//' || {HOST.format('url')} AS origin, {HOST.format('url')} AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path, CASE WHEN contains(url, '?') THEN nullif(string_split(string_split(url, '?')[2], '#')[1], '') END AS query FROM pages")
IN_TAG, IN_HREF = (p.replace("'", "''") for p in (pages.IN_TAG, pages.HREF))
LINKS = rf"""SELECT page_id, pos, url, text, CASE WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || h WHEN h = '' THEN NULL WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h
 WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END AS target
 FROM (SELECT *, {HREF} AS h, lower(trim(regexp_replace(regexp_extract(substr(piece, length(tag) + 2), '(?is)^(.*?)(?:</a[\s>]|\z)', 1), '<[^>]*>', '', 'g'))) AS text
 FROM (SELECT *, replace(trim(regexp_extract(tag, '{IN_HREF}', 1) || regexp_extract(tag, '{IN_HREF}', 2) || regexp_extract(tag, '{IN_HREF}', 3)), '&amp;', '&') AS href
 FROM (SELECT page_id, url, i - 2 AS pos, a[i] AS piece, regexp_extract(a[i], '{IN_TAG}', 0) AS tag FROM (SELECT page_id, url, a, unnest(range(2, len(a) + 1)) AS i
 FROM (SELECT page_id, url, string_split_regex(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<a\s') AS a FROM pages)))))"""
add("u8_contact_links", "pages", pages.contact_links, f"SELECT page_id, pos, target, is_priority FROM (SELECT *, row_number() OVER (PARTITION BY page_id, is_priority ORDER BY pos) AS rn FROM (SELECT page_id, pos, target, regexp_matches(regexp_extract(target, '^https?://[^/?#]+(.*)$', 1), '{pages.CONTACT_PATHS}') OR regexp_matches(text, '{pages.CONTACT_TEXTS}') AS is_priority FROM ({LINKS}) WHERE {HOST.format('url')} = {HOST.format('target')} AND target <> regexp_replace(url, '#.*$', ''))) WHERE is_priority OR rn <= 5")
add("h1_h2_h10_sections", "pages", pages.sections, SECTIONS)
add("h7_list_items", "pages", pages.list_items, rf"SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, {visible('a[i]')} AS item FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS a FROM pages))")
add("e6_e12_page_addresses", "pages", pages.addresses, mails("pages", "page_id", "html"), key="page_id", text="html")
add("e7_e15_document_addresses", "documents", pages.addresses, mails("documents", "doc_id", "text"), key="doc_id", text="text")
add("e14_best_address", "documents", pages.best_address, BEST.format("doc_id", mails("documents", "doc_id", "text")), key="doc_id", text="text")
add("c11_copyright_name", "pages", pages.copyright_name, f"SELECT * FROM (SELECT page_id, {NAME} AS company_name FROM ({SECTIONS})) WHERE company_name <> ''")
add("b5_site_profiles", "pages", pages.site_profiles, f"SELECT s.page_id, {HOST.format('url')} AS host, title, h1, email, company_name, url AS form_url, CASE WHEN html ILIKE '%<form%' THEN 'basic_detector' ELSE 'homepage_fallback' END AS form_method, CASE WHEN coalesce(trim(html), '') = '' THEN 'error' ELSE 'success' END AS crawl_status FROM ({SECTIONS}) s JOIN (SELECT page_id, html FROM pages) USING (page_id) LEFT JOIN ({BEST.format('page_id', mails('pages', 'page_id', 'html'))}) m USING (page_id) LEFT JOIN (SELECT * FROM (SELECT page_id, {NAME} AS company_name FROM ({SECTIONS})) WHERE company_name <> '') n USING (page_id)")
DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
add("t1_phones", "documents", contacts.phones, rf"SELECT doc_id, phone, CASE length({DIGITS}) WHEN 10 THEN substr({DIGITS},1,2) || '-' || substr({DIGITS},3,4) || '-' || substr({DIGITS},7,4) WHEN 11 THEN substr({DIGITS},1,3) || '-' || substr({DIGITS},4,4) || '-' || substr({DIGITS},8,4) WHEN 12 THEN substr({DIGITS},1,4) || '-' || substr({DIGITS},5,4) || '-' || substr({DIGITS},9,4) ELSE phone END AS formatted FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\+?[0-9]*[ (-]+[0-9]{{3}}[) -]+[0-9]{{3}}-[0-9]{{4}}', 0)) AS phone FROM documents)")
add("t4_scripts", "documents", contacts.scripts, "SELECT doc_id, CAST(len(regexp_extract_all(text, '[぀-ヿ]')) AS BIGINT) AS n_kana, CAST(len(regexp_extract_all(text, '[一-鿿]')) AS BIGINT) AS n_ideographs, CAST(len(regexp_extract_all(text, '[À-ɏ]')) AS BIGINT) AS n_accented FROM documents")
add("i6_description_industry", "documents", industry.described, "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'tech|software|it') THEN 'technology' WHEN regexp_matches(lower(text), 'finance|banking|financial|investment') THEN 'finance' WHEN regexp_matches(lower(text), 'retail|shop|store|e-commerce') THEN 'retail' WHEN regexp_matches(lower(text), 'health|medical|hospital|clinic') THEN 'healthcare' WHEN regexp_matches(lower(text), 'education|school|university|learning') THEN 'education' WHEN regexp_matches(lower(text), 'manufacturing|factory|production') THEN 'manufacturing' END AS industry FROM documents", key="doc_id", text="text")
add_log("l1_latest_sends", outreach.latest_sends, "SELECT id, site, mode FROM (SELECT * FROM log WHERE send_status = 'success' ORDER BY sent_at DESC, id DESC LIMIT 50 OFFSET 10)", status="success", n=50, skip=10)
add_log("l3_statistics", outreach.status_statistics, "SELECT send_status, mode, count(*) AS n, round(100.0 * count(*) FILTER (send_status = 'success') / count(*), 2)::DOUBLE AS success_rate FROM log GROUP BY GROUPING SETS ((), (send_status), (mode)) HAVING grouping(mode) = 1 OR mode IS NOT NULL")
add_log("l4_sent_today", outreach.sent_today, "SELECT send_status, count(*) AS n FROM log WHERE CAST(sent_at AS DATE) = DATE '2024-01-30' GROUP BY 1")
LATEST = "SELECT site, send_status AS status, id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sent_at DESC, id DESC) AS rn FROM log) WHERE rn = 1"
add_log("q2_latest_state", outreach.latest_state, LATEST)
add_log("q3_state_shares", outreach.state_shares, f"SELECT status, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS share FROM (SELECT status, count(*) AS n FROM ({LATEST}) GROUP BY 1)")
add_log("u11_gap_violations", outreach.gaps, "SELECT * FROM (SELECT id, site, epoch_us(sent_at) - epoch_us(lag(sent_at) OVER (PARTITION BY site ORDER BY sent_at, id)) AS gap_us FROM log) WHERE gap_us < 3600000000", seconds=3600)
add_log("x3_hourly_counts", outreach.hourly_counts, "SELECT epoch_us(date_trunc('hour', sent_at)) AS hour_us, send_status, count(*) AS n FROM log GROUP BY 1, 2")
def every() -> dict[str, tuple[Query, str | None]]:
    from leadmill.plans import company_queries, site_queries, store_queries

    return FOUND | company_queries.FOUND | site_queries.FOUND | store_queries.FOUND


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in every().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in every().items() if s}

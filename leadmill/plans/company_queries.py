"""Registered queries over company pages, posts and replies that Spark derives from customers and events.

The SQL states what each derived row must give, from its key alone; it reads no html and shares nothing with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import companies, contacts, cooldown, emails, forms, industry, merging, outreach, pages, profiles, robots
from leadmill.plans.queries import LOG, visible
from leadmill.sources import derived
from leadmill.sources.tables import logged, read_table, send_log

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: Keys of the companies: k, as text s, the name n and the variants v (page), w (captcha, reply).
BASE = "WITH p AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, replace(c_name, '#', '') AS n, c_custkey % 8 AS v, (c_custkey // 8) % 4 AS w, c_mktsegment AS segment FROM customer)"
SITE = "'https://c' || s || '.example.jp'"


def add(name: str, source: Callable[[DataFrame], DataFrame], table: str, operator: Callable[..., DataFrame], sql: str | None, **parameters: object) -> None:
    FOUND[name] = (lambda spark, d: operator(source(read_table(spark, d, table)), **parameters), sql)


def add_pages(name: str, operator: Callable[..., DataFrame], sql: str, **parameters: object) -> None:
    add(name, derived.company_pages, "customer", operator, f"{BASE} {sql}", **parameters)


def planted(columns: str, rows: list[tuple], more: str = "") -> str:
    """Rows by variant: (v, values ...); {k} and {n} in texts stand for the key and the name. columns: the names after v."""
    names = [c.strip() for c in columns.split(",")]
    shown = lambda x: "NULL" if x is None else repr(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS {'DOUBLE' if isinstance(x, float) else 'BIGINT'})"
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    texts = [any(isinstance(r[i + 1], str) for r in rows) for i in range(len(names))]
    out = ", ".join((f"replace(replace({c}, '{{k}}', s), '{{n}}', n) AS {c}" if t else c) for c, t in zip(names, texts, strict=True))
    return f"SELECT k AS page_id, {out} FROM p JOIN (VALUES {values}) t(v, {', '.join(names)}) USING (v) {more}"


HOME = "https://c{k}.example.jp"
RANKED = [
    (0, "info{k}@s{k}.example.jp", "label_value_pair", 0.42, 2, "info{k}@s{k}.example.jp:label_value_pair:42,x{k}@cell.example.jp:table_cell:35"), (1, "info{k}@s{k}.example.jp", "definition_list", 0.43, 2, "info{k}@s{k}.example.jp:definition_list:43,li{k}@list.example.jp:list_item_email:37"),
    (2, "ld{k}@ld.example.jp", "regex_plain", 0.4, 1, "ld{k}@ld.example.jp:regex_plain:40"), (3, "sp{k}@c{k}.example.jp", "label_value_pair", 0.72, 1, "sp{k}@c{k}.example.jp:label_value_pair:72"),
    (5, "sales{k}@m.example.jp", "mailto_link", 0.45, 2, "sales{k}@m.example.jp:mailto_link:45,box{k}@box.example.jp:regex_plain:30"), (6, "foot{k}@foot.example.jp", "regex_plain", 0.4, 1, "foot{k}@foot.example.jp:regex_plain:40"),
]
DETECTED = [(v, m, e) for v, e, ms in [
    (0, "info{k}@s{k}.example.jp", "label_value_pair table_cell regex_plain text_scanning"), (0, "x{k}@cell.example.jp", "table_cell regex_plain text_scanning"), (1, "info{k}@s{k}.example.jp", "definition_list regex_plain text_scanning"),
    (1, "li{k}@list.example.jp", "list_item_email regex_plain text_scanning"), (2, "ld{k}@ld.example.jp", "regex_plain jsonld_schema"), (3, "sp{k}@c{k}.example.jp", "label_value_pair regex_plain text_scanning"),
    (5, "sales{k}@m.example.jp", "mailto_link regex_plain"), (5, "box{k}@box.example.jp", "regex_plain text_scanning dom_inspection"), (6, "foot{k}@foot.example.jp", "regex_plain text_scanning"),
] for m in ms.split()]
add_pages("e1_e9_detectors", lambda p: emails.candidates(p).select("page_id", "method", "email").distinct(), planted("method, email", DETECTED))
add_pages("e12_e14_ranked_addresses", emails.ranked, planted("email, method, confidence, n_emails, candidates", RANKED))
CONTEXT = planted("email, snippet", [
    (0, "info{k}@s{k}.example.jp", "メール:info{k}＠s{k}．example．jp"), (0, "x{k}@cell.example.jp", "x{k}@cell.example.jp"), (1, "info{k}@s{k}.example.jp", "メール:info{k}@s{k}.example.jp"),
    (1, "li{k}@list.example.jp", "contact: li{k}@list.example.jp"), (2, "ld{k}@ld.example.jp", '{six}","industry":"金融","contactPoint":[{"email":"ld{k}@ld.example.jp"}]}</script></head><body><p>Welcome to our site</'),
    (3, "sp{k}@c{k}.example.jp", "お問い合わせ:sp{k}@c{k}.example.jp"), (5, "sales{k}@m.example.jp", "営業"),
    (5, "box{k}@box.example.jp", 'length in this place</p><div class="contact-box">box{k}@box.example.jp</div><p>The end of it all, which is also told at'),
    (6, "foot{k}@foot.example.jp", 'ooter><img src="f.png" alt="{n}事務所">foot{k}@foot.example.jp</footer></body></html>'),
])
add_pages("e16_context", lambda p: emails.scored(emails.candidates(p)).select("page_id", "email", "snippet"), f"SELECT page_id, email, replace(snippet, '{{six}}', lpad(CAST(page_id % 1000000 AS VARCHAR), 6, '0')) AS snippet FROM ({CONTEXT})")

add_pages("h3_h5_h6_h9_labels", lambda p: profiles.shredded(p).where("kind <> 'heading'"), planted("kind, pos, label, value", [
    (0, "table", 0, "会社名", "株式会社{n}"), (0, "table", 1, "メール", "info{k}＠s{k}．example．jp"), (0, "table", 2, "備考", "x{k}@cell.example.jp"), (0, "sibling", 0, "会社名", "株式会社{n}"), (0, "sibling", 1, "メール", "info{k}＠s{k}．example．jp"), (0, "sibling", 2, "備考", "x{k}@cell.example.jp"),
    (1, "dl", 0, "商号", "合同会社{n}"), (1, "dl", 1, "メール", "info{k}@s{k}.example.jp"), (3, "sibling", 0, "お問い合わせ", "sp{k}@c{k}.example.jp"), (3, "meta", 0, "og:site_name", "株式会社{n} | Official"), (3, "meta", 1, "description", "病院とクリニックの情報システム"), (3, "meta", 2, "keywords", "物流"), (4, "meta", 0, "csrf-param", "m{k}"),
    (5, "sibling", 0, "box{k}@box.example.jp", "The end of it all, which is also told at length"), (6, "sibling", 0, "協会{n}", "■会社名 株式会社{n}■所在地 東京"),
]))
add_pages("h8_headings", lambda p: profiles.shredded(p).where("kind = 'heading'").select("page_id", "label", "value"), planted("label, value", [(1, "h2", "About"), (6, "h2", "団体名")]))
add_pages("h4_json_values", profiles.json_values, planted("block, key, value", [(2, 0, "@type", "Organization"), (2, 0, "name", "株式会社{n}"), (2, 0, "industry", "金融"), (2, 0, "email", "ld{k}@ld.example.jp")]))
#: By variant: title, first heading, footer (null: the last fifth of the text), text.
TOLD = planted("title, h1, footer, body", [
    (0, "株式会社{n} | 会社概要", "会社概要", "Copyright © 2024 株式会社{n} All Rights Reserved", "株式会社{n} | 会社概要 会社概要 会社名 株式会社{n} メール info{k}＠s{k}．example．jp 備考 x{k}@cell.example.jp Copyright © 2024 株式会社{n} All Rights Reserved"),
    (1, "Profile", None, "Since 2001", "Profile About 商号 合同会社{n} メール info{k}@s{k}.example.jp contact: li{k}@list.example.jp Open daily Since 2001"),
    (2, "Home", None, None, "Home Welcome to our site"), (3, "{n} Home", "Start", None, "{n} Home Open house Start お問い合わせ sp{k}@c{k}.example.jp"), (4, "Write to us", None, None, "Write to us お名前 Mail Tel 会社 Text"),
    (5, "Members", None, None, "Members Login News of the year and other things that are told at some length here 営業 Opening hours and further notes, again told at some length in this place box{k}@box.example.jp The end of it all, which is also told at length"),
    (6, "Guide", "税理士法人{n}｜会社概要", "foot{k}@foot.example.jp", "Guide 税理士法人{n}｜会社概要 団体名 協会{n} ■会社名 株式会社{n} ■所在地 東京 foot{k}@foot.example.jp"), (7, "Ask", None, None, "Ask Step 1 of 3 Next Ask お問い合わせ"),
])
add_pages("h12_excerpts", profiles.excerpts, f"""SELECT page_id, 'TITLE: ' || title || coalesce(chr(10) || 'H1: ' || h1, '') || chr(10) || 'FOOTER: ' || coalesce(footer, trim(substr(body, CAST(floor(length(body) * 0.8) AS BIGINT) + 1))) || chr(10) || 'BODY: ' || body AS excerpt FROM ({TOLD})""")

add_pages("h11_a2_form_fields", forms.form_fields, planted("pos, field_pos, name, type, required, purpose", [
    (4, 0, 0, "yourname", "text", True, "name"), (4, 0, 1, "mail", "email", True, "email"), (4, 0, 2, "tel", "tel", False, "phone"), (4, 0, 3, "company", "text", False, "company"), (4, 0, 4, "body", "text", False, "unknown"),
    (5, 0, 0, "user", "text", False, "unknown"), (5, 0, 1, "password", "password", False, "unknown"), (7, 0, 0, "q1", "text", False, "unknown"), (7, 0, 1, "memo", "text", False, "unknown"),
]))
add_pages("f1_basic_forms", forms.basic_forms, planted("form_url", [(4, HOME + "/send?a=1"), (7, HOME + "/contact")]))
add_pages("f2_ladder_forms", forms.ladder_forms, f"SELECT 'c' || s || '.example.jp' AS site, 'top_priority_fallback' AS level, {SITE} || '/contact' AS form_url FROM p WHERE v = 4")
add_pages("f3_parameter_links", forms.parameter_links, planted("target", [(7, HOME + "/ask?form=2")]))
add_pages("f4_f7_f10_scored_forms", forms.scored_forms, planted("url, pos, method, detection, n_required, n_text, n_keywords, button, score, remark", [
    (4, HOME + "/contact", 0, "POST", "pattern_match", 2, 4, 0, "送信", 100, "Fields: email, phone, name, message; Method: pattern_match; Score: 1.00; Button: '送信'"), (7, HOME + "/", 0, "GET", "crawl", 0, 2, 0, "Next", 18, "Method: crawl; Score: 0.18; Button: 'Next'"),
]))
add_pages("f8_best_forms", forms.best_forms, f"SELECT 'c' || s || '.example.jp' AS site, {SITE} || CASE v WHEN 4 THEN '/contact' ELSE '/' END AS form_url, CASE v WHEN 4 THEN 1.0 ELSE 0.18 END::DOUBLE AS score, CASE v WHEN 4 THEN 'pattern_match' ELSE 'crawl' END AS detection, s || ':0:' || CASE v WHEN 4 THEN '100' ELSE '18' END AS candidates FROM p WHERE v IN (4, 7)")
CAPTCHA = "(['recaptcha_v2', 'recaptcha_v3', 'hcaptcha', 'image'])[w + 1]"
add_pages("a1_a4_a8_form_analysis", forms.analysed_forms, f"SELECT k AS page_id, CAST(0 AS BIGINT) AS pos, CASE v WHEN 4 THEN {SITE} || '/send?a=1' WHEN 5 THEN {SITE} || '/login' ELSE '' END AS action, 'POST' AS method, CASE v WHEN 4 THEN 'csrf_token=tok' || s ELSE '' END AS hidden, CASE v WHEN 7 THEN {CAPTCHA} END AS captcha, CASE v WHEN 7 THEN 'ajax' ELSE 'standard' END AS submission, CAST(CASE v WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS n_required, CASE v WHEN 4 THEN 1.0 WHEN 5 THEN 0.6 ELSE 0.05 END::DOUBLE AS confidence FROM p WHERE v IN (4, 5, 7)")
add_pages("a5_ajax_endpoints", forms.ajax_endpoints, planted("n_indicators, endpoint", [(7, 1, HOME + "/api/x{k}")]))
add_pages("a6_csrf_tokens", forms.csrf_tokens, planted("place, name, value", [(4, "hidden", "csrf_token", "tok{k}"), (4, "meta", "csrf-param", "m{k}")]))
add_pages("a7_multi_step", forms.multi_step, planted("current_step, total_steps, indicators", [(7, 1, 3, "Step indicator: 1/3; Next/Continue button")]))

NAMES = [
    (0, "title", "株式会社{n}", 88, True), (0, "table_field", "株式会社{n}", 99, True), (0, "footer", "株式会社{n}", 94, True), (1, "dl_field", "合同会社{n}", 98, True), (2, "json_ld", "株式会社{n}", 96, True), (3, "meta_tag", "株式会社{n}", 95, True),
    (6, "semantic_pair", "協会{n}", 97, False), (6, "black_square", "株式会社{n}", 97, True), (6, "footer_img", "{n}事務所", 92, False), (6, "h1_smart_split", "税理士法人{n}", 94, True),
    (0, "explicit_label", "株式会社{n}", 93, True), (1, "explicit_label", "合同会社{n}", 93, True), (6, "img_alt", "{n}事務所", 89, False), (0, "title_intro", "株式会社{n}", 90, True), (6, "title_intro", "法人{n}", 90, False),
]
CHOSEN = [(0, "株式会社{n}", "table_field", 0.99), (1, "合同会社{n}", "dl_field", 0.98), (2, "株式会社{n}", "json_ld", 0.96), (3, "株式会社{n}", "meta_tag", 0.95), (6, "協会{n}", "semantic_pair", 0.97)]
add_pages("c1_c18_name_candidates", lambda p: companies.candidates(p).drop("pos"), planted("method, name, conf, legal", NAMES))
add_pages("c24_c26_company_names", lambda p: companies.completed(p, companies.chosen(companies.candidates(p))).drop("completed"), planted("company_name, method, confidence", CHOSEN))
add_pages("c9_info_page_names", lambda p: companies.info_page_names(p, companies.candidates(p)), f"SELECT k AS page_id, 'c' || s || '.example.jp' AS site, CASE v WHEN 0 THEN '株式会社' ELSE '合同会社' END || n AS name, CAST(1 AS BIGINT) AS n_pages FROM p WHERE v IN (0, 1)")
add_pages("c28_basic_names", companies.basic_names, planted("name", [(0, "株式会社{n}"), (1, "Profile"), (2, "Home"), (3, "{n} Home"), (4, "Write to us"), (5, "Members"), (6, "Guide"), (7, "Ask")]))
add_pages("i2_i4_industries", industry.page_industries, planted("source, industry, confidence", [(2, "jsonld", "金融", 0.9), (3, "metadata", "医療・ヘルスケア", 0.8), (3, "text", "医療・ヘルスケア", 0.6), (6, "text", "会計・税務", 0.6)]))
add_pages("i5_best_industry", industry.best_industries, planted("industry, source, confidence", [(v, *{2: ("金融", "jsonld", 0.9), 3: ("医療・ヘルスケア", "metadata", 0.8), 6: ("会計・税務", "text", 0.6)}.get(v, ("その他サービス", "fallback", 0.3))) for v in range(8)]))
PROFILE = "SELECT k AS page_id, 'c' || s || '.example.jp' AS host, 'success' AS crawl_status, m.email, m.email_confidence, c.company_name, c.name_confidence, i.industry, i.industry_confidence, " + SITE + """ || CASE v WHEN 0 THEN '/company' WHEN 1 THEN '/about.html' WHEN 4 THEN '/contact' ELSE '/' END AS form_url, CASE WHEN v IN (4, 7) THEN 'enhanced_detector' ELSE 'homepage_fallback' END AS form_method FROM p
 LEFT JOIN ({}) m ON m.page_id = k LEFT JOIN ({}) c ON c.page_id = k LEFT JOIN ({}) i ON i.page_id = k""".format(
    planted("email, email_confidence", [(v, e, c) for v, e, _, c, _, _ in RANKED]), planted("company_name, name_confidence", [(v, n, c) for v, n, _, c in CHOSEN]),
    planted("industry, industry_confidence", [(v, *{2: ("金融", 0.9), 3: ("医療・ヘルスケア", 0.8), 6: ("会計・税務", 0.6)}.get(v, ("その他サービス", 0.3))) for v in range(8)]),
)
add_pages("b5_company_profiles", profiles.company_profiles, PROFILE)
add_pages("b1_b2_crawl_summary", lambda p: profiles.crawl_summary(profiles.company_profiles(p)), f"SELECT count(*) AS total, count(*) AS successful, 100.0::DOUBLE AS successful_pct, CAST(0 AS BIGINT) AS failed, 0.0::DOUBLE AS failed_pct, CAST(0 AS BIGINT) AS skipped, count(*) AS forms_found, 100.0::DOUBLE AS forms_found_pct, count(email) AS email_found, count(company_name) AS company_name_found, round(100.0 * count(email) / count(*), 1)::DOUBLE AS email_pct, round(100.0 * count(company_name) / count(*), 1)::DOUBLE AS company_name_pct, count(*) FILTER (form_method = 'enhanced_detector') AS forms_detected, count(*) FILTER (form_method = 'homepage_fallback') AS forms_fallback FROM ({PROFILE})")
add_pages("k7_form_targets", lambda p: outreach.form_targets(profiles.company_profiles(p), skip_with_email=True), f"SELECT page_id, CASE WHEN company_name IS NULL OR email IS NOT NULL THEN 'skip' ELSE 'submit' END AS decision, CASE WHEN company_name IS NULL THEN 'no company name' WHEN email IS NOT NULL THEN 'has email' END AS reason FROM ({PROFILE})")
add_pages("k4_k5_recipients", lambda p: outreach.recipients(profiles.company_profiles(p), "To {company_name}", "Dear {{company_name}}, this is for {email}."), f"SELECT page_id, email, coalesce(company_name, '御社') AS company_name, 'To ' || coalesce(company_name, '御社') AS subject, 'Dear ' || coalesce(company_name, '御社') || ', this is for ' || email || '.' AS body FROM ({PROFILE}) WHERE email IS NOT NULL")
add_pages("u10_polite_times", outreach.polite_times, "SELECT k AS page_id, 'c' || s || '.example.jp' AS site, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') AS BIGINT) AS at_seconds FROM p", gap_seconds=2)
FOUND["h1_visible_text"] = (lambda spark, d: pages.visible_texts(read_table(spark, d, "pages")), f"SELECT page_id, {visible('html')} AS text FROM pages")
FOUND["h2_headings"] = (lambda spark, d: pages.headings(read_table(spark, d, "pages")), "SELECT page_id, 1::BIGINT AS level, 0::BIGINT AS pos, trim(regexp_replace(regexp_replace(regexp_replace(string_split(string_split(html, '<h1>')[2], '</h1>')[1], '&amp;', '&', 'g'), '[ \t\r\n]+', ' ', 'g'), '<[^>]*>', '', 'g')) AS heading FROM pages")
add_pages("h10_sections", pages.page_sections, planted("header, footer, images", [(0, None, "Copyright © 2024 株式会社{n} All Rights Reserved", ""), (1, None, "Since 2001", ""), (3, "Open house", None, ""), (6, None, "foot{k}@foot.example.jp", "{n}事務所")]))
add_pages("c27_sure_completion", lambda p: p.select("page_id", companies.surely_completed(F.col("html"), F.lit("協会")).alias("near"), companies.surely_completed(F.col("html"), F.lit("所在地")).alias("none")), "SELECT k AS page_id, CASE WHEN v IN (0, 6) THEN '株式会社協会' END AS near, CASE WHEN v IN (0, 6) THEN '株式会社所在地' END AS none FROM p")
FOUND["u10_site_times"] = (lambda spark, d: outreach.polite_times(read_table(spark, d, "pages"), 10), "SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS site, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') + 10 * (row_number() OVER (PARTITION BY split_part(split_part(url, '//', 2), '/', 1) ORDER BY page_id) - 1) AS BIGINT) AS at_seconds FROM pages")


def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer")
    return robots.allowed(derived.company_pages(customers), derived.robots_rules(customers))


FOUND["u6_allowed"] = (u6, f"{BASE} SELECT k AS page_id, NOT (k % 4 <> 3 AND v IN (0, 1)) AS allowed FROM p")


def replies(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: operator(derived.model_replies(read_table(spark, d, "customer")))


URL = f"{SITE} || '/' AS url"
FOUND["m2_m5_m6_labelled_replies"] = (replies(merging.from_labels), f"{BASE} SELECT {URL}, CASE k % 4 WHEN 0 THEN '株式会社' || n END AS company_name, CASE k % 4 WHEN 0 THEN 'info' || s || '@r.example.jp' WHEN 1 THEN 'json' || s || '@r.example.jp' WHEN 3 THEN 'free' || s || '@r.example.jp' END AS email, CASE k % 4 WHEN 0 THEN '金融業' END AS industry FROM p")
FOUND["m3_json_replies"] = (replies(merging.from_json), f"{BASE} SELECT {URL}, field, CASE field WHEN 'company_name' THEN '有限会社' || n WHEN 'email' THEN 'json' || s || '@r.example.jp' ELSE 'IT' END AS value, CASE field WHEN 'company_name' THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, CASE field WHEN 'company_name' THEN 'page' ELSE 'ai' END AS source FROM p CROSS JOIN (VALUES ('company_name'), ('email'), ('industry')) f(field) WHERE k % 4 = 1")
FOUND["m4_line_replies"] = (replies(merging.from_lines), f"{BASE} SELECT {URL}, '合同会社' || n AS company_name, 0.75::DOUBLE AS confidence, 'footer' AS source FROM p WHERE k % 4 = 2")
FOUND["i7_mapped_industries"] = (replies(lambda r: merging.from_labels(r).select("url", industry.mapped(F.col("industry")).alias("industry"))), f"{BASE} SELECT {URL}, CASE k % 4 WHEN 0 THEN 'finance' END AS industry FROM p")
FOUND["m8_reply_cache"] = (replies(lambda r: merging.cached(r, r, outreach.AS_OF)), f"{BASE} SELECT {URL}, CASE WHEN k % 48 < 24 THEN k % 48 END AS age_hours FROM p")


def values_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.values(profiles.company_profiles(derived.company_pages(read_table(spark, sf_dir, "customer"))))


def merged_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merged(values_of(spark, sf_dir), derived.model_replies(read_table(spark, sf_dir, "customer")))


#: By variant and field: the rule's value and hundredths, the model's value and hundredths.
MERGE = f"""{BASE}, rules AS (SELECT page_id, unnest(['company_name', 'email', 'industry']) AS field, unnest([company_name, email, industry]) AS value, unnest([coalesce(round(100 * name_confidence), 0), coalesce(round(100 * email_confidence), 0), round(100 * industry_confidence)])::BIGINT AS conf FROM ({PROFILE})),
 models AS (SELECT k AS page_id, field, CASE field WHEN 'company_name' THEN CASE v % 4 WHEN 0 THEN '株式会社' || n WHEN 1 THEN '有限会社' || n END WHEN 'email' THEN CASE v % 4 WHEN 0 THEN 'info' || s || '@r.example.jp' WHEN 1 THEN 'json' || s || '@r.example.jp' WHEN 3 THEN 'free' || s || '@r.example.jp' END ELSE CASE v % 4 WHEN 0 THEN '金融業' WHEN 1 THEN 'IT' END END AS m,
 CASE field WHEN 'company_name' THEN 85 WHEN 'email' THEN CASE v % 4 WHEN 1 THEN 80 ELSE 85 END ELSE 80 END AS m_conf FROM p CROSS JOIN (VALUES ('company_name'), ('email'), ('industry')) f(field)),
 merged AS (SELECT page_id, field, CASE WHEN sure OR m IS NULL THEN value ELSE m END AS value, CASE WHEN sure THEN conf WHEN m IS NOT NULL THEN m_conf WHEN value IS NOT NULL THEN least(conf, 70) ELSE 0 END / 100.0::DOUBLE AS confidence, NOT sure AND m IS NOT NULL AS used_model FROM (SELECT *, value IS NOT NULL AND conf >= CASE field WHEN 'email' THEN 50 ELSE 60 END AS sure FROM rules JOIN models USING (page_id, field)))"""
FOUND["m1_requests"] = (lambda spark, d: merging.requests(values_of(spark, d)), f"{MERGE} SELECT page_id, field, value, CAST(conf AS INTEGER) AS conf FROM rules WHERE value IS NULL OR conf < CASE field WHEN 'email' THEN 50 ELSE 60 END")
FOUND["m7_merged_values"] = (merged_of, f"{MERGE} SELECT * FROM merged")
FOUND["m9_model_fields"] = (lambda spark, d: merging.model_fields(merged_of(spark, d)), f"{MERGE} SELECT page_id, string_agg(field, ',' ORDER BY field) AS fields FROM merged WHERE used_model GROUP BY 1")
FOUND["b3_extraction_metrics"] = (lambda spark, d: profiles.extraction_metrics(merged_of(spark, d)), f"{MERGE} SELECT field, count(value) AS n_found, round(sum(round(100 * confidence)) FILTER (value IS NOT NULL) / count(value) / 100, 4)::DOUBLE AS mean_confidence, count(*) FILTER (used_model) AS n_model, CASE WHEN bool_or(used_model) THEN 100.0 ELSE 0.0 END::DOUBLE AS model_success_rate FROM merged GROUP BY 1")

add("v1_v2_outcomes", derived.form_responses, "events", forms.outcomes, "SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 0.75 WHEN 'click' THEN 0.4 WHEN 'signup' THEN 0.35 ELSE 0.0 END::DOUBLE AS confidence, event_type IN ('purchase', 'click', 'signup') AS success, CASE event_type WHEN 'view' THEN 'Validation error detected; Form still present on same page' WHEN 'error' THEN 'Error keywords: error, invalid; Form on error page' WHEN 'signup' THEN 'Form still present' ELSE '' END AS warnings, event_type = 'purchase' AS strict_success, CASE event_type WHEN 'purchase' THEN 'HTTP 200; URL changed; Success URL pattern: /thanks?; Success keywords: thank you' WHEN 'view' THEN 'HTTP 200' WHEN 'error' THEN 'HTTP 500 (error); URL changed' WHEN 'click' THEN 'HTTP 302 (redirect); Success keywords: 完了, お問い合わせ' ELSE 'HTTP 200; URL changed' END AS indicators FROM events")
KIND = "CASE user_id % 5 WHEN 0 THEN 'recaptcha_v2' WHEN 1 THEN 'recaptcha_v3' WHEN 2 THEN 'hcaptcha' WHEN 3 THEN 'image' ELSE 'unknown' END"
POSTED = "'https://h' || user_id || '.example.jp/contact'"
add("v3_captcha_routing", derived.form_responses, "events", forms.captcha_routing, f"SELECT event_id AS id, {POSTED} AS url, CASE event_type WHEN 'click' THEN 'captcha_blocked' ELSE 'failed' END AS status, CASE event_type WHEN 'click' THEN {KIND} END AS captcha FROM events WHERE event_type IN ('click', 'error')")
add("q1_q4_review_queue", derived.form_responses, "events", lambda r: forms.latest_queue(forms.review_queue(r)), f"SELECT max(event_id) AS id, {POSTED} AS form_url, {KIND} AS captcha, 'pending' AS status, 'CAPTCHA detected (' || {KIND} || ') - queued for manual handling' AS notes FROM events WHERE event_type = 'click' GROUP BY user_id")
add("s6_statuses", derived.form_responses, "events", pages.statuses, "SELECT event_id AS id, CASE WHEN event_type IN ('error', 'click') THEN 'error' ELSE 'success' END AS crawl_status, CASE event_type WHEN 'error' THEN 'HTTP 500' WHEN 'click' THEN 'HTTP 302' END AS message FROM events")


def add_log(name: str, operator: Callable[..., DataFrame], sql: str, **parameters: object) -> None:
    more = " RECURSIVE" if sql.startswith(",") else ""
    add(name, send_log, "events", operator, f"WITH{more} log AS ({LOG}) {sql}", **parameters)


add_log("l1_l2_found_sends", lambda log: outreach.found_sends(log, 40, 5, send_status="failed", mode="browser", site=None).select("id", "site", "send_status", "mode", F.unix_micros("sent_at").alias("sent_us")), "SELECT id, site, send_status, mode, epoch_us(sent_at) AS sent_us FROM log WHERE send_status = 'failed' AND mode = 'browser' ORDER BY sent_at DESC, id DESC LIMIT 40 OFFSET 5")
add_log("l4_send_statistics", outreach.send_statistics, "SELECT send_status, count(*) AS n, count(*) FILTER (CAST(sent_at AS DATE) = DATE '2024-01-30') AS n_today, count(DISTINCT site) AS n_recipients FROM log GROUP BY GROUPING SETS ((), (send_status))")
add_log("b4_submission_summary", outreach.submission_summary, "SELECT send_status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM log GROUP BY 1")
RUNS = "SELECT CAST(sent_at AS DATE) AS d, mode, count(*) AS total, count(*) FILTER (send_status = 'success') AS successful, count(*) FILTER (send_status <> 'success') AS failed, list(id || ':' || send_status ORDER BY id) FILTER (send_status <> 'success') AS bad FROM log GROUP BY 1, 2"
add_log("x2_cooldown_sends", cooldown.cooled_down, "SELECT id, site FROM (SELECT id, site, sent_at, row_number() OVER (PARTITION BY site ORDER BY sent_at, id) AS rn FROM log) WHERE rn = 1", days=30)
add_log("x2_cooldown_of_days", cooldown.cooled_down, """, f AS (SELECT site, min({'at': sent_at, 'id': id}) AS x FROM log GROUP BY 1),
 r AS (SELECT site, x, 1 AS n FROM f UNION ALL SELECT r.site, min({'at': l.sent_at, 'id': l.id}), r.n + 1 FROM r JOIN log l ON l.site = r.site AND l.sent_at >= r.x.at + INTERVAL 2 DAY GROUP BY r.site, r.n)
SELECT x.id AS id, site FROM r""", days=2)
add_log("x3_sliding_hours", outreach.sliding_hours, """SELECT epoch_us(f) AS from_us, epoch_us(f + INTERVAL 1 HOUR) AS to_us, count(*) AS n, count(*) FILTER (send_status = 'success') AS n_success, count(*) > 20 AS over_cap
 FROM (SELECT send_status, unnest(range(time_bucket(INTERVAL 5 MINUTE, sent_at) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, sent_at) + INTERVAL 1 MINUTE, INTERVAL 5 MINUTE)) AS f FROM log) GROUP BY f""", cap=20)
add_log("k9_bulk_results", lambda log: outreach.rolled_up(outreach.campaign_runs(log)), f"SELECT strftime(d, '%Y-%m-%d') AS day, mode, total, successful, failed, coalesce(array_to_string(bad[1:3], ','), '') AS first_failures FROM ({RUNS})")
add_log("k8_campaign_statistics", lambda log: outreach.campaign_statistics(outreach.campaign_runs(log), outreach.sent_history(log)), f"SELECT count(*) AS total_campaigns, sum(successful)::BIGINT AS total_sent, sum(failed)::BIGINT AS total_failed, (SELECT count(DISTINCT site) FROM log WHERE send_status = 'success') AS unique_recipients FROM ({RUNS})")


def history(log: DataFrame) -> DataFrame:
    """Successes of the log up to the 20th, upserted with the later ones; those older than 15 days evicted."""
    sends = log.where("send_status = 'success'").select(F.col("site").cast("string").alias("email"), "sent_at")
    day = F.lit("2024-01-20").cast("timestamp")
    after = outreach.upserted_history(outreach.upserted_history(sends.where(F.col("sent_at") < day), sends.limit(0)), sends.where(F.col("sent_at") >= day))
    return outreach.evicted_history(after, older_than_days=15).select("email", F.unix_micros("sent_at").alias("sent_us"))


add_log("k6_sent_history", history, "SELECT CAST(site AS VARCHAR) AS email, epoch_us(max(sent_at)) AS sent_us FROM log WHERE send_status = 'success' GROUP BY 1 HAVING max(sent_at) > TIMESTAMP '2024-01-15 12:00:00'")
MAIL = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'u' || c_custkey || '@example.com' ELSE 'u' || c_custkey || '@m' || c_custkey || '.example.jp' END"
RECENT = f"WITH log AS ({LOG}), mailable AS (SELECT c_custkey, {MAIL} AS email FROM customer WHERE c_custkey % 5 > 1 AND c_custkey NOT IN (SELECT site FROM log WHERE send_status = 'success' AND sent_at > TIMESTAMP '2023-12-31 12:00:00'))"


def mailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    mail = F.when(key % 5 == 1, F.concat(F.lit("u"), text, F.lit("@example.com"))).when(key % 5 > 1, F.concat(F.lit("u"), text, F.lit("@m"), text, F.lit(".example.jp")))
    targets = read_table(spark, sf_dir, "customer").select("c_custkey", mail.alias("email"))
    sent = send_log(read_table(spark, sf_dir, "events")).where("send_status = 'success'")
    past = sent.join(targets.withColumnRenamed("c_custkey", "site").hint("shuffle_hash"), "site").select("email", "sent_at")
    return outreach.mailable(targets, past).select("c_custkey", "email")


def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = send_log(read_table(spark, sf_dir, "events"))
    return outreach.delayed(outreach.capped_today(mailable(spark, sf_dir), 1000, "c_custkey", log), 30)


FOUND["k1_targets"] = (mailable, f"{RECENT} SELECT * FROM mailable")
FOUND["k2_k3_capped_schedule"] = (scheduled, f"{RECENT} SELECT *, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') + floor((place - 1) * 2) AS BIGINT) AS at_seconds FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS place FROM mailable) WHERE place <= 1000 - (SELECT count(*) FROM log WHERE send_status = 'success' AND CAST(sent_at AS DATE) = DATE '2024-01-30')")


def stored_sends(events: DataFrame) -> DataFrame:
    posts = derived.form_responses(events).join(events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("timestamp")).alias("sent_at")).hint("shuffle_hash"), "id")
    rows = logged(posts.select("id", F.col("url").alias("form_url"), F.lit("x").alias("send_status"), "sent_at"), outreach.AS_OF)
    return rows.select("id", "base_url", F.date_format("sent_date", "yyyy-MM-dd").alias("sent_date"))


add("s5_logged_sends", lambda e: e, "events", stored_sends, "SELECT event_id AS id, 'https://h' || user_id || '.example.jp' AS base_url, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2024-01-30' END AS sent_date FROM events")


def contact_values(customers: DataFrame) -> DataFrame:
    """Four contact values of each customer, as a visitor would type them."""
    text = F.col("c_custkey").cast("string")
    one = lambda field, kind, value: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("type"), value.alias("value"))
    rows = F.array(
        one("Email", "text", F.concat(F.lit(" Info"), text, F.lit("@S.Example.JP "))), one("tel", "tel", F.concat(F.lit("+81 (3) "), F.lpad(text, 9, "0"))), one("your_name", "text", F.concat(F.lower("c_mktsegment"), F.lit("  SMITH"))),
        one("会社", "text", F.concat(F.lit("acme "), F.lower("c_mktsegment"), F.lit("  inc"))), one("message", "textarea", F.concat(F.lit("Hello\r\n\n\n\n"), text, F.lit("\n"))), one("fax", "text", F.lit(None).cast("string")),
    )
    return customers.select(F.col("c_custkey").alias("id"), F.explode(rows).alias("r")).select("id", "r.*")


add("t2_t3_standardised", contact_values, "customer", contacts.standardised, f"{BASE} SELECT k AS id, f AS field, CASE f WHEN 'Email' THEN 'info' || s || '@s.example.jp' WHEN 'tel' THEN '03-' || substr(lpad(s, 9, '0'), 1, 4) || '-' || substr(lpad(s, 9, '0'), 5) WHEN 'your_name' THEN upper(segment[1]) || lower(segment[2:]) || ' Smith' WHEN '会社' THEN 'Acme ' || upper(segment[1]) || lower(segment[2:]) || ' INC' ELSE 'Hello' || chr(10) || chr(10) || s END AS value FROM p CROSS JOIN (VALUES ('Email'), ('tel'), ('your_name'), ('会社'), ('message')) t(f)")

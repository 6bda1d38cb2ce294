"""Registered queries on the links, rules and walks of whole sites. The SQL states what pages link to, or walks page by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import companies, emails, forms, industry, merging, outreach, pages, profiles, reach, robots
from leadmill.sources import derived
from leadmill.sources.tables import read_table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: The linked pages: key, number j in the site, host; and the links in order, with what tells of contact.
LINKED = f"""q AS (SELECT c_custkey AS page_id, c_custkey % {derived.SITE_PAGES} AS j, 'g' || c_custkey // {derived.SITE_PAGES} || '.example.jp' AS site FROM customer),
 linked AS (SELECT *, 'https://' || site || '/p' AS stem, j % 7 = 3 AND j <> 8 AS has_form FROM q),
 known AS (SELECT page_id, site, stem || j AS url, has_form FROM linked),
 outgoing AS (SELECT page_id, url, l.* FROM (SELECT page_id, stem || j AS url, unnest([{{'pos': 0, 'target': stem || (2 * j + 2) % 24, 'contact': false}}, {{'pos': 1, 'target': stem || (2 * j + 1) % 24, 'contact': false}},
  {{'pos': 2, 'target': stem || (j + 7) % 24, 'contact': j % 3 = 0}}, {{'pos': 7, 'target': stem || (j + 11) % 24 || '?x=1&y=2', 'contact': false}}, {{'pos': 8, 'target': 'https://' || site || '/missing' || j, 'contact': false}},
  {{'pos': 9, 'target': stem || (j + 13) % 24, 'contact': false}}, {{'pos': 10, 'target': stem || (2 * j + 1) % 24, 'contact': false}}, {{'pos': 11, 'target': stem || (j + 3) % 24, 'contact': false}},
  {{'pos': 12, 'target': stem || (j + 5) % 24, 'contact': false}}]) AS l FROM linked WHERE j <> 8))"""


def on_linked(operator: Callable[..., DataFrame], **parameters: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: operator(derived.linked_pages(read_table(spark, d, "customer")), **parameters)


def walk(most: int, tables: str, columns: str) -> str:
    """The walk one address at a time: each step takes the head of the site's queue. tables: known(page_id, site, url, has_form) and
    outgoing(url, pos, target, contact)."""
    fresh = "list_filter({}, lambda u: NOT list_contains(seen2, u))"
    return f"""WITH RECURSIVE {tables},
 nxt AS (SELECT url, coalesce(list(target ORDER BY pos) FILTER (contact), []) AS likely, coalesce(list(target ORDER BY pos) FILTER (NOT contact), []) AS others FROM outgoing GROUP BY 1),
 r AS (SELECT site, 0 AS step, [arg_min(url, page_id)] AS queue, []::VARCHAR[] AS seen, 0 AS forms FROM known GROUP BY site
  UNION ALL SELECT site, step + 1, CASE WHEN old OR forms2 >= {most} THEN queue[2:] ELSE list_concat(queue[2:], list_concat({fresh.format('coalesce(likely, [])')}, ({fresh.format('coalesce(others, [])')})[1:5])) END, seen2, forms2
  FROM (SELECT r.*, n.likely, n.others, list_contains(seen, queue[1]) AS old, CASE WHEN list_contains(seen, queue[1]) THEN seen ELSE list_append(seen, queue[1]) END AS seen2,
   forms + CASE WHEN NOT list_contains(seen, queue[1]) AND k.has_form THEN 1 ELSE 0 END AS forms2
   FROM r LEFT JOIN nxt n ON n.url = queue[1] LEFT JOIN known k ON k.url = queue[1] WHERE len(queue) > 0 AND len(seen) < {2 * most} AND forms < {most})),
 last AS (SELECT site, unnest(arg_max(seen, step)) AS url, unnest(range(1, len(arg_max(seen, step)) + 1)) AS place FROM r GROUP BY site)
SELECT {columns} FROM last l LEFT JOIN known k ON k.url = l.url"""


FOUND["u7_site_links_written_freely"] = (on_linked(pages.site_links), f"WITH {LINKED} SELECT DISTINCT page_id, target FROM outgoing")
for most in (15, 3):
    name = "u9_budgeted_walk" if most == 15 else "u9_walk_to_third_form"
    FOUND[name] = (on_linked(lambda p, most: reach.reached(p, most=most).drop("hop"), most=most), walk(most, LINKED, "l.site, l.url, k.page_id, l.place, coalesce(k.has_form, false) AS has_form"))

#: The stored pages: their anchors stand in one form only.
STORED = rf"""links AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, split_part(split_part(url, '//', 2), '/', 1) AS site, i AS pos, split_part(a[i], '"', 1) AS href, lower(split_part(split_part(a[i], '>', 2), '<', 1)) AS said
  FROM (SELECT page_id, url, a, unnest(range(2, len(a) + 1)) AS i FROM (SELECT page_id, url, string_split(html, '<a href="') AS a FROM pages))),
 known AS (SELECT min(page_id) AS page_id, split_part(split_part(url, '//', 2), '/', 1) AS site, regexp_replace(url, '#.*$', '') AS url, false AS has_form FROM pages GROUP BY ALL),
 outgoing AS (SELECT page_id, url, pos, split_part(url, '//', 1) || '//' || site || href AS target, regexp_matches(href, '{pages.CONTACT_PATHS}') OR regexp_matches(said, '{pages.CONTACT_TEXTS}') AS contact FROM links WHERE starts_with(href, '/'))"""
FOUND["u7_site_links"] = (lambda spark, d: pages.site_links(read_table(spark, d, "pages")), f"WITH {STORED} SELECT DISTINCT page_id, target FROM outgoing")
FOUND["u9_reached_pages"] = (lambda spark, d: reach.reached(read_table(spark, d, "pages")).drop("hop"), walk(15, STORED, "l.site, l.url, k.page_id, l.place, false AS has_form"))


def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pages")
    return robots.allowed(rows, derived.site_rules(rows), agent="LeadBot/2.0")


RULES = ", ".join(f"({v}, '{agent}', {seq}, {str(allow).lower()}, '{path}')" for v, rules in derived.SITE_RULES.items() for agent, seq, allow, path in rules)
FOUND["u6_prefix_rules"] = (u6, rf"""WITH r(v, agent, seq, allow, path) AS (VALUES {RULES}), p AS (SELECT page_id, url, length(split_part(url, '/', 1) || '//' || split_part(split_part(url, '//', 2), '/', 1)) % 5 AS v,
  url_decode('/' || split_part(regexp_replace(url, '^https?://[^/]+/', ''), '#', 1)) AS path FROM pages),
 g AS (SELECT v, coalesce(arg_min(agent, seq) FILTER (agent <> '*' AND contains('leadbot', lower(agent))), '*') AS agent FROM r GROUP BY 1),
 m AS (SELECT page_id, url, allow OR r.path = '' AS allow, row_number() OVER (PARTITION BY page_id, url ORDER BY seq, length(url_decode(r.path)) DESC, allow DESC) AS rn FROM p JOIN g USING (v) JOIN r ON r.v = p.v AND r.agent = g.agent AND starts_with(p.path, url_decode(r.path)))
SELECT p.page_id, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.url = p.url AND rn = 1""")


def on_graphs(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: operator(derived.graph_pages(read_table(spark, d, "customer")))


#: What each of the four pages with structured data holds, as it stands in the templates.
LEAVES = """(0, 0, '$.@graph[0].@type', '@type', 'string', 'WebSite'), (0, 0, '$.@graph[0].name', 'name', 'string', 'a "quoted" 日'), (0, 0, '$.@graph[1].@type', '@type', 'string', 'Organization'),
 (0, 0, '$.@graph[1].contactPoint.email', 'email', 'string', 'deep{k}@g.example.jp'), (0, 0, '$.@graph[1].contactPoint.tel[0]', NULL, 'string', '03'), (0, 0, '$.@graph[1].contactPoint.tel[1]', NULL, 'string', '04'),
 (0, 0, '$.@graph[1].n', 'n', 'number', '3.5'), (0, 0, '$.@graph[1].none', 'none', 'null', NULL), (0, 0, '$.@graph[1].ok', 'ok', 'boolean', 'true'),
 (1, 0, '$[0].mails[0]', NULL, 'string', 'no{k}@arr.example.jp'), (1, 0, '$[0].email', 'email', 'string', 'yes{k}@arr.example.jp'), (1, 0, '$[1].@type', '@type', 'string', 'Hospital'), (1, 0, '$[1].beds', 'beds', 'number', '{k}'),
 (2, 1, '$.a.b.c.d.industry', 'industry', 'string', '物流の会社'), (2, 1, '$.@type[0]', NULL, 'string', 'Thing'), (2, 1, '$.@type[1]', NULL, 'string', 'Store')"""
FOUND["h4_json_tree"] = (on_graphs(profiles.json_tree), f"""SELECT c_custkey AS page_id, block::BIGINT AS block, path, key, kind, replace(value, '{{k}}', CAST(c_custkey AS VARCHAR)) AS value
 FROM customer JOIN (VALUES {LEAVES}) t(v, block, path, key, kind, value) ON v = c_custkey % 4""")
FOUND["e9_structured_addresses"] = (on_graphs(lambda p: emails.candidates(p).where("method = 'jsonld_schema'").select("page_id", "email")), """SELECT c_custkey AS page_id,
 CASE c_custkey % 4 WHEN 0 THEN 'deep' || c_custkey || '@g.example.jp' ELSE 'yes' || c_custkey || '@arr.example.jp' END AS email FROM customer WHERE c_custkey % 4 < 2""")
FOUND["i3_structured_industries"] = (on_graphs(lambda p: industry.page_industries(p).where("source = 'jsonld'")), """SELECT c_custkey AS page_id, 'jsonld' AS source,
 CASE c_custkey % 4 WHEN 1 THEN '医療・ヘルスケア' ELSE '物流・運輸' END AS industry, 0.9::DOUBLE AS confidence FROM customer WHERE c_custkey % 4 IN (1, 2)""")


def on_contact_sites(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: operator(derived.contact_sites(read_table(spark, d, "customer")))


def known(rows: DataFrame) -> DataFrame:
    """The name in a page's title and its best address."""
    named = companies.basic_names(rows).withColumnRenamed("name", "company_name")
    return named.hint("merge").join(emails.ranked(rows).select("page_id", "email"), "page_id", "left")


def letters(rows: DataFrame) -> DataFrame:
    return outreach.letters(rows.select("page_id", "url").hint("merge").join(known(rows), "page_id"), "山田", "yamada@own.example.jp", body="{{company_name}}|{sender_name}|{sender_email}|{message_body}|{{website_url}}", message="M {company_name}")


def addressed(spark: SparkSession, d: str) -> DataFrame:
    customers = read_table(spark, d, "customer")
    replies = derived.model_replies(customers)
    found = merging.from_labels(replies).join(replies.select("url", "page_id").hint("merge"), "url").select("page_id", "email")
    return merging.with_page_addresses(found, derived.company_pages(customers))


ASKED = "WITH a AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, 'https://q' || c_custkey || '.example.jp' AS site, 'Q' || replace(c_name, '#', '') AS name FROM customer)"
FOUND["f3_parameter_forms"] = (on_contact_sites(forms.parameter_forms), f"""{ASKED} SELECT 2 * k AS page_id, site || '/ask?form=2' AS form_url, 1.0::DOUBLE AS score, site || '/ask?form=2:0:100' AS candidates,
 'Found via parameter link (score: 1.00)' AS remark FROM a""")
FOUND["q1_guarded_forms"] = (on_contact_sites(lambda p: forms.guarded_forms(p, known(p)).withColumn("required_fields", F.array_join("required_fields", ","))), f"""{ASKED} SELECT 2 * k + 1 AS page_id, 0::BIGINT AS pos,
 site || '/ask?form=2#top' AS url, site || '/ask?form=2#top' AS form_url, CASE k % 3 WHEN 0 THEN 'recaptcha_v2' ELSE 'hcaptcha' END AS captcha, site || '/post' AS form_action, 'POST' AS form_method, 'name,mail' AS required_fields,
 NULL::VARCHAR AS company_name, NULL::VARCHAR AS email, 'CAPTCHA detected during crawl. Manual intervention required.' AS notes, 'pending' AS status FROM a WHERE k % 3 < 2""")
FOUND["k4_letters"] = (on_contact_sites(letters), f"""{ASKED} SELECT 2 * k AS page_id, 'mail' || s || '@q.example.jp' AS email, name AS company_name, 'M ' || name AS message_body, name || '様へのご提案' AS subject,
 name || '|山田|yamada@own.example.jp|M ' || name || '|' || site || '/' AS body FROM a""")
FOUND["m6_page_addresses"] = (addressed, """SELECT c_custkey AS page_id, CASE c_custkey % 8 WHEN 2 THEN 'ld' || c_custkey || '@ld.example.jp' WHEN 6 THEN 'foot' || c_custkey || '@foot.example.jp'
 ELSE CASE c_custkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'json' ELSE 'free' END || c_custkey || '@r.example.jp' END AS email FROM customer""")
FOUND["q3_queue_summary"] = (lambda spark, d: forms.queue_summary(forms.review_queue(derived.form_responses(read_table(spark, d, "events")))), """WITH q AS (SELECT 'pending' AS status,
 CASE user_id % 5 WHEN 0 THEN 'recaptcha_v2' WHEN 1 THEN 'recaptcha_v3' WHEN 2 THEN 'hcaptcha' WHEN 3 THEN 'image' ELSE 'unknown' END AS captcha FROM events WHERE event_type = 'click'), n AS (SELECT count(*) AS total FROM q)
SELECT kind, name, n, round(100.0 * n / total, 1)::DOUBLE AS share FROM (SELECT 'status' AS kind, status AS name, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'captcha', captcha, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM q), n""")
FOUND["b4_submission_errors"] = (lambda spark, d: forms.submission_errors(derived.form_responses(read_table(spark, d, "events"))), "SELECT event_id AS id, 'https://h' || user_id || '.example.jp/contact' AS url, 'Connection refused' AS error FROM events WHERE event_type = 'error'")

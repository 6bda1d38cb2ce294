"""Tables that Spark derives from the stored ones: company pages, form responses, robots rules and replies.

The stored pages hold no forms, tables, definition lists or structured data, so these are written from customers and events by
expressions: one page a customer, by ``c_custkey % 8``. What each page says follows from its key alone, hence an oracle can
state the results without reading any html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the page's variants, by key % 8.
TABLE, LIST, STRUCTURED, META, FORM, LOGIN, HEADINGS, CAPTCHA = range(8)
TEMPLATE = {
    TABLE: """<html><head><title>株式会社{n} | 会社概要</title></head><body><h1>会社概要</h1><table><tr><th>会社名</th><td>株式会社{n}</td></tr><tr><th>メール</th><td>info{k}＠s{k}．example．jp</td></tr><tr><th>備考</th><td>
x{k}@cell.example.jp</td></tr></table><footer>Copyright © 2024 株式会社{n} All Rights Reserved</footer></body></html>""",
    LIST: """<html><head><title>Profile</title></head><body><h2>About</h2><dl><dt>商号<dd>合同会社{n}<dt>メール<dd>info{k}@s{k}.example.jp</dl><ul><li>contact: li{k}@list.example.jp<li>Open daily</ul><footer>Since 2001</footer></body></html>""",
    STRUCTURED: """<html><head><title>Home</title><script type="application/ld+json">{{"@type":"Organization","name":"株式会社{n}","industry":"金融","contactPoint":[{{"email":"ld{k}@ld.example.jp"}}]}}</script></head><body><p>Welcome to our site</p></body></html>""",
    META: """<html><head><title>{n} Home</title><meta property="og:site_name" content="株式会社{n} | Official"><meta name="description" content="病院とクリニックの情報システム"><meta name='keywords' content='物流'></head><body><header>Open house</header><h1>Start</h1><span>お問い合わせ</span><span>sp{k}@c{k}.example.jp</span></body></html>""",
    FORM: """<html><head><title>Write to us</title><meta name="csrf-param" content="m{k}"></head><body><form action="/send?a=1" method="post" id="f1" class="contact-form"><p><label>お名前</label><input name="yourname" required="required"></p><p><label>Mail</label><input type="email" name="mail" required="required"></p><p><label>Tel</label><input type="tel" name="tel"></p><p><label>会社</label><input name="company"></p><p><label>Text</label><textarea name="body"></textarea></p><input type="hidden" name="csrf_token" value="tok{k}"><input type="submit" value="送信"></form></body></html>""",
    LOGIN: """<html><head><title>Members</title></head><body><form action="/login" method="post"><input name="user"><input type="password" name="password"><button type="submit">Login</button></form><p>News of the year and other things that are told at some length here</p><a href="mailto:Sales{k}@m.example.jp?subject=x">営業</a><p>Opening hours and further notes, again told at some length in this place</p><div class="contact-box">box{k}@box.example.jp</div><p>The end of it all, which is also told at length</p></body></html>""",
    HEADINGS: """<html><head><title>Guide</title></head><body><h1>税理士法人{n}｜会社概要</h1><h2>団体名</h2><div>協会{n}</div><p>■会社名 株式会社{n}<br>■所在地 東京</p><img src="h.png" alt="Header"><footer><img src="f.png" alt="{n}事務所">foot{k}@foot.example.jp</footer></body></html>""",
    CAPTCHA: """<html><head><title>Ask</title></head><body class="start"><p>Step 1 of 3</p><form action="" onsubmit="return send()"><input name="q1"><input type="text" name="memo"><button type="submit">Next</button></form>{c}<script>function send() {{ fetch('/api/x{k}') }}</script><a href="/ask?form=2">Ask</a><a href="/contact">お問い合わせ</a></body></html>""",
}
#: Captcha marks by (key / 8) % 4.
CAPTCHAS = ['<div class="g-recaptcha"></div>', "<script>grecaptcha.execute('k')</script>", '<div class="h-captcha"></div>', '<img src="captcha.png">']
PATH = {TABLE: "/company", LIST: "/about.html", FORM: "/contact"}
#: (status code, path of the response, text) by event type.
RESPONSES = {
    "purchase": (200, "/thanks", "<p>Thank you for your message</p>"), "view": (200, "/contact", "<form></form> Please enter your name"), "error": (500, "/error", "Error: invalid token <form></form>"),
    "click": (302, "/contact", "お問い合わせ 完了"), "signup": (200, "/done", "<form></form>"),
}


def chosen(value: Column, by: dict, otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for k, v in by.items():
        out = F.when(value == F.lit(k), v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    out = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.translate(out, "\x01\x02", "{}")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores. A row of a key table is small, a file of them is read by one or a few tasks, but the page made from
    each costs much to take apart."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def company_pages(customers: DataFrame) -> DataFrame:
    """page_id, url, html: a page for each customer."""
    customers = dealt(customers)
    k, variant = F.col("c_custkey").cast("string"), F.col("c_custkey") % 8
    captcha = chosen(F.floor(F.col("c_custkey") / 8) % 4, dict(enumerate(CAPTCHAS)))
    values = {"n": F.replace(F.col("c_name"), F.lit("#"), F.lit("")), "k": k, "c": captcha}
    html = chosen(variant, {v: filled(t, **values) for v, t in TEMPLATE.items()})
    return customers.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://c"), k, F.lit(".example.jp"), chosen(variant, PATH, "/")).alias("url"), html.alias("html"))


def form_responses(events: DataFrame) -> DataFrame:
    """id, url, response_url, http_status, content, error: what a post of the event's user got back."""
    of = lambda i: chosen(F.col("event_type"), {e: r[i] for e, r in RESPONSES.items()})
    site = F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.jp"))
    blocked = chosen(F.col("user_id") % 5, {0: "Blocked by reCAPTCHA v2", 1: "Blocked by reCAPTCHA v3", 2: "hCaptcha captcha on page", 3: "Image captcha found", 4: "captcha of another kind"})
    error = F.when(F.col("event_type") == "click", blocked).when(F.col("event_type") == "error", "Connection refused")
    return events.select(F.col("event_id").alias("id"), F.concat(site, F.lit("/contact")).alias("url"), F.concat(site, of(1)).alias("response_url"), of(0).cast("int").alias("http_status"), of(2).alias("content"), error.alias("error"))


def robots_rules(customers: DataFrame) -> DataFrame:
    """origin, agent, seq, allow, path_prefix: rules of each company's site; every fourth site has none."""
    origin = F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example.jp"))
    rule = lambda seq, allow, path: F.struct(F.lit(seq).alias("seq"), F.lit(allow).alias("allow"), F.lit(path).alias("path_prefix"))
    rows = customers.where("c_custkey % 4 <> 3").select(origin.alias("origin"), F.lit("*").alias("agent"), F.explode(F.array(rule(1, True, "/contact"), rule(2, False, "/co"), rule(3, False, "/about"))).alias("r"))
    return rows.select("origin", "agent", "r.seq", "r.allow", "r.path_prefix")


def model_replies(customers: DataFrame) -> DataFrame:
    """url, reply, responded_at: what a model answered about each company, in one of four forms."""
    customers = dealt(customers)
    k, name = F.col("c_custkey").cast("string"), F.replace(F.col("c_name"), F.lit("#"), F.lit(""))
    forms = {
        0: "会社名： 「株式会社{n}」\nメールアドレス：info{k}@r.example.jp\n業界：金融業", 1: "Here it is: {{\"company_name\": {{\"value\": \"有限会社{n}\", \"confidence\": 0.9, \"source\": \"page\"}}, \"email\": \"json{k}@r.example.jp\", \"industry\": \"IT\"}} done",
        2: "company_name: 合同会社{n} | Site\nconfidence: 0.75\nsource: footer", 3: "Company: なし\nindustry| N/A\nwrite to free{k}@r.example.jp or noreply@r.example.jp",
    }
    reply = chosen(F.col("c_custkey") % 4, {v: filled(t, n=name, k=k) for v, t in forms.items()})
    at = F.lit("2024-01-30 12:00:00").cast("timestamp") - F.make_dt_interval(hours=(F.col("c_custkey") % 48).cast("int"))
    return customers.select(F.concat(F.lit("https://c"), k, F.lit(".example.jp/")).alias("url"), F.col("c_custkey").alias("page_id"), reply.alias("reply"), at.alias("responded_at"))


#: Customers that make up one site of linked pages.
SITE_PAGES = 24
LINKED = """<html><body><!-- <a href="/p{next}">old</a> --><script>var a = '<a href="/p5">no</a>';</script><A CLASS="x" HREF='/p{b}'>Two</A><a title="a > b" href="/p{a}#part">One</a><a href=/p{c}>{word}</a>
<a href="https://other.example/p1">Elsewhere</a><a href="mailto:x@y.example">Mail</a><a href="#top">Top</a><a name="none">No link</a><a href="./p{d}?x=1&amp;y=2">Three</a><a href="/missing{j}">Gone</a><a href="//{host}/p{e}">Four</a>
<a href="/p{a}">Again</a><a href="/p{f}">Five</a><a href="/p{g}">Six</a>{form}</body></html>"""


def linked_pages(customers: DataFrame) -> DataFrame:
    """page_id, url, html: sites of 24 pages that link each other in all ways that anchors are written; every seventh page has a form, page 8
    is empty."""
    customers = dealt(customers)
    j, site = F.col("c_custkey") % SITE_PAGES, F.floor(F.col("c_custkey") / SITE_PAGES).cast("string")
    host = F.concat(F.lit("g"), site, F.lit(".example.jp"))
    to = lambda x: (x % SITE_PAGES).cast("string")
    targets = {"a": 2 * j + 1, "b": 2 * j + 2, "c": j + 7, "d": j + 11, "e": j + 13, "f": j + 3, "g": j + 5, "next": j + 1, "j": j}
    word = F.when(j % 3 == 0, "お問い合わせ").otherwise("Seven")
    html = filled(LINKED, host=host, word=word, form=F.when(j % 7 == 3, "<FORM></FORM>").otherwise(""), **{k: to(v) for k, v in targets.items()})
    return customers.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://"), host, F.lit("/p"), to(j)).alias("url"), F.when(j != 8, html).alias("html"))


def site_rules(pages: DataFrame) -> DataFrame:
    """origin, agent, seq, allow, path_prefix: rules of each page's site, by the length of its origin; every fifth has none."""
    origins = pages.select(F.nullif(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("")).alias("origin")).where("origin is not null").distinct()
    rule = lambda r: F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("agent", "seq", "allow", "path_prefix"), strict=True)])
    by = chosen(F.length("origin") % 5, {v: F.array(*map(rule, rules)) for v, rules in SITE_RULES.items()}, None)
    return origins.select("origin", F.explode(by).alias("r")).select("origin", "r.*")


#: Rules by the length of the origin % 5: overlapping prefixes, equal numbers, agents, escapes, an empty rule and a sign that no path begins with.
SITE_RULES = {
    1: [("*", 1, False, "/en/1"), ("*", 2, True, "/en/"), ("*", 3, False, "/")],
    2: [("*", 1, False, "/"), ("LeadBot", 5, True, "/fr"), ("LeadBot", 5, False, "/fr/8"), ("LeadBot", 5, True, "/en/"), ("LeadBot", 6, False, "/e")],
    3: [("other", 1, False, "/"), ("*", 2, False, "/%65n/3"), ("*", 3, True, "/en"), ("*", 4, False, "*")],
    4: [("*", 1, False, ""), ("*", 2, False, "/"), ("lead", 3, False, "/de"), ("leadbot", 4, False, "/es")],
}


#: Pages with structured data of all shapes, by key % 4: a graph with escapes and scalars, a list, a broken block before a deep one, none.
GRAPHS = {
    0: """<script type="application/ld+json">{{"@graph":[{{"@type":"WebSite","name":"a \\"quoted\\" \\u65e5"}},{{"@type":"Organization","contactPoint":{{"email":"deep{k}@g.example.jp","tel":["03","04"]}},"n":3.5,"ok":true,"none":null}}]}}</script>""",
    1: """<SCRIPT TYPE='application/ld+json'>[{{"mails":["no{k}@arr.example.jp"],"email":"yes{k}@arr.example.jp"}},{{"@type":"Hospital","beds":{k} }}]</SCRIPT>""",
    2: """<script type="application/ld+json">{{"industry":"金融",}}</script><script id=x type=application/ld+json>{{"a":{{"b":{{"c":{{"d":{{"industry":"物流の会社"}}}}}}}},"@type":["Thing","Store"],"e":{{}},"f":[]}}</script>""",
    3: """<script type="application/ld+json"></script><script>{{"industry":"金融","email":"script{k}@no.example.jp"}}</script>""",
}


def graph_pages(customers: DataFrame) -> DataFrame:
    """page_id, url, html: a page for each customer whose content is structured data."""
    customers = dealt(customers)
    k = F.col("c_custkey").cast("string")
    html = chosen(F.col("c_custkey") % 4, {v: filled(t, k=k) for v, t in GRAPHS.items()})
    return customers.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://j"), k, F.lit(".example.jp/")).alias("url"), html.alias("html"))


#: A home page with links of many kinds, and the page that one of them leads to, by key % 3: behind a captcha (two kinds) or open.
ASKING = """<html><head><title>Q{n} - Home</title></head><body><a href="/ask?form=2">Write</a><a href='/gone?inquiry=1'>Old</a><a href="/plain">お問い合わせ</a><a href="mailto:mail{k}@q.example.jp">Mail</a></body></html>"""
ASKED = """<html><body><form action="/post" method="post"><input name="name" required><input type="email" name="mail" required><textarea name="text"></textarea><button>Send</button></form>{c}</body></html>"""
GUARDS = {0: CAPTCHAS[0], 1: CAPTCHAS[2]}


def contact_sites(customers: DataFrame) -> DataFrame:
    """page_id, url, html: two pages for each customer, the home page (2 * key) and its form (2 * key + 1)."""
    customers = dealt(customers)
    k, n = F.col("c_custkey").cast("string"), F.replace(F.col("c_name"), F.lit("#"), F.lit(""))
    site = F.concat(F.lit("https://q"), k, F.lit(".example.jp"))
    home = F.struct((2 * F.col("c_custkey")).alias("page_id"), F.concat(site, F.lit("/")).alias("url"), filled(ASKING, n=n, k=k).alias("html"))
    form = F.struct((2 * F.col("c_custkey") + 1).alias("page_id"), F.concat(site, F.lit("/ask?form=2#top")).alias("url"), filled(ASKED, c=chosen(F.col("c_custkey") % 3, GUARDS, "")).alias("html"))
    return customers.select(F.inline(F.array(home, form)))


#: Pages whose names only weaker detectors find, by key % 6: a label and its value in one dt, a label in the text, a business word in the heading,
#: a name before an address and a person, labels and names whose UTF-8 was read as Latin-1, a full name with its short form.
NAMED = {
    0: "<dl><dt>会社名 合同会社{n} 代表 山田<dt>x</dl>", 1: "<p>会社名：山田商店{k}</p>", 2: "<h1>名古屋の探偵事務所なら{n}</h1>", 3: "<table><tr><td>会社名<td>株式会社N{k} 東京都港区1-1</table>",
    4: "<table><tr><td>{garbled}<td>{garbled_name}{n}</table>", 5: "<table><tr><td>法人名<td>{n}商店・略称：Y（ワイ）</table>",
}


def name_pages(customers: DataFrame) -> DataFrame:
    """page_id, url, html: a page for each customer that tells its name in one of six ways."""
    customers = dealt(customers)
    k, n = F.col("c_custkey").cast("string"), F.replace(F.col("c_name"), F.lit("#"), F.lit(""))
    garbled = lambda text: F.lit(text.encode().decode("latin-1"))
    values = {"n": n, "k": k, "garbled": garbled("会社名"), "garbled_name": garbled("株式会社")}
    html = chosen(F.col("c_custkey") % 6, {v: filled(t, **values) for v, t in NAMED.items()})
    return customers.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://n"), k, F.lit(".example.jp/")).alias("url"), html.alias("html"))

"""Forms of pages: shredding, detection, scoring, analysis, and the outcome of stored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions.text import bound, extract, listed
from leadmill.operators.pages import CONTACT_PATHS, CONTACT_TEXTS, INQUIRY, anchors_with_text, host, joined_url

#: What excludes a form, what its fields are for (in order of precedence), and the patterns of captchas. Fixed values.
EXCLUDED = r"login|signin|sign-in|ログイン|サインイン|password|パスワード|search|検索|さんさく|newsletter|subscribe|メルマガ|購読|comment|コメント|cart|checkout|カート|購入"
FIELD_KINDS = {
    "email": r"email|mail|e-mail|メール|ｅ－ｍａｉｌ", "phone": r"phone|tel|telephone|mobile|電話|でんわ|携帯", "name": r"name|名前|なまえ|氏名|お名前|氏|名", "company": r"company|organization|会社|企業|法人|組織|会社名|御社名",
    "subject": r"subject|title|件名|タイトル|表題",
}
MESSAGE = r"message|comment|content|inquiry|question|メッセージ|内容|お問い合わせ内容|ご質問|詳細|本文"
PURPOSES = {
    "email": r"email|mail|e-mail|メール|ｅメール", "name": r"name|名前|なまえ|fullname|full.?name|お名前", "company": r"company|会社|企業|organization|事業者", "phone": r"phone|tel|telephone|mobile|電話|携帯",
    "message": r"message|content|inquiry|question|comment|メッセージ|内容|お問い合わせ|詳細", "subject": r"subject|title|件名|表題|topic",
}
CAPTCHA = {
    "recaptcha_v2": r"(?i)recaptcha.*v2|g-recaptcha(?!-responsive)|grecaptcha\.render",
    "recaptcha_v3": r"""(?i)google\.recaptcha\.execute|grecaptcha\.execute\(|recaptcha/api\.js\?render=|recaptcha.*v3|action:\s*['"][\w\-.]+['"]|google\.recaptcha(?!.*v2)""",
    "hcaptcha": r"(?i)hcaptcha|h-captcha", "image": r"(?is)captcha.*(<img|\.jpg|\.png)|(<img|\.jpg|\.png).*captcha",
}
LADDER = {
    "top_priority_fallback": ["/contact", "/contact/", "/contact/mailform", "/contact/mailform/", "/contact/contact.html", "/contact/inquiry.html", "/inquiry", "/inquiry/", "/お問い合わせ・お申し込み.html"],
    "high_priority_fallback": ["/contact.html", "/contact.php", "/inquiry.html", "/inquiry.php", "/form", "/form.html"],
    "medium_priority_fallback": ["/contact.htm", "/inquiry.htm", "/contact/index.html", "/contact/index.htm", "/inquiry/index.html", "/form.php", "/contact-us", "/contact_us", "/inquiry-form"],
    "low_priority_fallback": ["/お問い合わせ", "/otoiawase", "/toiawase", "/contact.aspx", "/inquiry.aspx"],
}
AJAX = [r"\.ajax\s*\(", r"fetch\s*\(", r"XMLHttpRequest", r"axios\.", r"\$\.post", r"preventDefault\(\)"]
ENDPOINT = r"""(?:url\s*:\s*|fetch\s*\(\s*|\.post\s*\(\s*)['"]([^'"]+)['"]"""
CSRF = r"csrf_token|csrftoken|_csrf|_token|token|authenticity_token|x-csrf-token|__requestverificationtoken"
SUCCESS_WORDS = (
    "thank you|thanks|success|successful|submitted|received|sent|confirmed|completed|appreciate|ありがとうございました|ありがとうございます|完了|送信完了|確認|確認画面|送信確認|確認いたしました|受け付け|受け取り|受信|受け付けました|お問い合わせ|ご送信|送信する"
    "|ご送信ありがとう|登録完了|ご登録ありがとう|登録されました|予約完了|ご予約ありがとう|予約されました|処理完了|処理しました|手続き完了|申し込み|申し込み完了|お申し込みありがとう|メール送信|メッセージ送信|送信しました"
).split("|")
ERROR_WORDS = "error|fail|failed|invalid|incorrect|problem|エラー|失敗|不正|無効|問題|入力してください".split("|")
STRICT_SUCCESS, STRICT_ERROR = r"thank you|thanks|success|successful|submitted|ありがとう|送信完了|受信しました|確認", r"error|fail|failed|invalid|エラー|失敗"
SUCCESS_URL = r"(?i)/thanks?|/thank[-_]you|/success|/complete|/confirmation|/完了|/送信完了"
INVALID = r"(?i)required|必須.*入力|please\s+enter|invalid\s+email"


def hits(text: Column, words: list[str]) -> Column:
    """The words that a text holds, in the order of the list."""
    return bound(F.lower(text), lambda low: F.filter(listed([w.lower() for w in words]), lambda w: F.contains(low, w)))


def first_kind(text: Column, patterns: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for kind, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


def first_pattern(text: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def field(tag: Column, before: Column) -> Column:
    """A field's attributes; before: the markup between the field before and this one, where its label stands."""
    name, kind = H.attribute(tag, "name"), F.lower(H.attribute(tag, "type"))
    kind = bound(kind, lambda k: F.when(k == "", "text").otherwise(k))
    label = F.lower(H.inner_text(F.element_at(F.concat(F.array(F.lit("")), H.every(before, r"(?is)<label(?:\s[^>]*)?>(.*?)</label", 1)), -1)))
    told = bound(name, lambda n: F.struct(n.alias("name"), F.lower(F.concat_ws(" ", n, H.attribute(tag, "id"), H.attribute(tag, "placeholder"))).alias("said")))
    parts = F.struct(tag.alias("tag"), told.alias("told"), F.lower(F.regexp_extract(tag, r"^<(\w+)", 1)).alias("element"), kind.alias("kind"), label.alias("label"))
    return bound(parts, lambda x: read_field(x["tag"], x["told"]["name"], x["told"]["said"], x["element"], x["kind"], x["label"]))


def read_field(tag: Column, name: Column, said: Column, element: Column, kind: Column, label: Column) -> Column:
    typed = F.when(kind == "email", "email").when(kind == "tel", F.when(said.rlike(f"(?i){FIELD_KINDS['email']}"), "email").otherwise("phone")).otherwise(first_kind(said, FIELD_KINDS))
    return F.struct(
        name.alias("name"), element.alias("element"), kind.alias("type"), H.attribute(tag, "value").alias("value"), tag.rlike(r"(?i)\s(?:aria-)?required(?:[\s=>/])").alias("required"), typed.alias("kind"),
        ((element == "textarea") | said.rlike(f"(?i){MESSAGE}")).alias("message"), bound(F.concat_ws(" ", said, label), lambda x: first_kind(x, PURPOSES, "unknown")).alias("purpose"),
    )


def form_parts(form: Column) -> Column:
    """A form's attributes, fields, first button with a text, and text, as a struct."""
    cut = F.struct(form.alias("form"), F.regexp_extract(form, r"^<[^>]*>", 0).alias("tag"), H.every(form, H.FIELD).alias("tags"))
    return bound(cut, lambda x: read_form(x["form"], x["tag"], x["tags"]))


def read_form(form: Column, tag: Column, tags: Column) -> Column:
    gaps = F.split(form, H.FIELD)
    buttons = F.concat(
        F.transform(H.every(form, r"""(?is)<button(?:\s[^>]*)?>(.*?)</button"""), lambda x: H.inner_text(F.regexp_extract(x, r"""(?is)<button(?:\s[^>]*)?>(.*?)</button""", 1))),
        F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)type\s*=\s*["']?(?:submit|button)""")), lambda t: F.trim(H.attribute(t, "value"))),
    )
    fields = bound(F.struct(tags.alias("t"), gaps.alias("g")), lambda x: F.transform(F.arrays_zip(x["t"].alias("t"), F.slice(x["g"], F.lit(1), F.size(x["t"])).alias("g")), lambda y: field(y["t"], y["g"])))
    named = [H.attribute(tag, a).alias(f"form_{a}") for a in ("id", "name", "class")]
    return F.struct(
        H.attribute(tag, "action").alias("action"), F.upper(H.attribute(tag, "method")).alias("method"), *named, fields.alias("fields"),
        F.get(F.filter(buttons, lambda b: b != ""), F.lit(0)).alias("button"), H.inner_text(F.regexp_replace(form, r"(?is)<script.*?</script\s*>", " "), " ").alias("text"),
    )


def page_forms(pages: DataFrame) -> DataFrame:
    """One row a form: page, place, attributes, fields, buttons, text; and the whole html beside it for what stands outside."""
    parts = F.transform(H.every(F.col("html"), H.FORM), lambda f: F.struct(f.alias("form"), form_parts(f).alias("p")))
    forms = pages.where(F.contains(F.lower("html"), F.lit("<form"))).select("page_id", "url", "html", F.posexplode(parts).alias("pos", "x"))
    return forms.select("page_id", "url", "html", F.col("pos").cast("long").alias("pos"), "x.form", "x.p.*")


def form_fields(pages: DataFrame) -> DataFrame:
    """Named fields that a visitor fills in, with their purpose."""
    rows = page_forms(pages).select("page_id", "pos", F.posexplode("fields").alias("field_pos", "f"))
    return rows.where((F.col("f.name") != "") & ~F.col("f.type").isin("submit", "button", "reset", "hidden", "image")).select("page_id", "pos", F.col("field_pos").cast("long").alias("field_pos"), "f.name", "f.type", "f.required", "f.purpose")


def basic_forms(pages: DataFrame) -> DataFrame:
    """Distinct URLs of inquiry forms: actions of forms whose text, names or buttons tell, and links that do."""
    said = F.lower(F.concat_ws(" ", "text", "form_id", "form_class", "form_name", "button"))
    forms = page_forms(pages).where((F.col("action") != "") & said.rlike(INQUIRY)).select("page_id", joined_url(F.col("url"), F.col("action")).alias("form_url"))
    links = anchors_with_text(pages).where(F.col("text").rlike(INQUIRY) & F.lower("target").rlike("form|contact|inquiry|問い合わせ")).select("page_id", F.col("target").alias("form_url"))
    return forms.unionByName(links).where("form_url is not null").distinct()


def scored(html: Column, url: Column, found_by: str | None = None) -> Column:
    """The page's forms that aren't excluded, in their order, as structs: place, method, detection, counts of fields and keywords, button, score in
    hundredths, and what fields there are. found_by: how all the pages were found; without it their paths tell."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^#]*)", 1)
    detection = F.lit(found_by) if found_by else F.when(path.rlike(CONTACT_PATHS), "pattern_match").otherwise("crawl")
    points = {"email": 30, "message": 30, "name": 15, "phone": 10, "company": 8, "subject": 5}  # a message field counts as a text area too

    def counted(x: Column) -> Column:
        f, method = x["p"]["fields"], F.when(x["p"]["method"] == "", "GET").otherwise(x["p"]["method"])
        kinds = F.array_distinct(F.concat(F.transform(f, lambda y: y["kind"]), F.when(F.exists(f, lambda y: y["message"]), F.array(F.lit("message"))).otherwise(F.array().cast("array<string>"))))
        n = lambda test: F.size(F.filter(f, test)).cast("long")
        return F.struct(
            x["pos"].alias("pos"), method.alias("method"), detection.alias("detection"), n(lambda y: y["required"]).alias("n_required"),
            n(lambda y: (y["element"] != "textarea") & y["type"].isin("text", "email", "tel", "url")).alias("n_text"), F.size(hits(x["p"]["text"], CONTACT_TEXTS.split("|"))).cast("long").alias("n_keywords"),
            x["p"]["button"].alias("button"), kinds.alias("kinds"), F.lower(url).rlike("contact|inquiry|form|otoiawase|toiawase").alias("told"),
        )

    def rated(c: Column) -> Column:
        score = F.lit(10) + F.least(F.lit(20), 5 * c["n_keywords"])
        tests = [(F.array_contains(c["kinds"], k), n) for k, n in points.items()]
        tests += [(c["n_text"] >= 1, 8), (c["told"], 25), (F.coalesce(F.lower(c["button"]).rlike("send|送信|submit|確認|confirm"), F.lit(False)), 15), (c["method"] == "POST", 10), (c["n_required"] >= 2, 8)]
        for test, n in [*tests, (c["detection"].isin("pattern_match", "parameter_link"), 40)]:
            score = score + F.when(test, n).otherwise(0)
        return F.struct(*[c[k].alias(k) for k in ("pos", "method", "detection", "n_required", "n_text", "n_keywords", "button", "kinds")], F.least(F.lit(100), F.greatest(F.lit(10), score)).cast("long").alias("score"))

    forms = F.transform(F.when(F.contains(F.lower(html), F.lit("<form")), H.every(html, H.FORM)), lambda f, i: F.struct(i.cast("long").alias("pos"), f.alias("form")))
    open_ = F.filter(forms, lambda x: ~F.lower(x["form"]).rlike(EXCLUDED))
    parts = F.transform(open_, lambda x: F.struct(x["pos"].alias("pos"), form_parts(x["form"]).alias("p")))
    return F.transform(F.transform(parts, counted), rated)


def scored_forms(pages: DataFrame, found_by: str | None = None) -> DataFrame:
    """One row a form that isn't excluded, with counts of its fields, keywords, score in hundredths and a remark."""
    rows = pages.select("page_id", "url", F.explode(scored(F.col("html"), F.col("url"), found_by)).alias("f")).select("page_id", "url", "f.*")
    names = F.array_join(F.filter(F.array(*map(F.lit, ("email", "phone", "name", "message"))), lambda k: F.array_contains("kinds", k)), ", ")
    remark = F.concat_ws("; ", F.when(names != "", F.concat(F.lit("Fields: "), names)), F.concat(F.lit("Method: "), "detection"), F.concat(F.lit("Score: "), F.format_string("%.2f", F.col("score") / F.lit(100.0))), F.when(F.col("n_keywords") > 0, F.concat(F.lit("Keywords: "), F.col("n_keywords").cast("string"))), F.concat(F.lit("Button: '"), "button", F.lit("'")))
    return rows.select("page_id", "url", "pos", "method", "detection", "n_required", "n_text", "n_keywords", "button", "score", remark.alias("remark"))


def best_in_row(html: Column, url: Column) -> Column:
    """The best form of one page as a struct with its score and detection, null if none."""
    return F.array_max(F.transform(scored(html, url), lambda c: F.struct(c["score"].alias("score"), (-c["pos"]).alias("place"), c["detection"].alias("detection"))))


def best_forms(pages: DataFrame, keep: int = 3) -> DataFrame:
    """The best form of each site and its first candidates in rank order."""
    order = F.struct((-F.col("score")).alias("s"), "page_id", "pos", "url", "score", "detection")
    found = scored_forms(pages).select(host(F.col("url")).alias("site"), order.alias("order"))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("order"))).where(F.col("rank") <= keep)  # keep rows a site and task
    sites = first.groupBy("site").agg(F.array_sort(F.collect_list("order")).alias("all"))
    top = F.col("all")[0]
    return sites.select("site", top["url"].alias("form_url"), (top["score"] / F.lit(100.0)).alias("score"), top["detection"].alias("detection"), F.array_join(F.transform(F.slice("all", 1, keep), lambda c: F.concat_ws(":", c["page_id"].cast("string"), c["pos"].cast("string"), c["score"].cast("string"))), ",").alias("candidates"))


def ladder_forms(pages: DataFrame) -> DataFrame:
    """For each site the first path of the ladder under which a stored page with a form stands."""
    steps = [F.struct(F.lit(i).alias("step"), F.lit(level).alias("level"), F.lit(path).alias("path")) for i, (level, path) in enumerate((lv, p) for lv, ps in LADDER.items() for p in ps)]
    step = F.get(F.filter(F.array(*steps), lambda s: s["path"] == F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)), F.lit(0))
    rows = pages.where(F.contains(F.lower("html"), F.lit("<form"))).select(host(F.col("url")).alias("site"), "url", step.alias("s")).where("s is not null")
    return rows.groupBy("site").agg(F.min(F.struct("s.step", "s.level", "url")).alias("m")).select("site", "m.level", F.col("m.url").alias("form_url"))


def parameter_links(pages: DataFrame) -> DataFrame:
    """Links of own host with a query that tells of contact, by text or by query."""
    links = anchors_with_text(pages).where((host(F.col("url")) == host(F.col("target"))) & F.contains("target", F.lit("?")))
    query = F.regexp_extract("target", r"\?([^#]*)", 1)
    return links.where(F.col("text").rlike(CONTACT_TEXTS) | query.rlike("(?i)inquiry|contact|form|CNo|uid")).select("page_id", "target").distinct()


def parameter_forms(pages: DataFrame, keep: int = 3) -> DataFrame:
    """page_id, form_url, score, candidates, remark: of each page the best form behind its links with a query that tells of contact, and the
    first so many in rank order. Links are joined with the stored pages that they lead to; those without a form give nothing."""
    address = F.regexp_replace("url", r"#.*$", "")
    links = parameter_links(pages).withColumnRenamed("page_id", "from_id")
    targets = pages.join(links.select(F.col("target").alias("t")).distinct().hint("merge"), address == F.col("t"), "left_semi")
    scored = scored_forms(targets, "parameter_link").select(address.alias("target"), "page_id", "pos", "score")
    met = links.hint("merge").join(scored, "target")
    order = Window.partitionBy("from_id").orderBy(F.desc("score"), "target", "page_id", "pos")
    first = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    said = F.concat_ws(":", "target", F.col("pos").cast("string"), F.col("score").cast("string"))
    best = first.groupBy(F.col("from_id").alias("page_id")).agg(F.min_by(F.struct("target", "score"), "rank").alias("b"), F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))).alias("all"))
    told = F.concat(F.lit("Found via parameter link (score: "), F.format_string("%.2f", F.col("b.score") / F.lit(100.0)), F.lit(")"))
    joined = F.array_join(F.transform("all", lambda c: c["said"]), ",")
    return best.select("page_id", F.col("b.target").alias("form_url"), (F.col("b.score") / F.lit(100.0)).alias("score"), joined.alias("candidates"), told.alias("remark"))


def guarded_forms(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """The queue rows of forms behind a captcha: url, form_url, captcha, company_name, email, form_action, form_method, required_fields, notes,
    status. profiles(page_id, company_name, email) may lack pages; of repeated ids the greatest values count."""
    named = lambda f: (f["name"] != "") & ~f["type"].isin("submit", "button", "reset", "hidden", "image") & f["required"]
    action = F.when(F.col("action") != "", F.coalesce(joined_url(F.col("url"), F.col("action")), "action"))
    rows = page_forms(pages).withColumn("captcha", captcha_type(F.col("html"))).where("captcha is not null").select(
        "page_id", "pos", "url", F.col("url").alias("form_url"), "captcha", action.alias("form_action"), F.when(F.col("method") == "", "POST").otherwise(F.col("method")).alias("form_method"),
        F.transform(F.filter("fields", named), lambda f: f["name"]).alias("required_fields"),
    )
    known = profiles.groupBy("page_id").agg(F.max("company_name").alias("company_name"), F.max("email").alias("email"))
    note = F.concat(F.lit("CAPTCHA detected during crawl. Manual intervention required."), F.coalesce(F.concat(F.lit(" Email found: "), "email"), F.lit("")))
    return rows.hint("merge").join(known, "page_id", "left").select(*rows.columns, "company_name", "email", note.alias("notes"), F.lit("pending").alias("status"))


def queue_summary(queue: DataFrame) -> DataFrame:
    """Counts and shares (% of the queue) by status and by captcha type, in one pass."""
    rows = queue.groupingSets([["status"], ["captcha"], []], "status", "captcha").agg(F.count("*").alias("n"), F.grouping("status").alias("s"), F.grouping("captcha").alias("c"))
    kind = F.when(F.col("s") == 0, "status").when(F.col("c") == 0, "captcha").otherwise("total")
    counts = rows.select(kind.alias("kind"), F.coalesce("status", "captcha").alias("name"), "n")
    total = counts.where("kind = 'total'").select(F.col("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("kind", "name", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("share"))  # one row


def submission_errors(responses: DataFrame) -> DataFrame:
    """id, url, error of the posts that ended in an error other than a captcha."""
    failed = captcha_routing(responses).where("status <> 'captcha_blocked'").select("id")
    return responses.hint("merge").join(failed, "id", "left_semi").select("id", "url", F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.lit("Unknown error")).alias("error"))


def captcha_type(html: Column) -> Column:
    return first_pattern(html, CAPTCHA)


def analysed_forms(pages: DataFrame) -> DataFrame:
    """Absolute action, method, hidden fields, captcha, way of submission and confidence of each form."""
    hidden = F.filter("fields", lambda f: (f["type"] == "hidden") & (f["name"] != ""))
    filled = lambda f: (f["name"] != "") & ~f["type"].isin("submit", "button", "reset", "hidden", "image")
    low = F.lower("form")
    ajax = low.rlike("ajax|submit") & low.rlike("onclick|onsubmit|fetch|axios|xhr")
    rows = page_forms(pages).select(
        "page_id", "pos", F.when(F.col("action") != "", F.coalesce(joined_url(F.col("url"), F.col("action")), "action")).otherwise("").alias("action"), F.when(F.col("method") == "", "POST").otherwise(F.col("method")).alias("method"),
        F.array_join(F.array_sort(F.transform(hidden, lambda f: F.concat_ws("=", f["name"], f["value"]))), "&").alias("hidden"), F.size(F.filter("fields", lambda f: filled(f) & f["required"])).alias("n_required"),
        F.exists("fields", lambda f: filled(f) & f["name"].rlike("(?i)email|mail|message|content")).alias("key_field"), captcha_type(F.col("html")).alias("captcha"),
        F.when(F.contains(low, F.lit("javascript")), "javascript").when(ajax, "ajax").otherwise("standard").alias("submission"),
    )
    score = (
        F.when(F.col("action") != "", 30).otherwise(10) + F.least(F.lit(20), 5 * F.col("n_required")) + F.when(F.col("key_field"), 20).otherwise(0) + F.when(F.col("captcha").isNull(), 20).otherwise(-10)
        + F.when(F.col("submission") == "standard", 10).when(F.col("submission") == "ajax", 5).otherwise(-5) + F.when(F.col("hidden") != "", 10).otherwise(0)
    )
    confidence = F.least(F.lit(100), F.greatest(F.lit(0), score)) / F.lit(100.0)
    return rows.select("page_id", "pos", "action", "method", "hidden", "captcha", "submission", F.col("n_required").cast("long").alias("n_required"), confidence.alias("confidence"))


def ajax_endpoints(pages: DataFrame) -> DataFrame:
    """Pages whose scripts send forms, what shows it, and where to."""
    script = F.concat_ws("\n", H.every(F.col("html"), r"(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>", 1))
    shown = F.filter(F.array(*[F.lit(p) for p in AJAX]), lambda p: F.regexp_like(script, p))
    rows = pages.where(F.contains(F.lower("html"), F.lit("<form"))).select("page_id", "url", shown.alias("shown"), extract(script, ENDPOINT).alias("target")).where(F.size("shown") > 0)
    return rows.select("page_id", F.size("shown").cast("long").alias("n_indicators"), joined_url(F.col("url"), F.col("target")).alias("endpoint"))


def csrf_tokens(pages: DataFrame) -> DataFrame:
    """Tokens in hidden fields, meta tags and scripts: page, where, name, value."""
    html = F.col("html")
    fields = F.transform(F.filter(H.every(html, H.FIELD), lambda t: (F.lower(H.attribute(t, "type")) == "hidden") & H.attribute(t, "name").rlike(f"(?i){CSRF}")), lambda t: F.struct(F.lit("hidden").alias("place"), H.attribute(t, "name").alias("name"), H.attribute(t, "value").alias("value")))
    metas = F.transform(F.filter(H.every(html, H.META), lambda t: H.attribute(t, "name").rlike("(?i)csrf")), lambda t: F.struct(F.lit("meta").alias("place"), H.attribute(t, "name").alias("name"), H.attribute(t, "content").alias("value")))
    found = F.regexp_extract(html, r"""(?is)<script(?:\s[^>]*)?>(?:(?!</script).)*?(?:csrf[_-]?token|_token)["']?\s*[:=]\s*["']([^"']+)""", 1)
    script = F.when(found != "", F.array(F.struct(F.lit("script").alias("place"), F.lit("_csrf_from_script").alias("name"), found.alias("value")))).otherwise(F.array().cast("array<struct<place:string,name:string,value:string>>"))
    return pages.where(html.rlike("(?i)csrf|token")).select("page_id", F.explode(F.concat(fields, metas, script)).alias("t")).select("page_id", "t.*")


def multi_step(pages: DataFrame) -> DataFrame:
    """Page rows whose forms have several steps, and what shows it; each within its row."""
    html = F.col("html")
    text = F.lower(H.inner_text(H.outside_scripts(html), " "))
    step = r"(?:step\s+(\d+)\s+of\s+(\d+)|ステップ\s*(\d+)\s*/\s*(\d+)|(\d+)\s*/\s*(\d+))"
    number = lambda text, groups: F.coalesce(*[extract(text, step, g) for g in groups]).cast("long")
    wizard = html.rlike(r"""(?i)class\s*=\s*["'][^"']*(?:wizard|step)""")
    parts = F.transform(F.when(F.contains(F.lower(html), F.lit("<form")), H.every(html, H.FORM)), form_parts)
    hidden = lambda x: F.filter(F.flatten(F.transform(x["parts"], lambda p: p["fields"])), lambda f: (f["type"] == "hidden") & f["name"].rlike("(?i)step|page"))
    onward = lambda x: F.exists(x["parts"], lambda p: F.coalesce(p["button"].rlike("(?i)next|次へ|continue|続ける"), F.lit(False)))
    shown = lambda x: F.concat_ws(
        "; ", F.when(F.rlike(x["text"], F.lit(step)), F.concat(F.lit("Step indicator: "), x["current_step"].cast("string"), F.lit("/"), x["total_steps"].cast("string"))),
        F.concat(F.lit("Hidden step field: "), F.get(hidden(x), F.lit(0))["name"]), F.when(onward(x), "Next/Continue button"), F.when(x["wizard"], "Wizard-like structure detected"),
    )
    counted = lambda x: F.struct(x["text"].alias("text"), x["wizard"].alias("wizard"), x["parts"].alias("parts"), number(x["text"], (1, 3, 5)).alias("current_step"), number(x["text"], (2, 4, 6)).alias("total_steps"))
    told = lambda x: F.struct(x["current_step"].alias("current_step"), x["total_steps"].alias("total_steps"), shown(x).alias("indicators"))
    # rows are sorted out within arrays: a filter on columns would work each of them out again
    page = F.filter(F.array(F.struct(text.alias("text"), wizard.alias("wizard"), parts.alias("parts"))), lambda x: F.size(x["parts"]) > 0)
    found = F.filter(F.transform(F.transform(page, counted), told), lambda x: x["indicators"] != "")
    return pages.where(F.contains(F.lower("html"), F.lit("<form"))).select("page_id", F.explode(found).alias("x")).select("page_id", "x.*")


def outcomes(responses: DataFrame) -> DataFrame:
    """Confidence that a post succeeded, by status, URL, words, validation errors and a form that is still there, with what speaks for and
    against it; and the strict rule."""
    content, url, back = F.lower(F.coalesce("content", F.lit(""))), F.col("url"), F.col("response_url")
    good, bad, form = hits(content, SUCCESS_WORDS), hits(content, ERROR_WORDS), content.rlike(r"<form[\s>]")
    status, moved = F.col("http_status"), ~back.eqNullSafe(url)
    told_form = F.when(~form, 0).when(content.rlike("thank|complete|success|confirm|確認|完了"), 10).when(~moved, -25).when(F.contains(F.lower(back), F.lit("error")), -30).otherwise(-5)
    score = (
        F.when(status.between(200, 299), 30).when(status.between(300, 399), 20).otherwise(-40) + F.when(moved, 10).otherwise(0) + F.when(moved & back.rlike(SUCCESS_URL), 25).otherwise(0)
        + F.least(F.lit(40), 10 * F.size(good)) - F.least(F.lit(40), 10 * F.size(bad)) - F.when(content.rlike(INVALID), 30).otherwise(0) + told_form
    )
    points = F.least(F.lit(100), F.greatest(F.lit(0), score))
    warnings = F.concat_ws("; ", F.when(F.size(bad) > 0, F.concat(F.lit("Error keywords: "), F.array_join(F.slice(bad, 1, 3), ", "))), F.when(content.rlike(INVALID), "Validation error detected"), F.when(told_form == -25, "Form still present on same page").when(told_form == -30, "Form on error page").when(told_form == -5, "Form still present"))
    code = F.concat(F.lit("HTTP "), status.cast("string"), F.when(status.between(200, 299), "").when(status.between(300, 399), " (redirect)").otherwise(" (error)"))
    known = F.get(F.filter(F.array(*[F.lit(x) for x in SUCCESS_URL.removeprefix("(?i)").split("|")]), lambda x: F.rlike(F.lower(back), x)), F.lit(0))
    indicators = F.concat_ws(
        "; ", code, F.when(moved, "URL changed"), F.when(moved, F.concat(F.lit("Success URL pattern: "), known)),
        F.when(F.size(good) > 0, F.concat(F.lit("Success keywords: "), F.array_join(F.slice(good, 1, 3), ", "))), F.when(told_form == 10, "Form on confirmation page (expected)"),
    )
    strict = content.rlike(STRICT_SUCCESS) & ~content.rlike(STRICT_ERROR) & ~form
    return responses.select("id", (points / F.lit(100.0)).alias("confidence"), (points >= 30).alias("success"), indicators.alias("indicators"), warnings.alias("warnings"), strict.alias("strict_success"))


def captcha_routing(responses: DataFrame) -> DataFrame:
    """Status and captcha type of each response with an error: captcha_blocked where the error tells of one."""
    low = F.lower("error")
    kind = F.when(low.contains("recaptcha v2"), "recaptcha_v2").when(low.contains("recaptcha v3"), "recaptcha_v3").when(low.contains("hcaptcha"), "hcaptcha").when(low.contains("image"), "image").otherwise("unknown")
    blocked = low.contains("captcha")
    return responses.where("error is not null").select("id", "url", F.when(blocked, "captcha_blocked").otherwise("failed").alias("status"), F.when(blocked, kind).alias("captcha"))


def review_queue(responses: DataFrame) -> DataFrame:
    """The queue rows of blocked posts: form, type, note."""
    note = F.concat(F.lit("CAPTCHA detected ("), "captcha", F.lit(") - queued for manual handling"))
    return captcha_routing(responses).where("status = 'captcha_blocked'").select("id", F.col("url").alias("form_url"), "captcha", F.lit("pending").alias("status"), note.alias("notes"))


def latest_queue(queue: DataFrame) -> DataFrame:
    """The last row of each form, completed ones dropped."""
    others = [c for c in queue.columns if c != "form_url"]
    last = queue.groupBy("form_url").agg(F.max_by(F.struct(*others), "id").alias("r"))
    return last.where("r.status <> 'completed'").select(*[f"r.{c}" if c != "form_url" else c for c in queue.columns])

"""Company names of pages: candidates of every detector in one array a page, the waterfall, the final rank and completion.

Confidences are whole hundredths until the last step. Full-width letters and signs are folded, the rest of NFKC is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions.text import any_of, bound, listed

#: Legal forms, labels, suffixes and marks of other text, as fixed values.
LEGAL = ["株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "一般社団法人", "一般財団法人", "公益社団法人", "公益財団法人", "特定非営利活動法人", "学校法人", "医療法人", "社会医療法人", "社会福祉法人", "宗教法人", "労働組合", "組合", "行政書士", "弁護士", "法務書士", "税理士", "公認会計士", "弁護士法人"]
EXCLUDED_LABELS = "項目|住所|価格|料金|費用|時間|金額|item|price|cost|fee|amount|メディア名|番組名|放送局|タイトル|出演|media|program|title|show|broadcast|加盟団体|所属団体|affiliated|member of|血液型|出身地|大好物|長所|短所|趣味|隠れた能力|保有資格|blood|origin|hobby|skill|qualification|tel|phone|fax|email".split("|")
PRIMARY_LABELS = "会社名|商号|法人名|企業名|正式名称|名称|社名|事業者名|法人の名称|屋号|法人名称|運営会社|運営法人|事務所名|事務所|店舗名|施設名|company name|company|会社|name|corporation|団体名".split("|")
SECONDARY_LABELS = "名前|name|組織|団体|organization".split("|")
TEXT_LABELS = "会社名|商号|法人名|企業名|正式名称|名称|社名|事業者名|法人の名称|屋号|法人名称|運営会社|運営法人|事務所名|事務所|店舗名|施設名|商　号|会 社 名|称号|社　名|事業所名|事業名|団体名"
SEO_SUFFIXES = "保険調査|調査会社|不動産|建設|コンサルティング|システム開発|福岡|東京|大阪|名古屋|札幌|仙台|横浜|京都|神戸|広島".split("|")
GARBAGE = "からの独立|の要項|の事業|のアクセス|の会社|を含む|グループ会社|代表|社長|住所|屋号|事業内容|概要|に相談|に伝える|ページトップ|へ戻る"
DATE = r"(?:令和|平成|昭和|進字)[0-9]+年|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[令平昭]\w+[0-9]+年[0-9]{1,2}月[0-9]{1,2}日"
FORM_MARKS, MENU_WORDS, LONG_FORMS = "必須|※|任意|required", "選び方|Q&A|生産終了|ガイド|一覧|メニュー".split("|"), "特定非営利活動法人|一般社団法人|一般財団法人"
NAV = r"^▲.*へ$|^→|メニュー$|一覧$|^Page\s+Top|^このページの|メニュー|ナビ|目次|(?i)menu|nav|一覧|カテゴリ|category|tag|search"
CUTS = "代表|所在地|住所|電話|TEL|〒|東京都|大阪府|京都府|北海道|千葉県|神奈川県|埼玉県|茨城県|栃木県|群馬県|宮城県|福島県|山形県|岩手県|秋田県|青森県|愛知県|三重県|岐阜県|静岡県|山梨県|長野県|福岡県|佐賀県|長崎県|熊本県|大分県|宮崎県|鹿児島県|沖縄県|広島県|岡山県|鳥取県|島根県|山口県|兵庫県|奈良県|和歌山県|滋賀県|新潟県|富山県|石川県|福井県|香川県|徳島県|愛媛県|高知県|市|区|町|村".split("|")
DESCRIPTORS = "会社案内|会社概要|企業情報|企業概要|について|のご案内|のご紹介|紹介|トップ|ホーム|HOME|TOP|Company|About|Overview|Profile".split("|")
BRANDS = r"ドットコム|ドット|\.com|さん|くん|ちゃん|オンライン|ネット|web|Web| (?:京都|東京|大阪|福岡|札幌)$"
#: Phase and least confidence with which a method's candidate is taken at once.
PHASES = {"json_ld": (0, 96), "table_field": (1, 95), "dl_field": (1, 95), "semantic_pair": (2, 93), "title": (3, 85), "black_square": (4, 97), "footer": (5, 92), "footer_img": (5, 92), "explicit_label": (6, 93)}
INTRODUCTIONS = "事務所概要|事務所案内|会社概要|会社案内|ご案内|について|紹介|案内|概要"
DESIGNATIONS = "行政書士|弁護士|司法書士|税理士|公認会計士|社会保険労務士|弁理士"
NAV_ALTS = r"(?i)about|案内|ガイド|guide|menu|メニュー|home|ホーム|top|トップ|back|戻る|logo|ロゴ|nav|icon|button"
BUSINESS = "探偵事務所|調査事務所|探偵社|調査会社|法律事務所|会計事務所|コンサルティング"
MERGED_LABELS, STOPS = "事務所名|会社名|法人名|名称", "代表|所在地|連絡先|TEL|電話|FAX|(?i:e-mail)|Email"
CANDIDATE = "array<struct<method:string,name:string,conf:int,legal:boolean>>"


def array(words: list[str]) -> Column:
    return listed(words)


def holds(text: Column, words: list[str]) -> Column:
    return text.rlike(any_of(words))


def repaired(text: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1, read anew; other text as it is."""
    narrow = lambda t: t.rlike(r"^[\x00-\xFF]*[\x80-\xFF][\x00-\xFF]*$")
    return bound(text, lambda t: F.coalesce(F.when(narrow(t), F.try_validate_utf8(F.encode(F.when(narrow(t), t), "ISO-8859-1").cast("string"))), t))


def clean(text: Column) -> Column:
    """Read anew where its encoding was mistaken; full-width letters, digits and signs folded, white space squeezed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.trim(F.regexp_replace(F.translate(repaired(text), wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "), r"\s+", " "))


def without_seo(text: Column) -> Column:
    cut = lambda text: reduce(lambda t, s: F.trim(F.regexp_replace(t, s + "$", "")), SEO_SUFFIXES, text)
    return bound(text, lambda t: F.when(t.rlike(any_of(SEO_SUFFIXES) + r"[\s\x{85}\x{2028}\x{2029}]*\z"), cut(t)).otherwise(F.trim(t)))  # most texts end otherwise


def has_legal(name: Column) -> Column:
    return name.rlike(any_of(LEGAL))


def valid(name: Column) -> Column:
    """Whether a text can be a name: length, no sentence, form or menu text, and letters of a script."""
    n = F.char_length(name)
    particles = F.regexp_count(name, F.lit("にて|から|まで|なら|への"))
    return (
        (n >= 2) & ((n <= 30) | (n <= 80) & name.rlike(LONG_FORMS)) & ~name.rlike(f"{FORM_MARKS}|Q&A|生産終了品|。|(?:ます|です|ください|ませ)$")
        & (~holds(name, MENU_WORDS) | (F.size(F.filter(array(MENU_WORDS), lambda w: F.contains(name, w))) < 2)) & (particles < 2) & (name.rlike(r"[一-鿿぀-ヿ]") | (F.regexp_count(name, F.lit("[a-zA-Z]")) > 3))
    )


def label_boost(label: Column) -> Column:
    """How surely a label announces a company name: 100, 95 or 85; null if it doesn't."""
    x = F.struct(label.alias("label"), F.lower(F.trim(label)).alias("low"), F.regexp_replace(label, r"\s+", "").alias("bare"))
    both = lambda x, w: F.contains(x["label"], w) | F.contains(x["low"], w)
    held = lambda x, words: holds(x["label"], words) | holds(x["low"], words)
    first = lambda x: F.when(held(x, PRIMARY_LABELS) | x["bare"].isin(PRIMARY_LABELS), F.get(F.filter(array(PRIMARY_LABELS), lambda w: both(x, w) | (w == x["bare"])), F.lit(0)))
    second = lambda x: F.when(held(x, SECONDARY_LABELS), F.when(~x["label"].rlike("概要|(?i)overview"), 85))
    sure = lambda x, w: F.when(w.isNotNull(), F.when((w == x["label"]) | (w == x["bare"]), 100).otherwise(95)).otherwise(second(x))
    return bound(x, lambda x: F.when((x["label"] == "") | held(x, EXCLUDED_LABELS), None).otherwise(bound(first(x), lambda w: sure(x, w))))


def unmixed(text: Column) -> Column:
    """The name at the start of a text that holds an address or a person too."""
    parts = F.transform(F.filter(array(CUTS), lambda c: F.contains(text, c)), lambda c: F.trim(F.split_part(text, c, F.lit(1))))
    first = F.get(F.filter(parts, valid), F.lit(0))
    return F.when(text.rlike("^" + any_of(LEGAL)), F.coalesce(first, F.when(F.char_length(text) <= 50, text), text)).otherwise(text)


def candidate(method: str, name: Column, conf: Column) -> Column:
    """name: what is cheap to work out thrice, a bound one."""
    return F.struct(F.lit(method).alias("method"), name.alias("name"), conf.cast("int").alias("conf"), has_legal(name).alias("legal"))


def when_valid(found: Column, garbage: bool = True) -> Column:
    """Those candidates of an array whose names are valid."""
    return F.filter(found, lambda c: valid(c["name"]) & (~c["name"].rlike(GARBAGE) if garbage else F.lit(True)))


def labelled(pairs: Column, method: str, legal: int, base: int, garbage: bool) -> Column:
    """Candidates of (label, value) pairs whose label announces a name; step by step, so that no step is written out twice. Few labels do, so they are read first."""
    known = F.filter(F.transform(pairs, lambda p: F.struct(label_boost(repaired(p["label"])).alias("boost"), p["value"].alias("value"))), lambda p: p["boost"].isNotNull())
    read = F.transform(known, lambda p: F.struct(p["boost"], repaired(p["value"]).alias("value")))
    fit = F.filter(read, lambda p: ~p["value"].rlike(DATE) & valid(p["value"]))
    named = F.transform(F.transform(fit, lambda p: F.struct(p["boost"], clean(without_seo(p["value"])).alias("value"))), lambda p: F.struct(p["boost"], unmixed(p["value"]).alias("name")))
    fuller = lambda name: completeness(name) * 0.02 if method == "table_field" else F.lit(0)
    sure = lambda p: F.when(has_legal(p["name"]), legal).otherwise(base + 4 * p["boost"] / 100) + fuller(p["name"])
    return when_valid(F.transform(named, lambda p: candidate(method, p["name"], F.least(F.lit(99), sure(p)))), garbage)


def detected(html: Column) -> Column:
    """The candidates of all detectors of a page, in the order of the phases."""
    none = F.array().cast(CANDIDATE)
    text = H.inner_text(H.outside_scripts(html), " ")
    pair = lambda a, b: F.struct(a.alias("label"), b.alias("value"))
    blocks = F.filter(H.every(html, H.JSON_LD, 1), lambda b: F.lower(F.coalesce(F.get_json_object(b, "$['@type']"), F.get_json_object(b, "$[0]['@type']"))).contains("organization"))
    tail = r"[‣›•▸▹►\s]+$"
    json = F.transform(F.transform(blocks, lambda b: F.trim(F.regexp_replace(F.coalesce(F.get_json_object(b, "$.name"), F.get_json_object(b, "$[0].name")), tail, ""))), lambda name: candidate("json_ld", name, F.lit(96)))
    og = lambda name, conf: F.slice(F.filter(F.transform(F.split(F.coalesce(H.meta_content(html, name), F.lit("")), r"[|｜/\-]"), lambda p: bound(F.trim(F.regexp_replace(F.trim(p), tail, "")), lambda name: candidate("meta_tag", name, F.lit(conf)))), lambda c: valid(c["name"]) & c["legal"] & ~c["name"].rlike("ご相談|お問い合わせ|ください|選び")), 1, 1)
    tables = F.filter(F.transform(H.every(html, H.TABLE, 1), lambda t, i: F.when((i == 0) | ~H.inner_text(t).rlike("関連会社|子会社|パートナー"), t)), lambda t: t.isNotNull())
    cells = F.filter(F.transform(F.flatten(F.transform(tables, lambda t: H.every(t, H.ROW, 1))), lambda r: F.transform(H.every(r, H.CELL, 1), lambda x: H.inner_text(x))), lambda c: F.size(c) >= 2)
    rows = F.transform(cells, lambda c: pair(c[0], c[1]))
    dls = F.transform(H.every_pair(html, H.PAIR, 1, 2), lambda x: pair(H.inner_text(x["a"]), H.inner_text(x["b"])))
    heads = F.transform(H.every_pair(html, r"(?is)<h[23](?:\s[^>]*)?>([^<]*)</h[23]\s*>(?=\s*(?:<(?:h[1-6]|nav)(?:\s[^>]*)?>[^<]*</(?:h[1-6]|nav)\s*>\s*)*<(?:div|span|p|td|dd)(?:\s[^>]*)?>([^<]*))", 1, 2), lambda x: pair(F.trim(x["a"]), F.trim(x["b"])))
    heads = F.filter(heads, lambda p: F.char_length(p["value"]).between(3, 80) & ~p["value"].rlike(NAV) & label_boost(p["value"]).isNull())
    title = H.inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))
    parts = lambda t: F.filter(F.transform(F.split(t, r"[|｜～]| - | — "), lambda x: F.trim(x)), lambda p: F.char_length(p).between(3, 60) & ~p.rlike("ご相談|サービス|news|blog|サイト"))
    cut = bound(title, lambda t: F.when(t.rlike(r"[|｜～]| - | — "), parts(t)).otherwise(F.array().cast("array<string>")))
    titles = when_valid(F.transform(cut, lambda p: bound(clean(without_seo(p)), lambda name: candidate("title", name, F.lit(84)))))
    pure = lambda titles: F.filter(titles, lambda c: c["legal"] & ~holds(c["name"], DESCRIPTORS))
    strip = lambda c: F.trim(F.regexp_replace(c["name"], "^(?:" + "|".join(DESCRIPTORS) + ")|(?:" + "|".join(DESCRIPTORS) + ")$", ""))
    renamed = lambda c, s: F.when((s != c["name"]) & valid(s), candidate("title", s, F.when(c["legal"], 90).otherwise(86))).otherwise(candidate("title", c["name"], F.when(c["legal"], 88).otherwise(84)))
    stripped = lambda titles: F.transform(titles, lambda c: bound(strip(c), lambda s: renamed(c, s)))
    rank = lambda c: F.struct(holds(c["name"], DESCRIPTORS).alias("d"), (~c["legal"]).alias("l"), (-c["conf"]).alias("c"), F.char_length(c["name"]).alias("n"))
    by = lambda key: lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
    shortest = lambda found: F.slice(F.transform(F.array_sort(found, by(lambda c: F.char_length(c["name"]))), lambda c: candidate("title", c["name"], F.lit(88))), 1, 1)
    of = lambda titles: bound(pure(titles), lambda found: F.when(F.size(found) > 0, shortest(found)).otherwise(F.slice(F.array_sort(stripped(titles), by(rank)), 1, 1)))
    best_title = bound(titles, of)
    marks = H.every(html, r"(?is)■([^■]*?(?:名　+称|商　*号|会社名|法人名|企業名)[^■]*?)(?:<br|\n)", 1)
    marked = F.transform(F.transform(marks, lambda m: clean(F.regexp_replace(m, r"<[^>]+>", ""))), lambda m: F.regexp_extract(m, rf"(?:{TEXT_LABELS})(.*?)(?:■|東京|〒|TEL|代表|所在地|$)", 1))
    bare = F.transform(marked, lambda m: F.trim(F.regexp_replace(clean(without_seo(F.trim(m))), r"[（(][^）)]*[）)]", "")))
    squares = when_valid(F.transform(F.transform(bare, unmixed), lambda m: candidate("black_square", m, F.when(has_legal(m), 97).otherwise(96))))
    footer = H.footer_text(html)
    copies = F.transform(H.every(footer, r"(?i)Copyright\s*(?:\(C\)|©)\s*[0-9]{0,4}\s*(.+?)(?:\s+All Rights Reserved|$)", 1), lambda m: bound(clean(m), lambda name: candidate("footer", name, F.when(has_legal(m), 94).otherwise(91))))
    alts = lambda part: F.transform(H.every(part, r"(?i)<img\s[^>]*>"), lambda t: clean(H.attribute(t, "alt")))
    images = F.transform(F.filter(alts(F.regexp_extract(html, r"(?is)<footer[^>]*>(.*?)(?:</footer|\z)", 1)), lambda a: (F.char_length(a) >= 5) & (has_legal(a) | a.rlike("役場|割|事務所|オフィス"))), lambda a: candidate("footer_img", a, F.lit(92)))
    heading = F.transform(H.every(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1", 1), lambda h: clean(H.inner_text(h)))
    piped = F.filter(F.transform(F.flatten(F.transform(F.filter(heading, lambda h: F.contains(h, F.lit("|"))), lambda h: F.split(h, r"\|"))), lambda x: F.trim(x)), lambda p: ~F.lower(p).rlike("概要|案内|について|とは|overview|about|info") & (has_legal(p) | p.rlike("司法書士|事務所|オフィス")))
    h1 = F.slice(when_valid(F.transform(piped, lambda p: candidate("h1_smart_split", p, F.when(has_legal(p), 94).otherwise(91)))), 1, 1)
    said = F.regexp_extract(text, any_of(TEXT_LABELS.split("|")) + r"\s*[:：]\s*([぀-ヿ一-鿿0-9ー]{2,50})", 1)
    told = bound(said, lambda s: F.when((s != "") & ~s.rlike(DATE), when_valid(F.transform(F.array(clean(without_seo(s))), lambda name: candidate("text_pattern_label", name, F.lit(85))))).otherwise(none))
    meta = bound(og("og:site_name", 95), lambda m: F.when(F.size(m) > 0, m).otherwise(og("og:title", 90)))
    return F.concat(
        F.slice(when_valid(json, False), 1, 1), meta, labelled(rows, "table_field", 99, 95, True), labelled(dls, "dl_field", 98, 94, False),
        F.slice(labelled(heads, "semantic_pair", 96, 93, True), 1, 1), best_title, squares, when_valid(F.filter(copies, lambda c: F.char_length(c["name"]) >= 5), False), when_valid(images, False), h1, told,
    )


def more_detected(html: Column) -> Column:
    """Weaker candidates: labels with the value in one element, images, headings with a legal form or a trade, and introductions."""
    pair = lambda a, b: F.struct(a.alias("label"), b.alias("value"))
    merged = F.transform(H.every(html, r"(?is)<dt(?:\s[^>]*)?>(.*?)(?=</dt|<dt[\s>]|<dd[\s>]|</dl|\z)", 1), lambda t: F.regexp_extract(H.inner_text(t, " "), rf"(?:{MERGED_LABELS})(.*?)(?:{STOPS}|$)", 1))
    dts = when_valid(F.transform(F.filter(F.transform(merged, lambda m: clean(m)), lambda m: F.char_length(m) >= 3), lambda m: candidate("dt_merged", m, F.when(has_legal(m), 97).otherwise(94))))
    rows = F.transform(F.filter(F.transform(H.every(html, H.ROW, 1), lambda r: F.transform(H.every(r, H.CELL, 1), lambda x: H.inner_text(x))), lambda c: F.size(c) >= 2), lambda c: pair(c[0], c[1]))
    both = lambda pattern, a, b: F.transform(H.every_pair(html, pattern, a, b), lambda x: pair(H.inner_text(x["a"]), H.inner_text(x["b"])))
    told = F.filter(F.concat(rows, both(H.PAIR, 1, 2), both(H.SIBLINGS, 2, 4)), lambda p: p["label"].rlike(TEXT_LABELS) & ~p["value"].rlike(DATE))
    labels = when_valid(F.filter(F.transform(F.transform(told, lambda p: clean(without_seo(p["value"]))), lambda v: candidate("explicit_label", v, F.lit(93))), lambda c: F.char_length(c["name"]) >= 5), False)
    alts = lambda tag: F.transform(H.every(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)(?:</{tag}|\z)", 1), r"(?i)<img\s[^>]*>"), lambda t: clean(H.attribute(t, "alt")))
    named = F.filter(F.concat(alts("header"), alts("footer")), lambda a: ~a.rlike(NAV_ALTS) & (has_legal(a) | a.rlike("事務所|オフィス|会社|法人")))
    images = when_valid(F.filter(F.transform(F.transform(named, lambda a: F.trim(F.regexp_extract(a, "^([^〒【】]*)", 1))), lambda a: candidate("img_alt", a, F.when(has_legal(a), 92).otherwise(89))), lambda c: F.char_length(c["name"]).between(5, 60)), False)
    heading = lambda n: F.transform(H.every(html, rf"(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}", 1), lambda h: clean(H.inner_text(h)))
    forms = "|".join(LEGAL)
    first = lambda h: F.coalesce(*[bound(F.regexp_extract(h, rf"^((?:{forms}).*?){d}", 1), lambda p: F.when(F.char_length(p).between(5, 40), F.trim(p))) for d in ("での", "による", "へ", "の")], h)
    starts = lambda whole: F.transform(F.transform(F.filter(whole, lambda h: h.rlike(f"^(?:{forms})")), first), lambda name: candidate("h1_smart_split", name, F.lit(94)))
    holding = lambda whole: F.transform(F.filter(whole, lambda h: has_legal(h) & ~h.rlike(f"^(?:{forms})")), lambda h: F.coalesce(F.nullif(F.trim(F.regexp_extract(h, rf"^(.+?(?:{forms}).*?)(?: |での|による|の|へ|、)", 1)), F.lit("")), h))
    split = lambda whole: F.slice(when_valid(F.concat(starts(whole), F.transform(holding(whole), lambda h: candidate("h1_smart_split", h, F.lit(93))))), 1, 1)
    trades = lambda whole: F.filter(whole, lambda h: h.rlike(BUSINESS) & ~has_legal(h))
    trade = lambda whole: F.slice(when_valid(F.transform(F.transform(trades(whole), lambda h: F.coalesce(F.nullif(F.regexp_extract(h, "^(.{2,}?)(?: |での|なら|へ|の)", 1), F.lit("")), h)), lambda h: candidate("business_name", h, F.lit(88))), False), 1, 1)
    headed = bound(F.filter(heading(1), lambda h: ~F.contains(h, F.lit("|"))), lambda whole: F.concat(split(whole), trade(whole)))
    texts = F.concat(heading(1), heading(2), F.array(clean(H.inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)))))
    left = lambda texts: F.filter(F.transform(texts, lambda t: F.regexp_replace(F.regexp_extract(t, f"^(.*?)の?(?:{INTRODUCTIONS})$", 1), r"[\s|-]+$", "")), lambda t: has_legal(t) | t.rlike(DESIGNATIONS))
    introduced = lambda texts: F.transform(left(texts), lambda t: candidate("title_intro", F.regexp_replace(t, f"^(?:{DESIGNATIONS})+", ""), F.when(has_legal(t), 90).otherwise(88)))
    kinds = r"^(.*?(?:事務所|オフィス)|.*?(?=法人|株式会社|会社|協会|組合))(?:法人|株式会社|会社|協会|組合)?の(?:" + INTRODUCTIONS + ")"
    offices = lambda texts: F.transform(F.filter(F.transform(texts, lambda t: F.regexp_extract(t, kinds, 1)), lambda t: t != ""), lambda t: candidate("title_intro", t, F.when(has_legal(t), 89).otherwise(87)))
    return F.concat(dts, labels, images, headed, F.slice(when_valid(bound(texts, lambda texts: F.concat(introduced(texts), offices(texts)))), 1, 1))


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, pos, method, name, conf, legal: every name that a detector finds, in order of discovery, each name once a method."""
    found = pages.select("page_id", F.posexplode(bound(F.col("html"), lambda html: F.concat(detected(html), more_detected(html)))).alias("pos", "c"))
    return found.groupBy("page_id", "c.method", "c.name").agg(F.min("pos").cast("long").alias("pos"), F.max("c.conf").cast("long").alias("conf"), F.first("c.legal").alias("legal"))


def ranking(method: Column, name: Column, conf: Column, legal: Column, pos: Column) -> Column:
    """The order of candidates as a struct that begins with the phase, the least first: the first phase with a candidate over its threshold gives
    the name; else the final rank does (phase 9)."""
    rows = [F.lit(x) for m, (p, c) in PHASES.items() for x in (m, p * 1000 + c)]
    rule = F.element_at(F.create_map(*rows), method)
    at_once = (conf >= rule % 1000) & ((method != "json_ld") | legal & ~name.rlike(r"[|｜]"))
    phase = F.coalesce(F.when(at_once, F.floor(rule / 1000)), F.lit(9)).cast("long")
    last = phase == 9
    structured = F.when(last & method.isin("dl_field", "table_field", "black_square"), -3).otherwise(0)
    titled = F.when(last & (method == "title") & (conf >= 88), -2).otherwise(0)
    return F.struct(phase.alias("phase"), structured.alias("a"), titled.alias("b"), F.when(last, ~legal).alias("c"), (-conf).alias("d"), F.when(last, F.char_length(name)).alias("e"), pos.alias("pos"))


def chosen(found: DataFrame) -> DataFrame:
    """One name a page, by the order of candidates."""
    order = ranking(*(F.col(c) for c in ("method", "name", "conf", "legal", "pos")))
    best = found.groupBy("page_id").agg(F.min(F.struct(order.alias("order"), "name", "method", "conf", "legal")).alias("b"))
    return best.select("page_id", "b.name", "b.method", "b.conf", "b.legal", "b.order.phase")


def page_text(html: Column) -> Column:
    return H.inner_text(H.outside_scripts(html), " ")


def completion(text: Column, c: Column) -> Column:
    """struct(company_name, conf, completed) of a chosen name c(name, conf, legal, phase). One of the final rank without a legal form gets one: that which
    stands beside the name, else the page's commonest, else the usual one."""
    name = c["name"]
    first = lambda test: F.get(F.filter(array(LEGAL), test), F.lit(0))
    near = lambda t: first(lambda e: F.contains(t, F.concat(e, name)) | F.contains(t, F.concat(e, F.lit(" "), name)))
    behind = lambda t: first(lambda e: F.contains(t, F.concat(name, e)) | F.contains(t, F.concat(name, F.lit(" "), e)))
    counts = lambda t: F.filter(F.transform(array(LEGAL), lambda e, i: F.struct((F.length(t) - F.length(F.replace(t, e))).alias("n"), (-i).alias("i"), e.alias("e"))), lambda x: x["n"] > 0)
    often = lambda t: F.array_max(F.transform(counts(t), lambda x: F.struct((x["n"] / F.length(x["e"])).alias("n"), x["i"], x["e"])))["e"]
    wants = (c["phase"] == 9) & ~c["legal"] & ~name.rlike(BRANDS)
    beside = lambda t: F.coalesce(F.concat(near(t), name), F.concat(name, behind(t)))
    told = lambda whole, conf, wants: F.struct(whole.alias("company_name"), conf.alias("conf"), F.lit(wants).alias("completed"))
    made = lambda t: bound(beside(t), lambda b: F.when(b.isNotNull(), told(b, c["conf"], True)).otherwise(told(F.concat(F.coalesce(often(t), F.lit("株式会社")), name), F.least(c["conf"], F.lit(82)), True)))
    # the text is made only where it is looked at
    return F.when(wants, bound(text, made)).otherwise(told(name, c["conf"], False))


def completed(pages: DataFrame, names: DataFrame) -> DataFrame:
    """The chosen names, completed. Of pages that share an id the one with the least text counts."""
    texts = pages.select("page_id", page_text(F.col("html")).alias("text")).groupBy("page_id").agg(F.min("text").alias("text"))
    rows = names.hint("shuffle_hash").join(texts, "page_id").select("page_id", "method", completion(F.col("text"), F.struct("name", "conf", "legal", "phase")).alias("c"))
    return rows.select("page_id", "c.company_name", "method", (F.col("c.conf") / F.lit(100.0)).alias("confidence"), "c.completed")


def best_in_row(html: Column) -> Column:
    """The name of one page as a struct(company_name, conf, completed), null if none: what chosen() and completed() find, without leaving the row."""
    found = F.concat(detected(html), more_detected(html))
    order = lambda c, i: ranking(c["method"], c["name"], c["conf"].cast("long"), c["legal"], i.cast("long"))
    ranks = F.transform(found, lambda c, i: F.struct(order(c, i).alias("order"), c["name"].alias("name"), c["conf"].cast("long").alias("conf"), c["legal"].alias("legal")))
    chosen_ = lambda best: F.struct(best["name"].alias("name"), best["conf"].alias("conf"), best["legal"].alias("legal"), best["order"]["phase"].alias("phase"))
    return bound(F.array_min(ranks), lambda best: F.when(best.isNotNull(), completion(page_text(html), chosen_(best))))


def surely_completed(text: Column, name: Column, rewrite: bool = False) -> Column:
    """The name with the legal form that the text shows beside it, else with one that the text has twice or more, else with one
    within 50 characters of it; null if none. rewrite: the reference's change of 有限会社 to 株式会社, off by default."""
    squeezed = lambda t: F.regexp_replace(t, r"\s+", "")
    first = lambda test: F.get(F.filter(array(LEGAL), test), F.lit(0))
    times = lambda low: F.filter(F.transform(array(LEGAL), lambda e, i: F.struct(((F.length(low) - F.length(F.replace(low, e))) / F.length(e)).alias("n"), (-i).alias("i"), e.alias("e"))), lambda c: c["n"] >= 2)
    around = lambda x, at: F.substring(x["low"], F.greatest(F.lit(1), at - 50), F.length(x["bare"]) + 100)
    near = lambda x: bound(F.instr(x["low"], x["bare"]), lambda at: F.when(at > 0, bound(around(x, at), lambda part: first(lambda e: F.contains(part, e)))))
    # each way is worked out once, and only where those before it find nothing; a form is never empty
    whole = lambda x: F.coalesce(
        F.concat(first(lambda e: F.contains(x["squeezed"], F.concat(e, x["tight"]))), x["name"]), F.concat(x["name"], first(lambda e: F.contains(x["squeezed"], F.concat(x["tight"], e)))),
        F.concat(F.array_max(times(x["low"]))["e"], x["name"]), F.concat(near(x), x["name"]),
    )
    parts = lambda y: F.struct(y["low"].alias("low"), y["bare"].alias("bare"), squeezed(y["low"]).alias("squeezed"), squeezed(y["bare"]).alias("tight"), y["name"].alias("name"))
    out = bound(bound(F.struct(F.lower(text).alias("low"), F.lower(name).alias("bare"), name.alias("name")), parts), whole)
    return F.replace(out, F.lit("有限会社"), F.lit("株式会社")) if rewrite else out


def completeness(name: Column) -> Column:
    """How full a name is, in hundredths."""
    parts, n = F.size(F.split(name, "　")), F.char_length(name)
    score = F.when(parts >= 3, 30).when(parts >= 2, 15).otherwise(0) + F.when(name.rlike("略称|：|:"), 30).otherwise(0) + F.when(name.rlike("（.*）"), 25).otherwise(0) + F.when(F.contains(name, F.lit("・")), 10).otherwise(0) + F.when(n > 20, 15).when(n > 15, 8).otherwise(0)
    return F.least(score, F.lit(100))


def basic_names(pages: DataFrame) -> DataFrame:
    """The title up to its first dash or bar, else og:title."""
    title = H.inner_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1))
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace(title, r"\s*[-|].*$", "")), F.lit("")), H.meta_content(F.col("html"), "og:title"))
    return pages.select("page_id", name.alias("name"))


def info_page_names(pages: DataFrame, names: DataFrame, most: int = 15) -> DataFrame:
    """Candidates of a site's information pages for each of its pages: at most so many pages a site, by path."""
    site = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    info = pages.where(F.col("url").rlike(r"(?i)^https?://[^/?#]+/(?:[^?#]*/)?(?:company|about|gaiyou|profile|corporate|outline)")).select(site.alias("site"), "page_id", "url")
    first = F.row_number().over(Window.partitionBy("site").orderBy("url", "page_id"))
    info = info.withColumn("rn", first).where(F.col("rn") <= most)
    best = info.join(names.hint("merge"), "page_id").groupBy("site").agg(F.max(F.struct("conf", "name")).alias("m"), F.countDistinct("page_id").alias("n_pages"))
    return pages.select("page_id", site.alias("site")).join(best.hint("merge"), "site").select("page_id", "site", F.col("m.name").alias("name"), "n_pages")

"""Industry of pages by keyword counts over structured data, meta tags and headings; and of free texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions.structured import json_nodes, text_of
from leadmill.functions.text import any_of, bound

#: Keywords by industry, in order of precedence, and their names. Fixed values.
KEYWORDS = {
    "technology": "IT|情報技術|ソフトウェア|テクノロジー|システム開発|クラウド|AI|人工知能|情報システム|システムインテグレーション", "finance": "金融|銀行|保険|証券|投資|資産運用|ファイナンス|信用金庫|信用組合|証券会社", "retail": "小売|ショップ|店舗|EC|ECサイト|オンラインショップ|通販|ネットショップ|百貨店|スーパー",
    "healthcare": "医療|病院|クリニック|ヘルスケア|製薬|薬品|医療機器|診療所|医院|薬局", "education": "教育|学校|大学|学習|トレーニング|アカデミー|スクール|塾|予備校|専門学校", "manufacturing": "製造|工場|生産|工業|メーカー|製造業|生産管理|工場管理", "construction": "建設|建築|工事|土木|エンジニアリング|建築設計|施工管理",
    "real_estate": "不動産|住宅|マンション|土地|賃貸|不動産管理|宅地建物取引", "food": "食品|レストラン|飲食|外食|飲料|フードサービス|食品製造|食品加工", "automotive": "自動車|車|カー|モビリティ|自動車関連|自動車部品|自動車販売", "energy": "エネルギー|電力|電気|再生可能エネルギー|太陽光|風力|発電|電力会社",
    "logistics": "物流|運輸|配送|輸送|サプライチェーン|運送|倉庫|物流センター", "consulting": "コンサルティング|コンサル|アドバイザリー|経営コンサル|経営相談", "media": "メディア|出版|放送|エンターテインメント|広告|広告代理店|テレビ|ラジオ", "telecommunications": "通信|テレコム|モバイル|無線|通信事業|通信会社|携帯電話",
    "investigation": "探偵|調査|興信所|探偵事務所|調査会社|身元調査|素行調査", "legal": "法律|法務|弁護士|司法書士|行政書士|法律事務所", "accounting": "会計|税理士|公認会計士|会計事務所|税務",
}
NAMES = {
    "technology": "IT・情報技術", "finance": "金融", "retail": "小売", "healthcare": "医療・ヘルスケア", "education": "教育", "manufacturing": "製造業", "construction": "建設・建築", "real_estate": "不動産", "food": "飲食・食品", "automotive": "自動車", "energy": "エネルギー", "logistics": "物流・運輸",
    "consulting": "コンサルティング", "media": "メディア・広告", "telecommunications": "通信", "investigation": "探偵・調査業", "legal": "法務・法律サービス", "accounting": "会計・税務",
}
DEFAULT = "その他サービス"
SCHEMA_TYPES = {"softwareapplication": "technology", "financialservice": "finance", "store": "retail", "hospital": "healthcare", "school": "education"}
ENGLISH = {
    "technology": "tech|software|it|technology", "finance": "finance|banking|financial|investment", "retail": "retail|shop|store|e-commerce", "healthcare": "health|medical|hospital|clinic", "education": "education|school|university|learning", "manufacturing": "manufacturing|factory|production",
}
FREE_TEXT = {
    "technology": "it|システム|ソフトウェア|クラウド|ai|人工知能|tech|テック|アプリ|ウェブ|デジタル", "finance": "銀行|金融|証券|保険|投資|ファイナンス|ファイナンシャル|バンク", "retail": "小売|ショップ|ec|eコマース|販売|店舗|リテール|ストア", "healthcare": "医療|病院|クリニック|診療|医学|薬局|製薬|ヘルスケア|メディカル",
    "education": "教育|学校|大学|学習|スクール|トレーニング|エデュケーション|アカデミー", "manufacturing": "製造|製造業|工場|生産|メーカー|加工|マニュファクチャリング", "construction": "建設|建築|工事|土木|エンジニアリング|コンストラクション", "real_estate": "不動産|住宅|マンション|賃貸|土地|リアルエステート",
    "food": "飲食|レストラン|食品|外食|カフェ|ベーカリー|フード", "automotive": "自動車|車|カー|モビリティ|auto|オートモーティブ", "energy": "エネルギー|電力|電気|再生可能|太陽光|発電|風力|パワー", "logistics": "物流|運送|配送|輸送|サプライチェーン|ロジスティクス|デリバリー",
    "consulting": "コンサルティング|コンサル|経営|アドバイザリー|コンサルタント", "media": "メディア|出版|放送|テレビ|ラジオ|ad|広告|パブリッシング", "telecommunications": "通信|テレコム|モバイル|isp|キャリア", "other_services": "結婚|ウェディング|葬祭|冠婚葬祭|サービス|介護|保育|ブライダル|婚活",
}


def table_of(keywords: dict[str, str]) -> Column:
    """The keywords as a constant array of structs(industry, place, words)."""
    row = lambda i, name, words: f"struct('{name}' AS industry, {-i} AS place, array({', '.join(repr(w) for w in words.split('|'))}) AS words)"
    return F.expr(f"array({', '.join(row(i, name, words) for i, (name, words) in enumerate(keywords.items()))})")


def best_match(text: Column) -> Column:
    """The industry with most keywords in a text, the first one at a tie; null if none. A text is in lower case, as keywords in capitals never match."""
    held = lambda g, t: F.size(F.filter(g["words"], lambda w: F.contains(t, w)))
    best = lambda t: F.array_max(F.transform(table_of(KEYWORDS), lambda g: F.struct(held(g, t).alias("n"), g["place"].alias("place"), g["industry"].alias("industry"))))
    known = any_of([w for words in KEYWORDS.values() for w in words.split("|")])
    return bound(text, lambda t: F.when(t.rlike(known), best(t)["industry"]))  # most texts hold none


def first_match(text: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(patterns.items()):
        out = F.when(text.rlike(words), name).otherwise(out)
    return out


def shown(industry: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in NAMES.items() for x in p]), industry)


def structured_industry(html: Column) -> Column:
    """The first industry that an object of the structured data tells of, each before those within it: by the keywords of its fields in
    their order, else by its type."""
    field = lambda v, name: F.lower(text_of(F.try_variant_get(v, f"$['{name}']", "variant")))
    typed = F.create_map(*[F.lit(x) for p in SCHEMA_TYPES.items() for x in p])
    told = lambda v: F.coalesce(*[best_match(field(v, n)) for n in ("industry", "sector", "businessType", "@type")], F.element_at(typed, field(v, "@type")))
    found = F.transform(F.filter(json_nodes(html), lambda x: x["kind"] == "object"), lambda x: told(x["v"]))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def told(html: Column) -> Column:
    """struct(source, industry, conf) of each source of a page that tells of an industry, the surest first."""
    meta = lambda name: F.lower(F.coalesce(H.meta_content(html, name), F.lit("")))
    heads = F.slice(H.every(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1", 1), 1, 3)
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    head = F.lower(H.inner_text(F.concat_ws(" ", title, heads)))
    page = F.struct(structured_industry(html).alias("jsonld"), meta("description").alias("description"), meta("og:description").alias("og"), meta("keywords").alias("keywords"), head.alias("head"))
    met = bound(page, lambda x: F.struct(
        x["jsonld"].alias("jsonld"), F.coalesce(best_match(x["description"]), best_match(x["og"])).alias("described"), best_match(x["keywords"]).alias("keywords"),
        best_match(F.concat_ws(" ", x["head"], x["description"])).alias("text")))
    one = lambda source, industry, conf: F.struct(F.lit(source).alias("source"), shown(industry).alias("industry"), F.lit(conf).alias("conf"))
    each = lambda x: F.array(one("jsonld", x["jsonld"], 90), one("metadata", x["described"], 80), F.when(x["described"].isNull(), one("metadata", x["keywords"], 75)), one("text", x["text"], 60))
    return bound(met, lambda x: F.filter(each(x), lambda c: c["industry"].isNotNull()))


def page_industries(pages: DataFrame) -> DataFrame:
    """page_id, source, industry, confidence of each source of a page that tells of an industry."""
    rows = pages.select("page_id", F.explode(told(F.col("html"))).alias("c"))
    return rows.select("page_id", "c.source", "c.industry", (F.col("c.conf") / F.lit(100.0)).alias("confidence"))


def best_in_row(html: Column) -> Column:
    """The surest industry of one page as a struct(source, industry, conf), null if none."""
    return F.get(told(html), F.lit(0))


def best_industries(pages: DataFrame) -> DataFrame:
    """The surest industry of each page row, else the default."""
    rows = pages.select("page_id", best_in_row(F.col("html")).alias("b"))
    return rows.select("page_id", F.coalesce("b.industry", F.lit(DEFAULT)).alias("industry"), F.coalesce("b.source", F.lit("fallback")).alias("source"), (F.coalesce("b.conf", F.lit(30)) / F.lit(100.0)).alias("confidence"))


def described(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The first industry with an English keyword in a description; null if none."""
    return texts.select(key, first_match(F.lower(text), ENGLISH).alias("industry"))


def mapped(text: Column) -> Column:
    """The first category with a keyword in a free text, else the text itself, placeholders null."""
    return F.coalesce(first_match(F.lower(text), FREE_TEXT), F.when(~F.coalesce(text, F.lit("")).isin("なし", "not found", "unknown", ""), text))

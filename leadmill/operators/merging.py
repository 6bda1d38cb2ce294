"""Values that a model answered: parsing of stored replies, clean-up, gate, merge with the rules' values, cache. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import EMAIL, bound, extract

#: Labels by field, separators in order, placeholders, and marks of addresses that aren't taken. Fixed values.
LABELS = {"company_name": ["会社名", "company name", "company"], "email": ["メールアドレス", "email address", "email", "e-mail"], "industry": ["業界", "industry"]}
SEPARATORS = [r"：\s*", r":\s*", r"｜\s*", r"\|\s*", r"\s+"]
PLACEHOLDERS = ["なし", "n/a", "na", "none", "not found", "unknown", "not provided", "tbd", "-", "--", "---", "", "会社名", "メールアドレス", "業界名", "会社名 or なし", "メールアドレス or なし", "業界名 or なし"]
REFUSED = r"(?i)noreply|no-reply|test@|@test|placeholder|example\.com|メール|address|not found|or なし"
#: Least confidence of a rule's value by field, and caps of a model's value and of a weak rule's, in hundredths.
ENOUGH, MODEL_CAP, FALLBACK_CAP = {"company_name": 60, "email": 50, "industry": 60}, 85, 70


def labelled_value(text: Column, field: str) -> Column:
    """The first value of two characters or more behind one of the field's labels, by label and then by separator."""
    long = lambda v: F.when(F.char_length(v) > 1, v)
    each = [(label, separator) for label in LABELS[field] for separator in SEPARATORS]
    return bound(text, lambda t: F.coalesce(*[bound(F.trim(F.regexp_extract(t, rf"(?im){a}{b}([^\n]+?)\s*$", 1)), long) for a, b in each]))


def cleaned_value(value: Column, rewrite: bool = False) -> Column:
    """Without brackets, fences and notes; placeholders null. rewrite: the reference's change of 有限会社 to 株式会社, off by default."""
    for pattern in (r"^\s+|\s+$", r"^[「」]+|[「」]+$", r"^\s+|\s+$", r"^[【】]+|[【】]+$", r"^[\s<>]+|[\s<>]+$", r"^[\s`]+|[\s`]+$", r"^\[.+?\]\s*", r"\s*\(.+?\)\s*$", r"\s*（.+?）\s*$", r"^\s+|\s+$"):
        value = F.regexp_replace(value, pattern, "")
    value = F.replace(value, F.lit("有限会社"), F.lit("株式会社")) if rewrite else value
    return bound(value, lambda v: F.when(~F.lower(v).isin(PLACEHOLDERS), v))


def address_in(text: Column) -> Column:
    """The first address of a text that isn't refused."""
    return F.get(F.filter(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda m: ~m.rlike(REFUSED) & F.length(m).between(5, 254)), F.lit(0))


def from_labels(replies: DataFrame) -> DataFrame:
    """url, company_name, email, industry of replies in labelled lines; an address elsewhere in the reply counts too."""
    reply = F.col("reply")
    email = F.coalesce(cleaned_value(labelled_value(reply, "email")), address_in(reply))
    return replies.select("url", cleaned_value(labelled_value(reply, "company_name")).alias("company_name"), email.alias("email"), cleaned_value(labelled_value(reply, "industry")).alias("industry"))


def from_json(replies: DataFrame) -> DataFrame:
    """url, field, value, confidence, source of replies that hold one JSON object, flat or nested."""
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    whole = (F.try_parse_json(body).isNotNull()) & (F.length(F.translate(body, "{", "")) == F.length(F.translate(body, "}", "")))
    found = replies.where(F.contains("reply", F.lit("{"))).select("url", F.when(whole, body).alias("body")).where("body is not null")
    get = lambda path: F.get_json_object("body", path)
    one = lambda f: F.struct(F.lit(f).alias("field"), F.when(get(f"$.{f}").startswith("{"), get(f"$.{f}.value")).otherwise(get(f"$.{f}")).alias("value"), F.when(get(f"$.{f}").startswith("{"), F.coalesce(get(f"$.{f}.confidence").try_cast("double"), F.lit(0.5))).otherwise(0.8).alias("confidence"), F.coalesce(get(f"$.{f}.source"), F.lit("ai")).alias("source"))
    rows = found.select("url", F.explode(F.filter(F.array(*[one(f) for f in LABELS]), lambda c: c["value"].isNotNull())).alias("c"))
    return rows.select("url", "c.*")


def from_lines(replies: DataFrame) -> DataFrame:
    """url, company_name, confidence, source of replies in lines company_name:, confidence:, source:."""
    reply = F.col("reply")
    name = F.regexp_replace(extract(reply, r"(?m)^\s*company_name:\s*([^\n]*)$"), r"""^["'「」『』]+|["'「」『』]+$""", "")
    for pattern in (r"(?i)\s+All Rights Reserved.*$", r"\s+©.*$", r"(?i)\s+Copyright.*$", r"\s*[|｜].*$"):
        name = F.regexp_replace(name, pattern, "")
    name = F.trim(F.regexp_replace(name, r"\s+", " "))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(extract(reply, r"(?m)^\s*confidence:\s*([^\n]*?)\s*$").try_cast("double"), F.lit(0.0))))
    rows = replies.select("url", name.alias("company_name"), confidence.alias("confidence"), F.coalesce(extract(reply, r"(?m)^\s*source:\s*([^\n]*?)\s*$"), F.lit("ai")).alias("source"))
    return rows.where((F.lower("company_name") != "not_found") & F.char_length("company_name").between(2, 30))


def answers(replies: DataFrame) -> DataFrame:
    """One value a url and field, of whichever form the reply has: page_id, field, value, conf (hundredths)."""
    keyed = replies.select("url", "page_id").distinct()
    flat = from_labels(replies).select("url", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(c).alias("conf")) for f, c in (("company_name", 90), ("email", 95), ("industry", 80))])).alias("c")).select("url", "c.*", F.lit(1).alias("form"))
    nested = from_json(replies).select("url", "field", "value", F.round(100 * F.col("confidence")).cast("int").alias("conf"), F.lit(0).alias("form"))
    rows = nested.unionByName(flat).where("value is not null")
    best = rows.groupBy("url", "field").agg(F.min_by(F.struct("value", "conf"), "form").alias("b"))
    return best.join(keyed.hint("merge"), "url").select("page_id", "field", "b.value", "b.conf")


def with_page_addresses(found: DataFrame, pages: DataFrame) -> DataFrame:
    """found(page_id, ..., email) with the first address of the page that isn't refused where the reply gave none. Only the address of a page is
    joined; of pages that share an id the one with the least address counts."""
    own = pages.select("page_id", address_in(F.col("html")).alias("page_email")).where("page_email is not null").groupBy("page_id").agg(F.min("page_email").alias("page_email"))
    return found.hint("merge").join(own, "page_id", "left").withColumn("email", F.coalesce("email", "page_email")).select(*found.columns)


def requests(values: DataFrame) -> DataFrame:
    """The gate: values(page_id, field, value, conf) that are missing or below their field's least confidence."""
    least = F.element_at(F.create_map(*[F.lit(x) for p in ENOUGH.items() for x in p]), F.col("field"))
    return values.where(F.col("value").isNull() | (F.col("conf") < least)).select("page_id", "field", "value", "conf")


def merged(values: DataFrame, replies: DataFrame) -> DataFrame:
    """The rule's value where it is sure enough, else the model's (capped), else the rule's (capped lower). One row a row of values; of several
    replies for a page the surest counts, then that of the greatest value."""
    least = F.element_at(F.create_map(*[F.lit(x) for p in ENOUGH.items() for x in p]), F.col("field"))
    model = answers(replies).groupBy("page_id", "field").agg(F.max(F.struct("conf", "value")).alias("m")).select("page_id", "field", F.col("m.value").alias("m_value"), F.col("m.conf").alias("m_conf"))
    rows = values.hint("merge").join(model, ["page_id", "field"], "left")
    sure = F.col("value").isNotNull() & (F.col("conf") >= least)
    used = ~sure & F.col("m_value").isNotNull()
    conf = F.when(sure, F.col("conf")).when(used, F.least("m_conf", F.lit(MODEL_CAP))).when(F.col("value").isNotNull(), F.least("conf", F.lit(FALLBACK_CAP))).otherwise(0)
    return rows.select("page_id", "field", F.when(used, F.col("m_value")).otherwise(F.col("value")).alias("value"), (conf / F.lit(100.0)).alias("confidence"), used.alias("used_model"))


def model_fields(values: DataFrame) -> DataFrame:
    """The fields of each page whose value is a model's, as a list with commas."""
    return values.where("used_model").groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def cached(replies: DataFrame, wanted: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """wanted(url) with the age in hours of the latest reply that is still valid; null where the model must be asked."""
    now = F.lit(as_of).cast("timestamp")
    fresh = replies.where((F.col("responded_at") > now - F.expr(f"interval {hours} hours")) & (F.col("responded_at") <= now)).groupBy("url").agg(F.max("responded_at").alias("at"))
    return wanted.select("url").distinct().join(fresh, "url", "left").select("url", F.floor((F.unix_seconds(now) - F.unix_seconds("at")) / 3600).cast("long").alias("age_hours"))

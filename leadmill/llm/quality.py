"""Quality rules as a bitmask ledger, with DataFrame functions only.

``ledger`` measures every text once and stores one failure bit a rule. Policies are versioned masks over these bits: applying
one, or asking what each of its rules removes alone, never reads a text again.

Null text: no words, lines or symbols. Words are runs of characters other than space and U+0009 to U+000D. Repeated rows give
repeated results; columns other than doc_id and text are ignored. Windows of words are compared by a 64-bit hash within one
document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Name and condition of a failure, by bit. Only ever append: stored ledgers keep their meaning.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 10),
    ("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > 5 * F.col("n_words")),
    ("duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    ("shouting", lambda: 10 * F.col("n_exclamations") > 5 * F.col("n_words")),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once although use may name it often, within loops too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(hashes: Column) -> Column:
    """Words covered by windows, given by their hashes in order, that occur twice or more."""

    def pairs(ordered: Column) -> Column:
        same = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(same)))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bound(bound(ordered, pairs), covered)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row of docs(doc_id, text). One pass in the JVM, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.filter(F.split(text, SPACE, -1), lambda w: w != "").alias("words"), lines.alias("lines"))
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])))
    counted = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        windows.alias("hashes"),
    )
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), repeat_words(F.col("hashes"))).otherwise(0)
    return counted.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0)).cast("long")).drop("hashes")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, and failed: a long with one bit for each rule that the text fails."""
    bits = sum((F.when(fails(), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES), F.lit(0))
    return measured(docs).withColumn("failed", bits.cast("long"))


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with kept: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """rule, n_failed, n_only (rows that only this rule rejects), n_kept_without: from counts by bit pattern alone."""
    mask = POLICIES[version]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(count(fails).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"), count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"))

"""Secret scans by character Markov models, with DataFrame functions only.

Two first-order models of characters, one of random strings and one of ordinary identifiers, are trained from labelled
samples. A candidate (a run of at least ``MIN_CHARS`` key characters with a letter and a digit) is a secret when its
log-likelihood ratio a character reaches ``threshold``. Spans of fixed patterns (assigned values, access keys, hexadecimal
runs) are found beside them, and they too serve as labelled samples of random strings.

Samples. Random: base64 and upper-case strings drawn from SHA-256 (``DRAWN`` rows), and the values that the patterns find.
Ordinary: words of the corpus outside such spans, alone and, ``joined_words`` distinct ones of each text, joined in the ways of
identifiers. Both come from at most about ``sample_docs`` documents, chosen by a hash of doc_id: with joined_words the bounds of
what is learned from. Scanning reads every text whole.

Offsets count code points, ends are exclusive. Null and empty text: no spans. Repeated rows give repeated results. Other columns
pass through; columns of a caller that are named spans or base_spans are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which kinds are listed; assign's value is group 2. Shorter matches are dropped.
KINDS = ["assign", "access", "hex"]
PATTERN = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_VALUE = 6
MIN_CHARS = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Symbols of the models by position from 1; any other character is 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
STATES = len(ALPHABET) + 1
DRAWN = 6000
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost matches that don't overlap, as structs (start, kind, end), but those whose value is shorter than least."""
    between, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    matches = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("m"), value.alias("v")), lambda b, m: F.struct(F.char_length(b).alias("b"), F.char_length(m["m"]).alias("m"), F.char_length(m["v"]).alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["b"]
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["m"]).alias("end"))
        return F.struct((begin + x["m"]).alias("at"), F.when(x["v"] >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(matches, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start and then kind."""
    each = [spans_of(text, PATTERN[k], i, 2 if k == "assign" else 0, LEAST_VALUE if k == "assign" else 0) for i, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*each))


def symbols(string: Column) -> Column:
    """Positions in ALPHABET of the characters, behind a 0 for the start."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(string, "(?!^)"), lambda c: F.instr(F.lit(ALPHABET), c)))


def transitions(string: Column) -> Column:
    """Numbers of the transitions in order: previous symbol * STATES + symbol."""
    return F.transform(F.array(symbols(string)), lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: a * STATES + b))[0]


def train(docs: DataFrame, sample_docs: int = 3000, joined_words: int = 60, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random to ordinary) of all transitions, from pairs of characters counted in Spark."""
    spark = docs.sparkSession
    n = max(1, docs.count())
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1, sample_docs / n))).where("text is not null").select("text")
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    drawn = spark.range(DRAWN).select(F.explode(F.array(F.rtrim(F.base64(F.unhex(digest)), F.lit("=")), F.translate(F.base64(F.unhex(digest)), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), digest)).alias("s"))
    values = part.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(PATTERN["assign"]), F.lit(2)), F.regexp_extract_all("text", F.lit(PATTERN["access"]), F.lit(0)))).alias("s")).where(F.char_length("s") >= MIN_CHARS)
    rest = F.regexp_replace(F.regexp_replace("text", PATTERN["assign"], " "), CANDIDATE, " ")  # candidates are no labelled words
    words = part.select(F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[A-Za-z]{3,}"), F.lit(0))).alias("w")).select("w", F.slice("w", 1, joined_words).alias("first"))
    pairs = F.zip_with("first", F.slice("first", F.lit(2), F.size("first")), lambda a, b: F.concat(a, F.lit("_"), F.coalesce(b, F.lit("1"))))
    joined = words.select(F.explode(F.concat("w", pairs, F.transform("first", lambda a: F.concat(F.lower(a), F.initcap(a), F.lit("2"))))).alias("s"))
    labelled = drawn.withColumn("random", F.lit(1)).unionByName(values.withColumn("random", F.lit(1))).unionByName(joined.withColumn("random", F.lit(0)))
    # one string a row, behind a sign for its start; signs outside the alphabet count as one
    signs = labelled.select("random", F.concat(F.lit("~"), F.regexp_replace("s", f"[^{ALPHABET}]", "~")).alias("s"))
    seen = signs.select("random", F.explode(F.regexp_extract_all("s", F.lit("(?=(..))"), F.lit(1))).alias("pair"))  # each string is read once, however long
    table = [[smoothing] * STATES**2 for _ in range(2)]
    place = {c: i for i, c in enumerate("~" + ALPHABET)}
    for r in seen.groupBy("random", "pair").count().collect():  # two rows a transition at most
        table[r["random"]][place[r["pair"][0]] * STATES + place[r["pair"][1]]] += r["count"]
    out = []
    for a in range(STATES):
        sums = [sum(t[a * STATES : (a + 1) * STATES]) for t in table]
        out += [math.log(table[1][a * STATES + b] / sums[1]) - math.log(table[0][a * STATES + b] / sums[0]) for b in range(STATES)]
    return out


def key_like(string: Column) -> Column:
    """A digit and a letter, or a capital behind a small letter. Each test reads the string once, however long it is."""
    return (string.rlike("[0-9]") & string.rlike("[A-Za-z]")) | string.rlike("[a-z][A-Z]")


def ratio(string: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio a character."""
    table = F.from_json(F.lit(json.dumps([round(x, 4) for x in model])), "array<double>")
    return F.aggregate(transitions(string), F.lit(0.0), lambda s, t: s + F.get(table, t)) / F.char_length(string)


def scan(docs: DataFrame, model: list[float], threshold: float = 1.0) -> DataFrame:
    """docs with base_spans and spans (with those of kind 3 that the models add), both sorted by start and kind.

    An added span never lies within or across a span of the patterns.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("base_spans", base_spans(text))
    added = F.filter(
        spans_of(text, CANDIDATE, len(KINDS)),
        lambda s: F.transform(F.array(F.substring(text, s["start"] + 1, s["end"] - s["start"])), lambda c: key_like(c) & (ratio(c, model) >= threshold))[0]
        & ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return base.withColumn("spans", F.sort_array(F.concat("base_spans", added)))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "markov"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of spans, sorted by start, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)

"""Grouping of spelling variants: words one edit apart, joined by pivotal grams.

One edit destroys at most one of two disjoint bigrams. So a word's two pivots are disjoint bigrams among its prefix (its three
rarest, rarest first), chosen with the least total frequency by dynamic programming; and of two words one edit apart, the one
whose prefix ends earlier in the order of rarity has a pivot in the other's prefix, shifted by one place at most. Pivots are
indexed by gram, place and length, once for each shift that one edit can make, and joined with prefixes on all three. Candidate
pairs are verified by the edit distance itself. A prefix takes in all bigrams equal to its last one, so ties lose no pair.

Words are counted inside tasks before the shuffle. Only the bigrams' frequencies (at most 90 * 90, by the alphabet) go to every
task. Null and empty texts hold no words; repeated rows count as often as they stand there; a null doc_id is written as empty
text in the rule of deleted letters; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm._shared import blocks, staged

LETTERS = "A-Za-zÀ-ÿ"
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A task hands on its counts when it holds so many words.
MOST_HELD = 200_000


def damaged(doc_id: object, run: str, every: int) -> str:
    """The run without one letter where every divides its hash with the document's id."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def counted(docs: DataFrame, least_length: int = 6, every: int = 199) -> DataFrame:
    """(word, n) of all texts: maximal runs of letters, lower-cased from A to Z, damaged by rule."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                of_doc: Counter[str] = Counter()
                for part in blocks(text or ""):
                    of_doc.update(runs.findall(part))
                for run, n in of_doc.items():
                    word = damaged(doc_id, run.translate(CAPITALS), every)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > MOST_HELD:
                    yield given()
                    total.clear()
        yield given()

    parts = docs.select(F.col("doc_id"), F.col("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def prefix_and_pivots(word: str, frequency: dict[str, int], edits: int = 1) -> tuple[list[tuple[str, int]], list[tuple[str, int]], tuple[int, str]]:
    """The prefix (2 * edits + 1 rarest bigrams with their places, and all equal to the last one), edits + 1 disjoint ones of it with the
    least total frequency, and the last one's rank."""
    rank = lambda g: (frequency.get(g, 0), g)
    grams = sorted(((word[i : i + 2], i) for i in range(len(word) - 1)), key=lambda g: (rank(g[0]), g[1]))
    last = rank(grams[: 2 * edits + 1][-1][0])
    prefix = [g for g in grams if rank(g[0]) <= last]
    by_place = sorted(prefix, key=lambda g: g[1])
    # best[k]: least cost of k disjoint bigrams among those so far, with their list; a bigram may follow one that ends before it
    ends: list[list[tuple[float, list[tuple[str, int]]]]] = [[(0, []), *[(math.inf, [])] * (edits + 1)]]
    for i, (gram, place) in enumerate(by_place):
        free = sum(1 for g in by_place[:i] if g[1] + 2 <= place)
        ends.append([min(ends[i][k], (ends[free][k - 1][0] + frequency.get(gram, 0), [*ends[free][k - 1][1], (gram, place)])) if k else (0, []) for k in range(edits + 2)])
    return prefix, ends[-1][edits + 1][1], last


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), both ways, of the distinct words of at least four letters in a staged table that are one inserted, deleted or replaced letter apart."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    frequency = {r[0]: r[1] for r in grams.groupBy("gram").count().collect()}  # bounded by the alphabet
    schema = "word string, length int, last_n long, last_gram string, pivot boolean, gram string, place int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column("word").to_pylist():
                prefix, pivots, last = prefix_and_pivots(word, frequency)
                out += [(word, len(word), *last, True, g, i) for g, i in pivots] + [(word, len(word), *last, False, g, i) for g, i in prefix]
            types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    index = staged(words.select("word").mapInArrow(cut, schema), "spelling-grams")
    # (change of length, shift of place): a replaced letter moves nothing, an inserted or deleted one all that follows it
    moves = F.array(*[F.struct(F.lit(a).alias("longer"), F.lit(b).alias("shift")) for a, b in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    last = lambda side: F.struct(F.col("last_n"), F.col("last_gram")).alias(f"last_{side}")
    pivots = index.where("pivot").select(F.col("word").alias("a"), last("a"), "gram", "length", "place", F.explode(moves).alias("m"))
    pivots = pivots.select("a", "last_a", "gram", (F.col("length") + F.col("m.longer")).alias("length"), (F.col("place") + F.col("m.shift")).alias("place"))
    prefixes = index.where("not pivot").select(F.col("word").alias("b"), last("b"), "gram", "length", "place")
    found = pivots.hint("merge").join(prefixes, ["gram", "length", "place"]).where("a <> b and last_a <= last_b")
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    # both ways from one join: a union of the pairs with their reverse would join and measure them twice
    return found.where(F.levenshtein("a", "b", 1) == 1).select(F.inline(F.array(way("a", "b"), way("b", "a")))).distinct()


def forms(words: DataFrame, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n of a staged table of (word, n): the near word of the largest n (ties: the first in code-point order), if
    that n is at least so many times the word's."""
    pairs = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")).hint("merge"), "b")
    order = lambda b, n: F.struct((-n).alias("m"), b.alias("b"))
    near = pairs.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(order(F.col("b"), F.col("b_n"))).alias("best"))
    both = words.select("word", "n").hint("merge").join(near, "word", "left")
    taken = -F.col("best.m") >= times * F.col("n")
    held: Column = F.coalesce("n_near", F.lit(0)).cast("long")
    return both.select("word", "n", held.alias("n_near"), F.when(taken, F.col("best.b")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def rooted(found: DataFrame, times: int = 5) -> DataFrame:
    """With the root, the last word that forms lead to. A form's n is so many times larger, so paths are short: each step doubles how far the
    pointers reach, and the steps that any path can need follow from the largest n."""
    found = staged(found, "spelling-forms")
    most = found.agg(F.max("n")).first()[0] or 1
    roots = found.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(math.ceil(math.log2(math.log(most, times) + 2))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root <> next")
        step = roots.hint("merge").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        roots = staged(step, "spelling-roots")
    return found.join(roots.hint("merge"), "word")


def variant_groups(docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word of at least least_length letters and least_n occurrences."""
    words = staged(counted(docs, least_length, every).where(F.col("n") >= least_n), "spelling-words")
    return rooted(forms(words, times), times).select("word", "form", "root", "n", "n_near", "form_n")

"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct ``size``-word shingles, as 64-bit hashes. Equal sets are one class. Classes link when
100 * intersection >= percent * union, and documents of linked classes are one component.

Prefixes. The shingles of a set stand in one order for all sets: rarer first (by a count sketch of fixed width over all
documents), ties by hash. Two sets of at least this similarity share at least l shingles among their first
n - ceil(percent * n / 100) + l, for every l. Each set picks its own l by estimated cost: the postings that its prefix would
scan plus the candidates it would verify; where frequent shingles make candidates likely, the prefix grows by l - 1 shingles
and a candidate must then share l of them (the lesser l of the two sets counts) before it is verified.

Two passes, so that a large group of near copies never yields all its pairs:

* hubs: in the posting list of each shingle, the class that has it at the earliest place of its prefix is the hub: it has the
  fewest rare shingles of its own, so it stands nearest to the text that the others were copied from. Each class is paired
  with the HUBS hubs that it shares most shingles with; pairs are verified and linked into components;
* the rest: in each list, the classes outside the hub's component are joined with the list's other components, and a joined
  row must pass every bound, that from counts by range of hashes included, before it leaves the join. Pairs within one
  component need no check: they can't change the result.

No list meets in one task: a list is dealt in parts by node, as many as the sketch's estimate of its length asks for (PART_ROWS
postings each), its hub is found with map-side aggregates and goes to each part, and the rest are joined part by part. A hub
with many classes is dealt likewise when whole sets are compared.

Before whole sets are compared, a pair must pass a bound on its intersection from counts by range of hashes. No cap on
partners, candidates or postings. Null doc_id: such a row has the component of its class as any other, null if no member of
its component has an id. Null and empty texts have no shingles and link with nothing. Repeated rows are copies. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm._shared import staged
from leadmill.llm.components import components

#: Counters of the sketch, and of one of the blocks in which it is summed.
SKETCH, PART = 1 << 20, 1 << 12
#: The longest extension of a prefix, and the cost of verifying a candidate in postings scanned.
MOST_MATCHES, VERIFY_COST = 8, 4.0
#: Hubs that a class is verified against before the rest of its candidates.
HUBS = 2
#: Postings of a list, and classes of a hub, that one task should meet.
PART_ROWS = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the size-word shingles; of the whole sequence where it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    value = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(size, len(words))
    n = len(words) - span + 1
    out = np.full(n, span, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            out *= BASE
            out += value[k : k + n]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
    return np.unique(out)


def class_of(found: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def text_key(text: Column) -> Column:
    """A 64-bit hash that tells apart rows of one doc_id."""
    return F.xxhash64(text)


def described(docs: DataFrame, size: int) -> DataFrame:
    """A row (doc_id, copy, n, node, spread) for each document, and rows (part, counts) of each task's sketch.

    copy is the hash of the text, spread counts the set's shingles in each of 64 ranges of their hashes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(SKETCH, dtype=np.uint32)
        for pdf in batches:
            rows = []
            for doc_id, copy, text in zip(pdf["doc_id"], pdf["copy"], pdf["text"], strict=True):
                found = shingles(text, size)
                np.add.at(sketch, (found >> np.uint64(44)).astype(np.int64), 1)
                rows.append((doc_id, copy, len(found), class_of(found), np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=64)))
            out = pd.DataFrame(rows, columns=["doc_id", "copy", "n", "node", "spread"]).astype({"doc_id": "Int64"})
            yield out.assign(part=pd.NA, counts=None).astype({"part": "Int32"})
        for part in np.flatnonzero(sketch.reshape(-1, PART).any(axis=1)):
            counts = zlib.compress(sketch[part * PART : (part + 1) * PART].tobytes(), 1)
            yield pd.DataFrame({"doc_id": pd.array([pd.NA], dtype="Int64"), "copy": [0], "n": [0], "node": [0], "spread": [None], "part": pd.array([part], dtype="Int32"), "counts": [counts]})

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("copy"), "text").mapInPandas(run, "doc_id long, copy long, n int, node long, spread array<int>, part int, counts binary")


def summed(parts: DataFrame) -> np.ndarray:
    """The sketch of all documents: SKETCH counters, whatever the corpus holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, counts in zip(pdf["part"], pdf["counts"], strict=True):
                own = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
                total[part] = total[part] + own if part in total else own.astype(np.int64)
        yield pd.DataFrame({"part": list(total), "counts": [x.astype("<i8").tobytes() for x in total.values()]})

    out = np.zeros(SKETCH, dtype=np.int64)
    for r in parts.where("part is not null").select("part", "counts").repartition("part").mapInPandas(run, "part int, counts binary").collect():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], dtype="<i8")
    return out


def prefix_of(found: np.ndarray, sketch: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set's prefix in the common order, and the shared ones it asks for. noise: the sketch's mean, found once a task."""
    n = len(found)
    least = -(-percent * n // 100)
    load = sketch[(found >> np.uint64(44)).astype(np.int64)]
    most = min(n - least + MOST_MATCHES, n)
    order = np.argsort(load, kind="stable")[:most]  # found is sorted, so ties stand by hash
    extra = np.cumsum(np.maximum(0, load[order] - noise - 4 * noise**0.5 - 1))
    matches = np.arange(1, most - (n - least) + 1)
    scanned = extra[n - least + matches - 1]
    best = int((scanned * (1 + VERIFY_COST / matches**2)).argmin()) + 1
    return found[order[: n - least + best]], best


def postings(docs: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, parts, salt, node, meta) of all prefixes; meta holds the set's size, the place in the prefix and the matches asked for.

    parts is the number of parts of the token's list, from the sketch; salt, the node's part. Copies within a task come once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        noise = sent.value.mean()
        for pdf in batches:
            tokens, nodes, metas, parts = [], [], [], []
            for text in pdf["text"]:
                found = shingles(text, size)
                if not len(found) or (node := class_of(found)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                own, matches = prefix_of(found, sent.value, noise, percent)
                tokens.append(own.astype(np.int64))
                parts.append(1 + (sent.value[(own >> np.uint64(44)).astype(np.int64)] // PART_ROWS).astype(np.int64))
                nodes.append(np.full(len(own), node))
                metas.append((len(found) << 32) | (np.arange(len(own), dtype=np.int64) << 4) | matches)
            if tokens:
                n, node = np.concatenate(parts), np.concatenate(nodes)
                yield pd.DataFrame({"token": np.concatenate(tokens), "parts": n, "salt": node % n, "node": node, "meta": np.concatenate(metas)})

    return docs.select("text").mapInPandas(run, "token long, parts long, salt long, node long, meta long")


def n_of(meta: str) -> Column:
    return F.shiftright(meta, 32)


def place(meta: str) -> Column:
    return F.shiftright(F.col(meta).bitwiseAND(F.lit(0xFFFFFFFF)), 4)


def matches_of(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit(15))


def base_prefix(meta: str, percent: int) -> Column:
    """The prefix length for one match."""
    return n_of(meta) - F.ceil(percent * n_of(meta) / F.lit(100.0)) + 1


def similar_sizes(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(n_of(a), n_of(b))) >= (percent * F.greatest(n_of(a), n_of(b)))


def reaches(most: Column, a: str, b: str, percent: int) -> Column:
    """Whether sets that share at most so many shingles can be similar enough."""
    return (100 + percent) * most >= percent * (n_of(a) + n_of(b))


def can_match(a: str, b: str, seen_a: str, seen_b: str, percent: int) -> Column:
    """Whether two sets with a shared shingle at these places can be similar enough: sizes, and what can be shared before and
    behind the places. Before them, only shingles that stand in other prefixes too: one before a shared place would be in the
    other prefix if it were in the other set."""
    most = F.least(seen_a, seen_b) + F.least(n_of(a) - place(a), n_of(b) - place(b))
    return similar_sizes(a, b, percent) & reaches(most, a, b, percent)


def can_match_after(n: str, a: str, b: str, percent: int) -> Column:
    """Whether sets that share n shingles of their prefixes, the last at these places, can be similar enough.

    Of the two prefixes, one ends first in the common order. Of its set, only what is behind its end can still be shared; of
    the other set, only what is behind the last place.
    """
    asked = F.least(matches_of(a), matches_of(b))
    behind = lambda m: n_of(m) - base_prefix(m, percent) - asked + 1
    left = lambda m: n_of(m) - place(m) - 1
    most = F.col(n) + F.greatest(F.least(behind(a), left(b)), F.least(behind(b), left(a)))
    return (F.col(n) >= asked) & reaches(most, a, b, percent)


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda s, x: s + x)


def enough(a: Column, b: Column, percent: int) -> Column:
    """Whether sets with these counts by range of hashes can be similar enough."""
    most = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    return (100 + percent) * most >= percent * (total(a) + total(b))


def each_part(rows: DataFrame, name: str = "salt") -> DataFrame:
    """A row for each of its parts."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, salt, found): the whole sets of the nodes of wanted(node, salt, doc_id), each once.

    A bitmap of 2**23 bits over the wanted doc_ids (a fixed bound) spares most other texts; what it lets through beside them
    goes at the exact join.
    """
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    word, bit = F.pmod(F.shiftrightunsigned(hashed, 6), F.lit(1 << 17)), hashed.bitwiseAND(F.lit(63)).cast("int")
    bitmap = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(cast(doc_id as long)) & 63 as int))")).alias("bits"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("word", word).withColumn("bit", bit)
    rows = rows.join(F.broadcast(bitmap), "word").where(F.expr("(bits & shiftleft(1L, bit)) <> 0")).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, size) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "node": [class_of(f) for f in found], "found": [f.astype(np.int64) for f in found]})

    got = rows.mapInPandas(run, "doc_id long, node long, found array<long>")
    chosen = wanted.select("node", "salt", F.col("doc_id").alias("chosen")).hint("shuffle_hash")
    return got.join(chosen, "node").where(F.col("doc_id").eqNullSafe(F.col("chosen"))).select("node", "salt", "found").dropDuplicates(["node", "salt"])


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b, parts, salt_a) whose sets can be similar enough: in no range of hashes do they share more than the lesser count."""
    spread = lambda c: F.col("spread").alias(f"spread_{c}")
    one = classes.select(F.col("node").alias("b"), spread("b")).hint("shuffle_hash")
    dealt = each_part(pairs.select(F.col("a").alias("node"), "parts").distinct(), "salt_a").join(classes.hint("shuffle_hash"), "node")
    both = pairs.join(one, "b").join(dealt.select(F.col("node").alias("a"), "salt_a", spread("a")).hint("shuffle_hash"), ["a", "salt_a"])
    return both.where(enough(F.col("spread_a"), F.col("spread_b"), percent)).select("a", "b", "parts", "salt_a")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of pairs(a, b, parts) whose whole sets are similar enough; those of an a are dealt in parts by b."""
    pairs = pairs.withColumn("salt_a", F.pmod(F.xxhash64("b"), F.col("parts")))
    pairs = staged(possible(pairs, classes, percent), "possible")
    nodes = pairs.select(F.col("a").alias("node"), F.col("salt_a").alias("salt")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).cast("long").alias("salt"))).distinct()
    wanted = staged(nodes.join(classes.hint("shuffle_hash"), "node").select("node", "salt", "doc_id"), "wanted")
    sets = sets_of(docs, wanted, size)  # both joins read one shuffle of it, dealt by node and part
    side = lambda c: sets.select(F.col("node").alias(c), F.col("salt").alias(f"salt_{c}"), F.col("found").alias(f"found_{c}")).hint("shuffle_hash")
    both = pairs.withColumn("salt_b", F.lit(0).cast("long")).join(side("a"), ["a", "salt_a"]).join(side("b"), ["b", "salt_b"])
    shared = F.size(F.array_intersect("found_a", "found_b"))
    counted = both.select("a", "b", shared.alias("shared"), (F.size("found_a") + F.size("found_b")).alias("total"))
    return counted.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def shared_postings(docs: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """The postings of lists with several classes, and how many of the class's postings before each are such ones (seen)."""
    lists = postings(docs, sketch, size, percent).repartition("token", "salt").dropDuplicates(["token", "salt", "node", "meta"])
    near = lists.withColumn("n", F.count("*").over(Window.partitionBy("token", "salt"))).where("n > 1 or parts > 1").drop("n")
    return near.withColumn("seen", F.row_number().over(Window.partitionBy("node").orderBy("meta")) - 1)


def list_hubs(shared: DataFrame) -> DataFrame:
    """(token, parts, hub, hub_meta, hub_seen, hub_parts): the class with the earliest place in each list."""
    first = F.min(F.struct(place("meta").alias("at"), "node", "meta", "seen")).alias("hub")
    tops = shared.groupBy("token").agg(first, F.max("parts").alias("parts"), F.count("*").alias("n")).where("n > 1")
    tops = tops.select("token", "parts", F.col("hub.node").alias("hub"), F.col("hub.meta").alias("hub_meta"), F.col("hub.seen").alias("hub_seen"), "n")
    longest = F.max("n").over(Window.partitionBy("hub"))
    return tops.withColumn("hub_parts", 1 + F.floor(longest / PART_ROWS)).drop("n")


def hub_pairs(shared: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b, parts): each class b with the HUBS hubs a that it shares most shingles with."""
    held = shared.drop("parts").join(each_part(hubs).hint("shuffle_hash"), ["token", "salt"])
    tied = held.where(F.col("hub") != F.col("node")).where(can_match("meta", "hub_meta", "seen", "hub_seen", percent)).groupBy("node", "hub").agg(F.count("*").alias("n"), F.max("hub_parts").alias("parts"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "hub"))
    return tied.withColumn("rank", best).where(F.col("rank") <= HUBS).select(F.col("hub").alias("a"), F.col("node").alias("b"), "parts")


def cross_pairs(shared: DataFrame, hubs: DataFrame, part: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components whose prefixes and counts allow enough similarity."""
    of = lambda node: part.select(F.col("node").alias(node), "component").hint("shuffle_hash")
    main = hubs.join(of("hub"), "hub", "left").select("token", "parts", F.coalesce("component", "hub").alias("main"))
    known = shared.drop("parts").join(of("node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    outside = F.col("component") != F.col("main")
    known = staged(known.join(each_part(main).hint("shuffle_hash"), ["token", "salt"]).withColumn("outside", outside).drop("main"), "known")
    lists = each_part(known.where("outside").groupBy("token").agg(F.max("parts").alias("parts"))).select("token", "salt")
    mixed = known.join(lists.hint("shuffle_hash"), ["token", "salt"], "left_semi").join(classes.select("node", "spread").hint("shuffle_hash"), "node")
    mixed = staged(mixed, "mixed")
    columns = ["node", "meta", "seen", "component", "outside", "spread"]
    side = lambda rows, c: rows.select("token", "part_a", "part_b", *[F.col(x).alias(f"{x}_{c}") for x in columns])
    left = side(each_part(mixed.where("outside").withColumnRenamed("salt", "part_a"), "part_b"), "a")
    right = side(each_part(mixed.withColumnRenamed("salt", "part_b"), "part_a"), "b")
    asked = F.least(matches_of("meta_a"), matches_of("meta_b"))
    once = ~F.col("outside_b") | (F.col("node_a") < F.col("node_b"))
    near = (place("meta_a") < base_prefix("meta_a", percent) + asked - 1) & (place("meta_b") < base_prefix("meta_b", percent) + asked - 1)
    joined = left.hint("merge").join(right, ["token", "part_a", "part_b"]).where(
        (F.col("component_a") != F.col("component_b")) & once & near & can_match("meta_a", "meta_b", "seen_a", "seen_b", percent) & enough(F.col("spread_a"), F.col("spread_b"), percent)
    )
    counted = joined.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("n"), F.max("meta_a").alias("meta_a"), F.max("meta_b").alias("meta_b"))
    return counted.where(can_match_after("n", "meta_a", "meta_b", percent)).select("a", "b")


def linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy, n_shingles, node) of each row of docs, and (node, component) of the classes that link with another."""
    facts = staged(described(docs, size), "described")
    own = facts.where("part is null").select("doc_id", "copy", F.col("n").cast("long").alias("n_shingles"), "node", "spread")
    sketch = summed(facts)
    classes = staged(own.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("spread").alias("spread")), "classes")
    shared = staged(shared_postings(docs, sketch, size, percent), "postings")
    hubs = staged(list_hubs(shared), "lists")
    first = staged(hub_pairs(shared, hubs, percent), "hubs")
    links = staged(verified(first, docs, classes, size, percent), "links")
    near = staged(components(links), "near")
    rest = cross_pairs(shared, hubs, near, classes, percent)
    tried = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = staged(rest.join(tried.hint("shuffle_hash"), ["a", "b"], "left_anti").withColumn("parts", F.lit(1).cast("long")), "pairs")
    more = verified(rest, docs, classes, size, percent)
    # the hubs' components go on as stars, so only what the rest links takes further rounds
    stars = near.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return own.drop("spread"), staged(components(stars.unionByName(more)), "components")


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) for each row of docs(doc_id, text)."""
    own, whole = linked(docs, size, percent)
    classes = own.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    joined = classes.join(whole.hint("shuffle_hash"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(heads.hint("shuffle_hash"), "component").select("node", "component_id")
    members = own.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id")
    return members.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def without_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, that stay when one row of each component does: that with the smallest doc_id (null
    last) and then the smallest hash of the text. Repeated rows are copies; rows without words all stay."""
    own, whole = linked(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "copy")).alias("head")
    classes = own.where("n_shingles > 0").groupBy("node").agg(first).join(whole.hint("shuffle_hash"), "node", "left")
    heads = classes.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("head").alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("__id"), F.col("head.copy").alias("__copy"))
    dealt = docs.withColumn("__copy", text_key(F.col("text")))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    named = dealt.where(worded & F.col("doc_id").isNotNull()).withColumn("__id", F.col("doc_id").cast("long")).join(heads.hint("shuffle_hash"), ["__id", "__copy"], "left_semi")
    nameless = dealt.where(worded & F.col("doc_id").isNull()).dropDuplicates(["__copy"]).join(heads.where("__id is null").select("__copy").hint("shuffle_hash"), "__copy", "left_semi")
    kept = named.dropDuplicates(["__id", "__copy"]).select(*docs.columns).unionByName(nameless.select(*docs.columns))
    return kept.unionByName(docs.where(~worded | F.col("text").isNull()))

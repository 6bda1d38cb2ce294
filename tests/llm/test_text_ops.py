"""Token counts, packing, sharding, quality rules and secret scans against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import packing, quality, queries, secret_scan, sharding, token_counts

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def both(spark, sf, odd_docs):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select(F.col("doc_id") + 1_000_000 if False else "doc_id", "text"))


@pytest.fixture(scope="module")
def docs(spark, sf, odd_docs):
    return both(spark, sf, odd_docs).cache()


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(token_counts.count_tokens(docs, path, chunk_chars=2000, overlap_chars=50).collect(), key=str)
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in texts(docs)), key=str)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chunk, overlap", [(40, 3), (100, 20), (300, 299)])
def test_resync_is_exact(chunk, overlap):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    encode = lambda s: ([a for a, _ in t.encode(s, add_special_tokens=False).offsets],) * 2
    counter = token_counts.TokenCounter(queries.tokenizer("word_bpe_49k.json"))
    for text in ["word " * 100, "x" * 700, "ab cd" * 150 + "y" * 500 + " end of it", "é " * 200, "a<|endoftext|>b c " * 50, "It's 1234 don't!? (x) " * 40, " \n\t" * 90, "漢字 かな " * 60]:
        joined = [o for part, _ in token_counts.resynchronised(text, encode, chunk, overlap) for o in part]
        assert joined == encode(text)[0]
        parts = list(token_counts.resynchronised(text, counter.units, chunk, overlap))
        assert sum(sum(n) for _, n in parts) == len(joined)


def test_long_texts_of_the_corpus_are_resynchronised(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 4096").collect()]
    counter = token_counts.TokenCounter(queries.tokenizer("word_bpe_49k.json"))
    assert len(texts) > 20
    for text in texts:
        parts = list(token_counts.resynchronised(text, counter.units, 4096, 128))
        assert len(parts) > 1 and sum(sum(n) for _, n in parts) == len(counter.offsets(text)) == counter.count(text, 4096, 128)


@pytest.mark.parametrize("ranks", [True, None])
def test_packing(docs, ranks):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    t, cap = Tokenizer.from_file(path), 512
    rows = packing.pack(docs, path, cap, ranks_path=ranks and queries.tokenizer("byte_bpe_50k.tiktoken")).collect()
    want, parts = Counter(), Counter()
    for i, x in texts(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        first = len(ids) % cap or cap
        cuts = [0, *range(first, len(ids) + 1, cap)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for p in placed.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= cap
    assert len(placed) <= sum(r.length for r in rows) / cap * 1.05 + 2


def test_plan_matches_large_items_in_pairs():
    plan = packing.plan_packing({600: 5, 400: 5, 900: 1, 100: 1, 334: 3}, 1000)
    assert plan.made == 8 and plan.next_rank == {600: 5, 400: 5, 900: 1, 100: 1, 334: 3}


def best_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, shards, used = (low + high) // 2, 1, 0
        for s in sizes:
            shards, used = (shards + 1, s) if used + s > mid else (shards, used + s)
        low, high = (low, mid) if shards <= n else (mid + 1, high)
    return low


def test_sharding(docs):
    rows = sharding.shard_documents(docs, 24).collect()
    size = {}
    shard_of, slots, load = defaultdict(set), defaultdict(list), Counter()
    want = Counter((i, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for i, x in texts(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        if r["size"] > 8:
            shard_of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < 24
    assert all(len(s) == 1 for s in shard_of.values())
    keyed = docs.select(F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.lit("no text"), "doc_id")).alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size")).groupBy("key").agg(F.sum("size").alias("size"))
    size = [r["size"] for r in keyed.orderBy("key").collect()]
    assert max(load.values()) == best_capacity(size, 24)


def test_minimax_needs_finer_ranges(spark):
    groups = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 7 + 1).alias("size"))
    assert sharding.minimax_cuts(groups, 24)[0] == best_capacity([i % 7 + 1 for i in range(5000)], 24)


def brute_quality(text):
    t = text or ""
    words = SPACE.findall(t)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(docs):
    rows = quality.apply_policy(quality.ledger(docs)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *brute_quality(x)) for i, x in texts(docs))
    assert all(not r.kept for r in rows if r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_quality_ablation(docs):
    stored = quality.ledger(docs).cache()
    failed = [r.failed for r in stored.collect()]
    for r in quality.ablation(stored).collect():
        bit = quality.BIT[r.rule]
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(bool(f & bit) for f in failed), failed.count(bit), sum(not f & ~bit for f in failed))


def brute_base(text):
    t, out = text or "", []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_scan(docs):
    key = "Zk3vQ9xLm2TrW8pYc5Nd7HsB4uJe"
    more = docs.sparkSession.createDataFrame([(900, f"see {key} now"), (901, "the_quick_brown_fox_jumps2_over_lazy_dogs and InternationalizationHelper2Factory4Bean"), (902, "😀 secret: 'abcdefg' é token=short")], "doc_id long, text string")
    all_docs = docs.unionByName(more)
    rows = secret_scan.scan(all_docs, secret_scan.train(all_docs)).withColumn("base", secret_scan.written(F.col("base_spans"))).withColumn("all", secret_scan.written(F.col("spans"))).withColumn("clean", secret_scan.redacted(F.col("text"), F.col("spans"))).collect()
    assert Counter((r.doc_id, r.text, r.base) for r in rows) == Counter((i, x, brute_base(x)) for i, x in texts(all_docs))
    by = {r.doc_id: r for r in rows if (r.doc_id or 0) >= 900}
    assert by[900]["all"] == "markov:4:32" and by[900].clean == "see [SECRET] now"
    assert by[901]["all"] == "" and by[901].clean == by[901].text
    assert by[902].clean == "😀 [SECRET]' é token=short"
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_empty_tables(no_docs):
    path = queries.tokenizer("word_bpe_49k.json")
    assert token_counts.count_tokens(no_docs, path).count() == 0
    assert packing.pack(no_docs, queries.tokenizer("byte_bpe_50k.json")).count() == 0
    assert sharding.shard_documents(no_docs).count() == 0
    assert quality.apply_policy(quality.ledger(no_docs)).count() == 0
    assert secret_scan.scan(no_docs, secret_scan.train(no_docs)).count() == 0

"""Each method against brute force, an independent rule or held-out labels; and every registered query bound to its table."""

import itertools
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadmill.llm import decontamination, html_extraction, jaccard_join, language_id, packing, queries, secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    """1- to 3-grams of letters, words padded by a blank."""
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    out = Counter()
    for w in words:
        p = f" {w} "
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def test_language_distance_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect()
    profiles = language_id.train(spark.createDataFrame(docs), size=80)
    counts = {}
    for r in docs:
        if r.lang and r.text:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    known = {lang: {g: n for g, n in c.items()} for lang, c in counts.items()}
    for lang, profile in profiles.items():  # the profile's counts are the brute force's highest ones
        got = sorted(known[lang].values(), reverse=True)[: len(profile)]
        assert len(profile) == min(80, len(known[lang])) and got == sorted(got, reverse=True)
    model = language_id.Classifier(profiles, 80)
    for r in docs[:20]:
        keys, n = language_id.counted(r.text or "")
        best = [int(k) for k in language_id.top(keys, n, 80)]
        assert sorted(n.tolist(), reverse=True)[: len(best)] == sorted(plain_grams(r.text or "").values(), reverse=True)[: len(best)]
        distance = {}
        for lang, profile in profiles.items():
            place = {g & (2**64 - 1): i for i, g in enumerate(profile)}
            distance[lang] = sum(abs(place[g] - i) if g in place else 80 for i, g in enumerate(best))
        lang, score = model.predict(r.text)
        if best:
            assert distance[lang] == min(distance.values()) and math.isclose(score, 1 - distance[lang] / (80 * len(best)))


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(14)) for k in range(4)]
    docs = []
    for _ in range(24):
        text = list(rng.choice(items)[1][rng.randint(0, 8) :][: rng.randint(58, 75)])
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(([], [rng.choice("xyz")], [text[at], "q"]))
        docs.append(f"{prose(3)} {''.join(text)} {prose(3)}")
    index = decontamination.Index(items, 12, 64, 0.05)
    for d in docs:
        got = index.scan(d)
        want = {i for i, t in items if any(least_edits(t[s : s + 64], d) <= 3 for s in range(0, max(1, len(t) - 63)))}
        assert set(got) == want, (d, got, want)
    edited = [d for d in docs if any(m[2] for m in index.scan(d).values())]
    assert len(edited) >= 3


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", string.ascii_lowercase + "    "])
def test_decontamination_loses_no_match_within_the_budget(alphabet):
    """Excerpts at every place of an item, with up to one edit more than the budget, in random surroundings."""
    rng = random.Random(alphabet)
    drawn = lambda n: [rng.choice(alphabet) for _ in range(n)]
    n_found = 0
    for _ in range(60):
        item = "x" + " ".join("".join(drawn(rng.choice((40, 64, 90, 140)))).split())
        index = decontamination.Index([(1, item)], 12, 64, 0.05)
        m, k = int(index.m[0]), int(index.k[0])
        own = np.trim_zeros(decontamination.normalised(item)[0]).tolist()
        at = rng.randrange(len(own) - m + 1)
        excerpt = [chr(c) if c else " " for c in own[at : at + m]]
        for _ in range(rng.randint(0, k + 1)):
            place = rng.randrange(len(excerpt))
            excerpt[place : place + 1] = rng.choice(([], drawn(1), [excerpt[place], *drawn(1)]))
        text = "".join([*drawn(rng.randint(0, 30)), *excerpt, *drawn(rng.randint(0, 30))])
        codes = decontamination.normalised(text)[0].tolist()
        want = any(least_edits(own[s : s + m], codes) <= k for s in range(len(own) - m + 1))
        assert bool(index.scan(text)) == want, (item, text)
        n_found += want
    assert 30 < n_found < 60


def test_decontamination_block_starts_and_short_items(spark):
    item = " ".join(f"word{k}" for k in range(40))
    index = decontamination.Index([(1, item), (2, "Yes!"), (None, "no")], 12, 64, 0.05)
    for lead in range(decontamination.BLOCK - 60, decontamination.BLOCK - 20):
        found = index.scan("x" * lead + " " + item.replace(" ", " \n "))
        assert found[1][2] == 0 and found[1][0] == lead + 1
    assert index.scan(" yes ")[2] == (1, 4, 0, 1) and 2 not in index.scan("yes sir") and list(index.scan("NO")) == list(index.nameless)
    assert index.scan("") == index.scan(None) == index.scan("?!") == {}


def test_toxicity_score_against_all_pairs():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(400)]
    labels = np.array(["w1 " in t and "w2" in t for t in texts], dtype=float)
    model = toxicity.fit([toxicity.buckets(t, 14) for t in texts], labels, 14, least_chi2=2.0, epochs=10)
    for t in texts[:40]:
        i = model.features(toxicity.buckets(t, 14))
        z = model.bias + model.weight[i].sum() + sum(float(model.vector[a] @ model.vector[b]) for a, b in itertools.combinations(i, 2))
        assert math.isclose(model.score(t), 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def test_html_marginals_against_enumeration():
    model = html_extraction.train(n_pages=120)
    pages = ["<html><body><nav><ul><li><a href=x>a b</a></ul></nav><article><p>one two three<p>four</article><div class=ad>x", "<div id=content><h1>t</h1><table><tr><td>a<td>b</table></div><footer>c"]
    for source in pages:
        nodes = html_extraction.parse(source, labelled=False).nodes
        own = [max(-30.0, min(30.0, sum(model.node.get(f, 0.0) for f in html_extraction.observed(n)))) for n in nodes]
        weight = [[0.0, 0.0] for _ in nodes]
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            log = sum(o for o, x in zip(own, labels, strict=True) if x)
            for i in range(1, len(nodes)):
                log += math.log(model.edge[nodes[i].tag in html_extraction.FLOW][labels[nodes[i].parent]][labels[i]])
            for i, x in enumerate(labels):
                weight[i][x] += math.exp(log)
        for got, (w0, w1) in zip(model.marginals(nodes), weight, strict=True):
            assert math.isclose(got, math.log(w1 / w0), rel_tol=1e-6, abs_tol=1e-6)


def test_html_of_given_pages_against_their_own_marks(spark):
    """The given pages mark their article; the model sees no such rule, the expected text is cut by it."""
    import html

    model = html_extraction.train()
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in blocks]
        assert model.extract(r.html) == "\n".join(w for w in want if w)


def test_html_with_names_it_never_saw():
    """Labelled pages whose class and id names are replaced by numbers: structure and size alone must tell."""
    model, rng, right, n = html_extraction.train(), random.Random(91), 0, 0
    for _ in range(120):
        source = re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="k{rng.randint(100, 999)}"', html_extraction.labelled_page(rng))
        page = html_extraction.parse(source)
        belief = model.marginals(page.nodes)
        for owner, _ in page.blocks:
            right, n = right + ((belief[owner] >= 0) == (page.nodes[owner].label == 1)), n + 1
    assert right / n > 0.8


def test_markov_models_find_what_no_pattern_holds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    words = [w for r in docs.limit(80).collect() for w in re.findall("[A-Za-z]{3,}", r.text or "")]
    rows = []
    for signs in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits):
        rows += [(1, "see " + "".join(rng.choice(signs) for _ in range(n)) + ", thanks") for n in (16, 20, 32) for _ in range(40)]
    for _ in range(120):
        a, b, c = (w.capitalize() for w in rng.sample(words, 3))
        rows += [(0, f"call {a.lower()}{b}{c}{rng.randint(1, 99)} now"), (0, f"call {a}_{b}_{c}_v2".lower()), (0, f"call {a}{b}{c} now")]
    planted = spark.createDataFrame(rows, "secret int, text string").withColumn("doc_id", F.monotonically_increasing_id()).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("x"))
    found = secret_scan.scan(planted, secret_scan.train(docs))
    assert found.columns.count("spans") == 1 and "kind" in found.columns
    hit = found.select("secret", (F.size(F.filter("spans", lambda s: s["kind"] == 3)) > 0).cast("int").alias("hit")).groupBy("secret").agg(F.avg("hit").alias("share"), F.count("*").alias("n"))
    share = {r.secret: r.share for r in hit.collect()}
    assert share[1] > 0.95 and share[0] < 0.02, share


def brute_spans(text):
    kinds = [(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    out = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_columns_of_secrets(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_secret_scans(spark, SF).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [len(re.findall(k, base)) for k in ("assign", "access", "hex")]
        assert set(base.split(",")) <= set(r.spans.split(","))


def test_counts_of_secrets_by_kind_and_long_texts(spark, tmp_path):
    """Several spans of all kinds in mixed order; runs of 200,000 characters, which a test or a count that is quadratic in them does not end on."""
    import hashlib

    key, hexes = "AKIA" + "B7" * 9, "deadbeef" * 4
    texts = [f"{key} token=abcdef1 {hexes} {key} secret: x{hexes}", f"{hexes} {hexes} api_key='abcdef'", "token=abcdef token=abcdef token=abcdef", "token=abc", "", None, "a" * 200_000, "password=" + "a" * 200_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_secret_scans(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        base = brute_spans(text)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [len(re.findall(k, base)) for k in ("assign", "access", "hex")]
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op1_language_id", {"doc_id", "held_out", "lang_pred", "score"}), ("op2_benchmark_decontamination", {"doc_id", "item_id", "start", "end"}), ("op3_best_fit_packing", {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}),
        ("op4_sharding", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}), ("op5_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op6_ngram_jaccard_join", {"doc_id", "n_shingles", "component_id"}),
        ("op7_quality_rules", {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}), ("op8_html_extraction", {"page_id", "url", "text", "n_chars"}),
        ("op9_secret_scans", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}), ("op10_token_counts", {"doc_id", "n_bytes", "n_tokens", "over_limit"}),
    ],
)
def test_registered_queries(spark, name, columns):
    import zlib

    got = queries.queries()[name](spark, SF)
    rows = got.collect()
    source = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op8') else 'documents'}.parquet")
    key = "page_id" if name.startswith("op8") else "doc_id"
    ids = {r[0] for r in source.select(key).collect()}
    assert columns <= set(got.columns) and {r[key] for r in rows} <= ids
    if name not in ("op2_benchmark_decontamination", "op3_best_fit_packing"):
        assert sorted(r[key] for r in rows) == sorted(ids)
    if "held_out" in columns:
        modulus, rest = (4, 2) if name.startswith("op1_") else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in rows)
    if name.startswith("op5"):
        assert all(r.predicted == (r.score >= 0.7) for r in rows)
    if name.startswith("op4"):
        assert {r.law for r in rows} == {"bytes"} and all(0 <= r.shard < 24 and r.grown_shard is None for r in rows)
    if name.startswith("op10"):
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_sql_twins(spark):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF), duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    other, third = ([rng.choice(words) for _ in range(60)] for _ in range(2))
    edited = base[:50] + ["new"] + base[51:]
    rows = [(3, base), (2, edited), (2, other), (5, other), (None, other), (None, third), (None, third), (7, base), (7, base)]
    docs = spark.createDataFrame([(i, " ".join(t), "n") for i, t in rows] + [(9, None, "n"), (9, "", "n"), (None, " ", "n")], "doc_id long, text string, __rank string")
    kept = jaccard_join.without_similar(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(2, " ".join(edited)), (2, " ".join(other)), (None, " ".join(third)), (9, None), (9, ""), (None, " ")], key=str)


def test_many_near_copies_that_share_rare_shingles(spark):
    """2,000 near copies with ten shared passages; brute force over all pairs by an inverted index."""
    rng = random.Random(12)
    words = [f"v{k}" for k in range(4000)]
    base = [rng.choice(words) for _ in range(90)]
    rows = []
    for k in range(2000):
        own = base[:]
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 9))):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k, " ".join(own)))
    sets = [frozenset(zip(*(t.split()[i:] for i in range(4)), strict=False)) for _, t in rows]
    number = {g: i for i, g in enumerate(sorted({g for s in sets for g in s}))}
    held = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [number[g] for g in s]] = 1
    shared, size = held @ held.T, held.sum(axis=1)
    link = 100 * shared >= 85 * (size[:, None] + size[None, :] - shared)
    head = np.arange(len(sets))
    while True:
        new = np.where(link, head[None, :], len(sets)).min(axis=1)
        if (new == head).all():
            break
        head = new
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(head.tolist())) and 2 < len(set(head.tolist())) < 2000


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(120).cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    benchmark = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    index = decontamination.Index(list(benchmark.items()), 12, 64, 0.05)
    left = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()}
    assert left == {i for i, t in text.items() if not index.scan(t)}
    normal = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    parts = {n[s : s + 64] for n in map(normal, benchmark.values()) for s in range(max(1, len(n) - 63))}
    short = {p for p in parts if len(p) < 64}
    holds = {i for i, n in ((i, normal(t)) for i, t in text.items()) if any(n[s : s + 64] in parts for s in range(len(n) - 63)) or any(p in n for p in short)}
    assert not holds & left
    masked = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, docs, SF).collect()}
    assert set(masked) == set(text)
    for i, t in text.items():
        spans = brute_spans(t)
        assert (masked[i].text == t) or "[SECRET]" in masked[i].text
        assert not spans or masked[i].text != t and masked[i].n_chars == len(masked[i].text)
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(text) and max(r.offset + r.length for r in pieces) <= 2048
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()} == {i for i, t in text.items() if model.score(t) < 0.7}


def test_pipeline_of_odd_and_no_rows(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("n_chars", F.char_length("text").cast("long"))
    for rows in (odd, no_docs):
        left = rows
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, SF)
            if name != "best_fit_packing":
                assert left.columns == corpus_pipeline.COLUMNS
        assert left.count() >= (rows.count() > 0)
    assert packing.pack(no_docs, queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_ids_of_many_kinds_of_texts():
    """The faster encoding of plain texts against the tokenizer, over random texts of every kind that counts as plain, and others."""
    from leadmill.llm._shared import plain

    path = queries.tokenizer("byte_bpe_50k.json")
    encoder = packing.encoder_for(path, queries.tokenizer("byte_bpe_50k.tiktoken"))
    rng = random.Random(21)
    latin = "".join(chr(c) for c in [*range(0xA0, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC])
    kinds = [string.ascii_lowercase, string.ascii_letters, string.digits, " ", "  \n", "\t\r\n\x0b\x0c ", string.punctuation, latin, "\x00\x01\x1b\x7f\x85", "'s 't 're 've 'll 'd 'm", "<|endof>", "漢字かな😀é\u0301\u2028\u200b\u0130"]
    seen = Counter()
    for k in range(4000):
        chosen = rng.sample(kinds, rng.randint(1, 4))
        text = "".join("".join(rng.choice(a) for _ in range(rng.randint(1, 9))) for a in (rng.choice(chosen) for _ in range(rng.randint(1, 30))))
        seen[plain(text)] += 1
        want = np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want, repr(text)
    assert min(seen[True], seen[False]) > 800
    for unit in ("word ", "a1 b2\n\n", "x" * 1500 + " ", "é, “q” — \t"):  # cut into blocks
        text = unit * ((1 << 20) // len(unit) + 50)
        assert encoder.encode(text) == np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

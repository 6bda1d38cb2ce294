"""Language identification, toxicity, decontamination, near duplicates, HTML extraction and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadmill.llm import components, decontamination, html_extraction, jaccard_join, language_id, queries, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_id_held_out(spark, sf):
    rows = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_id_odd_rows(odd_docs, no_docs):
    profiles = language_id.train(odd_docs)
    rows = language_id.identify(odd_docs, profiles).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in rows)
    assert language_id.identify(no_docs, language_id.train(no_docs)).count() == 0


def test_counted_in_blocks_is_the_same():
    text = "ab cd éf " * 300_000
    assert dict(zip(*language_id.counted(text))) == dict(zip(*np.unique(language_id.grams(text), return_counts=True)))


def test_toxicity_learns_a_pair():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(4)) + " insulting" * a + " grouping" * b)
        labels.append(a and b)
    model = toxicity.fit([toxicity.buckets(t, 16) for t in texts], np.array(labels, dtype=float), 16)
    assert model.score("lorem insulting grouping") > 0.7 > 0.3 > max(model.score("lorem insulting"), model.score("lorem grouping"))


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else i % 2) for i in range(12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).count() == 0
    assert toxicity.score(odd_docs, toxicity.train(odd_docs, labels.where("false"))).agg(F.max("score")).first()[0] < 0.01


def test_decontamination(spark, odd_docs, no_docs):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(30)) for k in range(20)]
    edited = list(items[3][1])
    for at in (20, 60, 120):
        edited[at] = "z"
    docs = [(0, prose(50) + " " + items[0][1] + " " + prose(50)), (1, prose(200)), (2, "".join(edited)), (3, items[5][1].upper().replace(" ", " ### ")), (4, prose(40) + items[7][1][40:150]), (5, None), (6, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    benchmark = spark.createDataFrame([*items, (98, None), (99, "Short!"), (97, ""), (None, "null id")], "item_id long, text string")
    for block in (4_000_000, 1500):  # one block, several blocks
        rows = decontamination.contaminated(table, benchmark, block_chars=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 0), (2, 3), (3, 5), (4, 7)]
    assert {r.doc_id: r.edits for r in rows}[0] == 0
    assert decontamination.without_contaminated(table, benchmark).count() == table.count() - 4
    assert decontamination.contaminated(no_docs, benchmark).count() == 0 and decontamination.contaminated(table, benchmark.where("false")).count() == 0


def test_decontamination_of_short_excerpts(spark):
    rng = random.Random(8)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 9)))
    prose = lambda a, n: " ".join(word(a) for _ in range(n))
    items = [(1, prose("abcdefghijkl", 60)), (None, prose("abcdefghijkl", 60)), (3, "".join(word("abcdefghijkl") for _ in range(60)))]
    docs, want = [], []
    for item, text in items:
        for at in range(0, 100, 3):
            for n in (72, 75, 80, 90):
                want.append((len(docs), item))
                docs.append((len(docs), f"{prose('mnopqrstuv', 30)} {text[at : at + n].strip()} {prose('mnopqrstuv', 30)}"))
    whole = {i for i, t in docs if len(" ".join(t.split()[30:-30])) >= 71}
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(d, i) for d, i in want if d in whole} and len(whole) > 380
    assert decontamination.without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where(F.col("doc_id").isin(list(whole))).count() == 0


def test_aligned():
    p, t = np.array([1, 2, 3, 4, 5]), np.array([9, 9, 1, 2, 7, 4, 5, 9])
    of = lambda low, k: tuple(int(x[0]) for x in decontamination.aligned(p, np.array([0]), t, np.array([low]), 5, k))
    assert of(0, 1) == (1, 7) and of(2, 0)[0] == 1 and of(5, 1)[0] == 2
    edits, ends = decontamination.aligned(p, np.array([0, 1, 2]), t, np.array([0, 0, 0]), 3, 1, rows=2)
    assert edits.tolist() == [1, 1, 1] and ends.tolist() == [4, 6, 7]


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                head[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows)))


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, odd_docs, size, percent):
    rng = random.Random(size)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice((6, 40, 120)))] + (passage if base % 2 else [])
        for _ in range(8):
            own = text[:]
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, size, percent).collect())
    assert got == brute_components(rows, size, percent)


def test_jaccard_empty(no_docs):
    assert jaccard_join.similar_components(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(((F.col("id") * 7919) % 301).alias("a"), (((F.col("id") + 1) * 7919) % 301).alias("b"))
    found = components.components(edges.unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))).collect()
    assert Counter(r.component for r in found) == Counter({0: 301, 1000: 2}) and len({r.node for r in found}) == 303


def test_html_extraction(spark, sf):
    model = html_extraction.train()
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = [(900, "u", None), (901, "u", ""), (902, None, "<html><body><article><p>A &amp; B&nbsp;c<br>d<p>x  y</article><footer>no</footer>"), (903, "u", "<p>unclosed <b>bold <a href=\"x"), (904, "u", "<div>" * 5000)]
    rows = {r.page_id: r for r in html_extraction.extract_text(pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")), model).collect()}
    assert rows[900].text == rows[901].text == "" and rows[902].text == "A & B c d\nx y" and rows[904].n_chars == 0
    for p in pages.collect():
        assert "&copy;" not in rows[p.page_id].text and "track(" not in rows[p.page_id].text and rows[p.page_id].n_chars == len(rows[p.page_id].text) > 0


@pytest.fixture(scope="module")
def html_model():
    return html_extraction.train()


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<p>one<svg class='i'/> two<p>three", "one two\nthree"), ("<p>one<svg/> two<p>three <svg><text>no</text></svg>four", "one two\nthree four"), ("<p>one<canvas/> two<p>three", "one two\nthree"),
        ("<p>one <svg><path> two<p>three", "one two\nthree"), ("<p>one <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two", "one x=2 two"), ("<p>one <math/> two", "one two"),
        ("<p data-label='Price'>one<p data-label=''>two<p data-label=0>three", "one\ntwo\nthree"), ("<p>" + "\u0130" * 30 + "<STYLE>no</Style>one<p>two", "\u0130" * 30 + "one\ntwo"),
        ("<p>one<script>no '<!--' no</script> two<p>three", "one two\nthree"), ("<p>one<script src='x'/> no</script> two<p>three", "one two\nthree"), ("<p>one<script>no", "one"), ("<p>one<title>no</titles>no</title> two", "one two"),
    ],
)
def test_html_raw_elements_cut_nothing_else(html_model, inside, want):
    assert html_model.extract(f"<html><body><article>{inside}") == want


def test_html_marginals_on_unseen_labelled_pages():
    model, rng, right, n = html_extraction.train(), random.Random(77), 0, 0
    for _ in range(100):
        page = html_extraction.parse(html_extraction.labelled_page(rng))
        belief = model.marginals(page.nodes)
        for owner, _ in page.blocks:
            right, n = right + ((belief[owner] >= 0) == (page.nodes[owner].label == 1)), n + 1
    assert right / n > 0.9


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, stage(spark, left, sf)
        if name != "best_fit_packing":
            assert left.columns == docs.columns
            left = left.cache()
            sizes.append(left.count())
        if name == "toxicity":
            kept = {r.doc_id for r in left.collect()}
            clean = [i for i, t in labels.items() if not t]
            assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[2]
    assert left.select("doc_id").distinct().count() == sizes[3]

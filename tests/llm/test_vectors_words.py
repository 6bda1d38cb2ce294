"""Whitening against a dense eigensolver, spelling variants and nearest neighbours against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import neighbours, queries, spelling, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
#: Null, empty, short, zero and non-finite vectors beside usable ones.
ODD = [None, [], [1.0], [0.0, 0.0, 0.0], [NAN, 1.0, 1.0], [INF, 0.0, 0.0], [None, 1.0, 2.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [3.0, 2.0, 1.5]]


def odd_vectors(spark):
    return spark.createDataFrame([(i if i < 9 else None, v, "x", 1) for i, v in enumerate(ODD)], "vec_id long, embedding array<double>, x string, n long")


def dense(x):
    n, s = len(x), x.sum(axis=0)
    away = x.astype(float) - s / n
    e, vectors = np.linalg.eigh(away.T @ away / n)
    return n, s, away, e[::-1], vectors[:, ::-1]


def test_whitening_against_dense(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in table], dtype=float)).astype(np.int64) + 100000
    n, s, away, e, vectors = dense(x)
    got = queries.op11_embedding_whitening(spark, SF).orderBy("component", "vec_id").collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    for c in range(8):
        own = got[c * n : (c + 1) * n]
        want, have = away @ vectors[:, c] / math.sqrt(e[c]), np.array([r.whitened for r in own])
        assert [r.deviation for r in own] == exact and [r.vec_id for r in own] == [r.vec_id for r in table]
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9 and abs(own[0].explained - e[c] / e.sum()) < 1e-12


def test_whitening_keeps_precision_far_from_zero_and_of_low_rank(spark):
    rng = np.random.default_rng(3)
    v = np.hstack([rng.standard_normal((400, 3)) @ rng.standard_normal((3, 60)), np.full((400, 4), 7.0)])
    got = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5))
    n, s, away, e, vectors = dense(np.floor(1024 * v).astype(np.int64) + 100000)
    rows = got.orderBy("component", "vec_id").collect()
    assert {r.component for r in rows} == set(range(1, 9)) and rows[0].identity_error < 1e-6
    for c in range(3):
        have, want = np.array([r.whitened for r in rows[c * n : (c + 1) * n]]), away @ vectors[:, c] / math.sqrt(e[c])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8


def test_chebyshev_filter_is_the_scaled_polynomial():
    rng = np.random.default_rng(4)
    spectrum = np.sort(rng.random(20))[::-1]
    basis = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    v, q, cut = basis @ np.diag(spectrum) @ basis.T, rng.standard_normal((20, 5)), 0.8 * spectrum[0]
    cheb = lambda t, m=whitening.DEGREE: np.cosh(m * np.arccosh(np.maximum(t, 1))) * (t > 1) + np.cos(m * np.arccos(np.clip(t, -1, 1))) * (t <= 1)
    t = (spectrum - cut / 2) / (cut / 2)
    want = basis @ np.diag(cheb(t) / cheb(t[:1])) @ basis.T @ q
    assert np.allclose(whitening.filtered(lambda b: v @ b, q, v @ q, cut, spectrum[0]), want, atol=1e-12)


def test_whitening_of_odd_rows(spark):
    rows = whitening.whiten(odd_vectors(spark)).collect()
    x = np.array([[0, 0, 0], [1024, 2048, 3072], [1024, 2048, 3072], [3072, 2048, 1536]]) + 100000
    n, s, away, e, vectors = dense(x)
    keep = int((e > 1e-9).sum())
    assert len(rows) == n * keep and {r.vec_id for r in rows} == {3, 7, 8, None}
    assert {r.deviation for r in rows if r.vec_id == 7} == {int(((n * x[1] - s) ** 2).sum())}
    for few in (0, 1):
        assert whitening.whiten(odd_vectors(spark).where("vec_id = 7").limit(few)).count() == 0
    far = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [5.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(far).collect() if r.vec_id < 3} == {None}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, least_n=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_n}
    cut = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cut.setdefault(key, []).append(w)
    partners = {w: {o for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for o in cut[key] if o != w and near(w, o)} for w in words}
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), k, len(partners[w]), words[form[w]] if form[w] else -1) for w, k in words.items())


def variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_spelling_variants_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(docs)
    assert variants(queries.op12_spelling_variants(spark, SF)) == want and sum(1 for w in want if w[1]) > 10


def test_spelling_variants_of_dense_words(spark):
    """Few letters, so that many words are near each other, grams repeat within words and ranks tie; chains of forms."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice((6, 7, 8)))) for _ in range(400)]
    counts = {w: 5 * 5 ** rng.choice((0, 0, 1, 2)) for w in words} | {"a" * k: 5 ** (k - 4) for k in range(6, 10)}
    docs = [(i, " ".join([w.upper() if i % 2 and "é" not in w else w] * n)) for i, (w, n) in enumerate(counts.items())]
    docs += [(None, "abcdef " * 7), (1, None), (2, ""), (3, "aaaaaa" * 30000), (3, "short")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long").repartition(6)
    want = plain_variants(docs)
    assert variants(spelling.variant_groups(df)) == want and max(w[4] for w in want) > 5 and any(w[1] and w[1] != w[2] for w in want)
    assert spelling.variant_groups(df.limit(0)).count() == 0


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(6)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(6, 12)))
        frequency = {a + b: rng.randint(1, 9) for a in "abcd" for b in "abcd"}
        prefix, pivots, _ = spelling.prefix_and_pivots(word, frequency)
        pairs = [(p, q) for p in prefix for q in prefix if p[1] + 2 <= q[1]]
        assert len(prefix) >= 3 and tuple(pivots) in pairs
        cost = lambda pair: sum(frequency[g] for g, _ in pair)
        assert cost(pivots) == min(map(cost, pairs))


def brute(rows, k):
    """rows: (id, vector); the k nearest of each row whose id % 100 = 0."""
    v = np.array([r[1] for r in rows], dtype=float)
    out = {}
    for i, (name, own) in enumerate(rows):
        if name is not None and name % 100 == 0:
            d = np.sqrt(((v - np.array(own, dtype=float)) ** 2).sum(axis=1))
            out[name] = sorted((d[j], math.inf if rows[j][0] is None else rows[j][0]) for j in range(len(rows)) if j != i)[:k]
    return out


@pytest.mark.parametrize("block_rows", [16384, 40])
def test_neighbours_against_brute_force(spark, block_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 10)
    found = neighbours.nearest(table, F.col("vec_id") % 100 == 0, block_rows=block_rows, block_queries=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert set(got) == set(want) and all([r for r in got[q]] == sorted(got[q]) and len(got[q]) == 10 for q in got) and hits >= 0.9 * 10 * len(want)
    assert all(abs(s - dict((i, d) for d, i in want[q]).get(i, s)) < 1e-12 for q in got for s, i in got[q])
    if block_rows == 16384:
        assert sorted(map(tuple, queries.op13_nearest_neighbours(spark, SF).collect())) == sorted(map(tuple, found))


def test_neighbours_of_odd_rows_and_equal_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300, 0, -1)] + [(1000 + i, rng.standard_normal(3).tolist()) for i in range(200)] + [(None, [1.0, 2.0, 3.0]), (100, [9.0, 9.0, 9.0])]
    bad = [(700 + i, v) for i, v in enumerate(ODD[:7])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, p string").repartition(4)
    found = neighbours.nearest(df, F.col("vec_id") % 100 == 0, block_rows=50).collect()
    tied = sorted((r.rank, r.vec_id) for r in found if r.query_id == 200)
    assert tied == [(i + 1, v) for i, v in enumerate(range(1, 11))] and {r.score for r in found if r.query_id == 200} == {0.0}
    assert sorted(r.rank for r in found if r.query_id == 100) == sorted([*range(1, 11)] * 2) and not {r.vec_id for r in found} & set(range(700, 707))
    spread = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    for size in (200, 16384):  # far neighbours, so that the test rejects much
        ranks = {}
        for r in neighbours.nearest(spread, F.col("vec_id") % 100 == 0, block_rows=size, confidence=0.5).collect():
            ranks.setdefault(r.query_id, []).append(r.rank)
        assert len(ranks) == 30 and all(sorted(v) == list(range(1, 11)) for v in ranks.values())
    few = neighbours.nearest(df.where("vec_id in (299, 300, 1000)"), F.col("vec_id") == 300).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 299), (2, 1000)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0 and neighbours.nearest(df.where("vec_id = 300"), F.lit(True)).count() == 0


def test_chi_square_quantile():
    draws = np.random.default_rng(8).chisquare(8, 400_000)
    assert abs(np.quantile(draws, 0.97) - neighbours.chi_square_quantile(0.97, 8)) < 0.1
    assert math.isclose(neighbours.chi_square_quantile(0.95, 1), 3.841458820694124, rel_tol=1e-9)

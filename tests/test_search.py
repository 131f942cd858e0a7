"""Searches, similarity joins and ranks against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import vector as V
from textloom.operators import corpus, pairs, search, structure


def brute_knn(Q, C, k, metric):
    out = {}
    for i, q in Q.items():
        score = {"l2": lambda v: ((q - v) ** 2).sum(), "dot": lambda v: (q * v).sum(), "cosine": lambda v: (q * v).sum() / max(1e-300, np.sqrt((q * q).sum() * (v * v).sum()))}[metric]
        ranked = sorted((score(v) if metric == "l2" else -score(v), j) for j, v in C.items())
        out[i] = [(j, abs(s) if metric == "l2" else -s) for s, j in ranked[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("shipped", [search.SHIPPED, 0])
def test_knn(spark, monkeypatch, metric, shipped):
    """Queries in several blocks, broadcast or joined; equal vectors tie to the smaller id."""
    monkeypatch.setattr(search, "SHIPPED", shipped)
    r = np.random.default_rng(1)
    C = {i: r.normal(size=6) for i in range(150)}
    for i in range(40, 60):
        C[i] = C[40]
    Q = {i: C[i] for i in range(0, 150, 3)}
    corpus_ = spark.createDataFrame([(i, v.tolist()) for i, v in C.items()] + [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * 6)], "vec_id long, v array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in Q.items()] + [(903, None)], "query_id long, qv array<double>")
    got = {}
    for x in search.knn(asked, corpus_.repartition(5), 12, metric, block_queries=16).orderBy("query_id", "rk").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = brute_knn(Q, C, 12, metric)
    assert set(got) == set(want)
    for i in want:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]])
        assert [j for j, _ in got[i] if 40 <= j < 60] == sorted(j for j, _ in got[i] if 40 <= j < 60)
    assert [j for j, _ in got[42]][:12] == list(range(40, 52)) or metric == "dot"
    assert search.knn(asked.limit(0), corpus_, 3, metric).count() == 0 and search.knn(asked, corpus_.limit(0), 3, metric).count() == 0


def test_two_stages(spark):
    texts = spark.createDataFrame([(i, ["gandalf", f"w{i}"] if i % 2 else ["other"], [1.0, float(i)]) for i in range(30)], "text_id long, elements array<string>, v array<double>")
    queries = spark.createDataFrame([(1, ["gandalf", "gandalf"], [0.0, 1.0]), (2, [], [1.0, 0.0]), (3, ["xyzabc123"], [1.0, 0.0])], "query_id long, keywords array<string>, qv array<double>")
    got = search.two_stage(queries, texts, 3, most_candidates=5).orderBy("query_id", "rk").collect()
    assert [(r.query_id, r.text_id, r.total_candidates, r.candidates_reranked, r.mode) for r in got] == [
        (1, 9, 15, 5, "hybrid"), (1, 7, 15, 5, "hybrid"), (1, 5, 15, 5, "hybrid"), *[(q, i, 0, 0, "semantic") for q in (2, 3) for i in (0, 1, 2)]]
    assert [r.n_keywords for r in got] == [1] * 3 + [0] * 3 + [1] * 3


def test_expanded_search(spark):
    texts = spark.createDataFrame([(1, "Frodo estas hobito"), (2, "zzz qqq"), (3, "pri frodo"), (4, "kiu estas")], "text_id long, text string")
    queries = spark.createDataFrame([(7, "Kiu estas Frodo?"), (8, "Kie loĝas la hobitoj?")], "query_id long, q string")
    got = search.expanded_search(queries, texts, V.letter_counts, 2).orderBy("query_id", "rk").collect()
    assert [(r.query_id, r.text_id) for r in got][:2] == [(7, 3), (7, 1)] and got[0].score > 1.19


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("collapse", [False, True])
def test_similar_sets(spark, threshold, collapse):
    r = random.Random(3)
    sets = {i: frozenset(r.choices(range(60), weights=[60 - x for x in range(60)], k=r.randrange(1, 14))) for i in range(150)}
    sets |= {200 + i: frozenset(range(5)) for i in range(80)}  # copies: their elements are the commonest
    rows = spark.createDataFrame([(i, f"e{x}") for i, s in sets.items() for x in s], "id long, el string")
    got = {(x.id1, x.id2): (x.overlap, x.jaccard) for x in pairs.similar_sets(rows, threshold, collapse).collect()}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    ids = sorted(rep.values()) if collapse else sorted(sets)
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] & sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}
    if collapse:
        want |= {(rep[s], i): (len(s), 1.0) for i, s in sets.items() if rep[s] != i}
    assert got == want


def test_prefix_similar(spark):
    r = random.Random(4)
    known = sorted({"".join(r.choices("abc", k=r.randrange(1, 7))) for _ in range(200)})
    new = sorted({"".join(r.choices("abcd", k=7)) for _ in range(60)})
    got = {}
    near = pairs.prefix_similar(spark.createDataFrame([(w,) for w in new], "n string"), "n", spark.createDataFrame([(w,) for w in known], "k string"), "k", 4, 5)
    for x in near.orderBy("n", "rk").collect():
        got.setdefault(x.n, []).append((x.shared, x.k))
    shared = lambda a, b: next((i for i in range(4, 0, -1) if len(b) >= i and a[:i] == b[:i]), 0)
    want = {n: sorted(((shared(n, k), k) for k in known if shared(n, k)), key=lambda x: (-x[0], x[1]))[:5] for n in new}
    assert got == {n: w for n, w in want.items() if w}


def test_latency(spark):
    r = random.Random(5)
    rows = [("a" if i % 3 else None, float(r.randrange(50))) for i in range(400)] + [("b", 7.0), ("c", None)]
    got = {x.k: x for x in corpus.latency(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == {"a", "b", None}
    for k in got:
        v = sorted(x for y, x in rows if y == k and x is not None)
        assert (got[k].n, got[k].p95, got[k].lo, got[k].hi) == (len(v), v[int(0.95 * len(v))], v[0], v[-1])
        assert abs(got[k].median - float(np.median(v))) < 1e-6 and abs(got[k].mean - float(np.mean(v))) < 1e-5


def test_generation_scores(spark):
    rows = [(1, "a b a c".split(), "a b b".split()), (2, [], ["x"]), (3, ["x"], ["x"]), (4, ["y"], ["x"])]
    got = {x.k: x for x in structure.generation_scores(spark.createDataFrame(rows, "k long, x array<string>, y array<string>"), ["k"]).collect()}
    assert abs(got[1].rouge1 - 4 / 7) < 1e-9 and abs(got[1].rouge2 - 2 / 5) < 1e-9
    assert abs(got[1].bleu - np.sqrt((2 / 4) * (1 / 3))) < 1e-6
    assert (got[2].rouge1, got[2].bleu, got[3].rouge1, got[4].rouge1) == (0.0, 0.0, 1.0, 0.0)


def test_ways_of_composition(spark):
    df = spark.createDataFrame([([1.0, 2.0], [[0.0, 1.0], [4.0, 1.0]]), ([1.0, 2.0], [])], "r array<double>, a array<array<double>>")
    got = df.select(V.compose_sum(F.col("r"), F.col("a")).alias("s"), V.compose_gated(F.col("r"), F.col("a"), 0.0, 0.0).alias("g"), V.compose_attention(F.col("r"), F.col("a")).alias("w")).collect()
    assert got[0].s == [3.0, 3.0] and got[0].g == [2.0, 2.5] and got[1].s == got[1].g == got[1].w == [1.0, 2.0]
    parts = np.array([[1.0, 2.0], [0.0, 1.0], [4.0, 1.0]])
    e = np.exp(parts @ [1.0, 2.0] / np.sqrt(2))
    assert np.allclose(got[0].w, (e[:, None] * parts).sum(0) / e.sum())

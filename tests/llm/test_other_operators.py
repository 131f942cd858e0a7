"""Classifiers, sharding, mixing, licences, nearest neighbours and the pipeline."""

import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import EDGE, SCHEMA, rows_of, words
from tests.llm.test_text_operators import brute_components
from textloom.llm import quality, queries, toxicity
from textloom.llm._labelled import training_sample
from textloom.llm.ann import nearest
from textloom.llm.license_scan import scan_licences
from textloom.llm.mixing import fair_mix
from textloom.llm.sharding import places, shard

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def labelled(spark, n=600):
    bad = ["moron", "scum", "clown", "idiot"]
    pairs, labels = [], []
    for i in range(n):
        w = words(60, i)
        if i % 4 == 0:
            w[10:12] = random.Random(i).sample(bad, 2)
        if i % 3 == 0:
            w = [x.upper() + "!!" for x in w]
        pairs.append((i, " ".join(w), "a"))
        labels.append((i, 0 if i % 3 == 0 else 1, int(i % 4 == 0)))
    return spark.createDataFrame(rows_of(pairs), SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind, module", [("toxic", toxicity), ("quality", quality)])
def test_held_out_rows(spark, kind, module, edge, none):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels)
    truth = {r.doc_id: r[kind] for r in labels.collect()}
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 80 and sum((got[i] >= 0.5) == (truth[i] == 1) for i in out) >= 0.97 * len(out)
    scores = [r.score for r in module.score(edge, model).collect()]
    assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores)
    assert module.score(none, model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels(spark, module, edge):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in module.score(edge, module.fit(edge, empty)).collect())


def brute_segments(scores):
    """All maximal scoring segments, by the definition: repeatedly the best one, then left and right of it."""
    out = []

    def split(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if best[0] <= 1e-12:
            return
        a, b = -best[2], best[3]
        out.append((a, b - 1, best[0]))
        split(lo, a)
        split(b, hi)

    split(0, len(scores))
    return sorted(out)


def test_segments_are_maximal():
    r = random.Random(6)
    for _ in range(60):
        hits = [(i, r.choice([0.31, 0.77, 1.13, 2.09])) for i in range(24) if r.random() < 0.3]
        scores = [-0.37] * 24
        for i, s in hits:
            scores[i] = s
        got = toxicity.maximal_segments(hits, 0.37)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, brute_segments(scores)))


def test_segments_of_many_hits_take_linear_time():
    r = random.Random(16)
    # Rising, falling and level totals: each kind made the search for a lower start long.
    for gap in (3, 15, 30):
        hits = [(i * gap, 1.0 + r.random()) for i in range(200_000)]
        begin = time.perf_counter()
        assert toxicity.maximal_segments(hits, 0.1)
        assert time.perf_counter() - begin < 5


def test_the_sample_is_bounded_also_for_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 5 + 1, f"text {i}") for i in range(50)] + [(9, None), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(2, 1)], "doc_id long, toxic int")
    got = training_sample(docs, labels, "toxic", 3).collect()
    assert len(got) <= 3
    every = training_sample(docs, labels, "toxic", 100).collect()
    learnt = {i for i in (1, 3, 4, 5, 9) if zlib.crc32(str(i).encode()) % 5}
    assert len(every) == len(learnt) and sorted(map(str, every)) == sorted(map(str, training_sample(docs, labels, "toxic", 100).collect()))


def test_sharding(spark, none):
    pairs = EDGE + [(100 + i, f"text {i // 3}", "a") for i in range(300)] + [(500 + i, "hot", "b") for i in range(150)]
    got = shard(spark.createDataFrame(rows_of(pairs), SCHEMA), 8).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(8)]
    assert sum(counts) == len(pairs) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {i: t for i, t, _ in pairs}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.size == len((text[r.doc_id] or "").encode()) + 1 for r in got)
    homes = defaultdict(set)
    for r in got:
        if 100 <= r.doc_id < 400:
            homes[text[r.doc_id]].add(r.shard)
    # Dealt by hash, a group of three meets in one shard once in 64 times.
    assert sum(len(h) == 1 for h in homes.values()) > 40
    assert shard(none).count() == 0


def test_groups_larger_than_a_shard(spark):
    assert places([100, 80], 240, 8) == [[(0, 30), (1, 30), (2, 30), (5, 10)], [(3, 30), (4, 30), (5, 20)]]
    assert places([], 5, 8) == [] and places([9], 9, 8) == [[(s, 1 + (s == 0)) for s in range(8)]]
    pairs = [(i, "hot" if i % 3 == 0 else f"text {i // 6}" if i % 3 == 1 else f"own {i}", "a") for i in range(900)]
    got = shard(spark.createDataFrame(rows_of(pairs), SCHEMA), 8).collect()
    sizes, hot, homes = Counter(r.shard for r in got), Counter(r.shard for r in got if r.doc_id % 3 == 0), defaultdict(set)
    assert sum(sizes.values()) == 900 and max(sizes.values()) - min(sizes.values()) <= 1
    # Spread over all shards, an eighth of the pairs meets; at best 2 * (113 / 300)^2 + (74 / 300)^2.
    assert sum(k * (k - 1) for k in hot.values()) / (300 * 299) > 0.28
    for r in got:
        if r.doc_id % 3 == 1:
            homes[r.doc_id // 6].add(r.shard)
    assert sum(len(h) == 1 for h in homes.values()) > 75


def test_mixing(spark, none):
    r = random.Random(7)
    pairs = EDGE[:-2] + [(100 + i, " ".join(words(r.randrange(1, 30), i)), r.choice("aaaabc")) for i in range(600)]
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    got = fair_mix(docs).collect()
    assert len(got) == len(pairs) and sorted(map(tuple, got), key=str) == sorted(map(tuple, fair_mix(docs).collect()), key=str)
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert all(x.source_size == size[x.source] for x in got)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # Water filling by hand.
    want, left, rest = {}, 1.5 * sum(size.values()), set(order)
    while rest:
        share = left / sum(weight[s] for s in rest)
        full = {s for s in rest if 2 * size[s] <= share * weight[s]}
        if not full:
            want |= {s: share * weight[s] for s in rest}
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
        rest -= full
    assert all(abs(target[s] - want[s]) < 1e-6 for s in order)
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert fair_mix(none).count() == 0


def test_mixing_of_tiny_documents(spark):
    """Ranges of the global order follow the data: many one-word documents do not meet in one of them."""
    pairs = [(i, " ".join(["w"] * 400), "long") for i in range(30)] + [(1000 + i, "w", "tiny") for i in range(3000)]
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    got = fair_mix(docs, carry=["lang"]).collect()
    assert all(x.lang == "en" for x in got) and len(got) == len(pairs)
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
    target = {x.source: x.target for x in got}
    assert all(abs(taken[s] - target[s]) <= 400 for s in target)


def test_mixing_of_rows_without_doc_id(spark):
    rows = [(None, f"word {i} and more", "a") for i in range(60)] + [(3, f"text {i} x", "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = fair_mix(docs, carry=["text"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, fair_mix(docs.repartition(7), carry=["text"]).collect()), key=str)
    assert {x.text for x in got} == {t for _, t, _ in rows}


MIT_TEXT = """MIT License

Copyright (c) 2020 A. Nyone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
HEADER = """#!/usr/bin/env python
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
#
import os
""" + "\n".join(f"x{i} = {i} + y{i}" for i in range(300))


def test_licences(spark):
    code = "\n".join(f"line {i} of code" for i in range(60))
    rows = [
        ("p/LICENSE", "Licensed under the Apache License, Version 2.0.\n" + code), ("p/q/a", "code"), ("p/q/r/b", None), ("p/q/r/COPYING.txt", "Released under the MIT License.\n" + code),
        ("p/q/r/s/c", ""), ("z/d", "code"), ("z/e", "x y\nThis work is licensed under the GNU General Public License, version 3.\n" + code), ("top", "the license of the version"),
        ("m/terms", MIT_TEXT), ("m/n/f", "plain"), ("h/head.py", HEADER), ("h/other.py", "y = 2"), ("s/x.c", "// SPDX-License-Identifier: BSD-3-Clause\n" + code), ("s/y.c", "int y;"), (None, MIT_TEXT),
        ("t/u", "a license of none"), ("t/u", "Released under the MIT License."), ("t/u", "Released under the MIT License."),
    ]
    schema = "path string, text string, licence string, score int, n_words int, hits string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema)
    got = Counter((r.path, r.declared, r.licence, r.from_dir) for r in scan_licences(df).collect())
    assert got == Counter([
        ("p/LICENSE", "Apache-2.0", "Apache-2.0", None), ("p/q/a", None, "Apache-2.0", "p"), ("p/q/r/b", None, "MIT", "p/q/r"), ("p/q/r/COPYING.txt", "MIT", "MIT", None),
        ("p/q/r/s/c", None, "MIT", "p/q/r"), ("z/d", None, None, None), ("z/e", "GPL-3.0", "GPL-3.0", None), ("top", None, None, None),
        ("m/terms", "MIT", "MIT", None), ("m/n/f", None, "MIT", "m"), ("h/head.py", "Apache-2.0", "Apache-2.0", None), ("h/other.py", None, None, None),
        ("s/x.c", "BSD-3-Clause", "BSD-3-Clause", None), ("s/y.c", None, None, None), (None, None, None, None), ("t/u", "MIT", "MIT", None), ("t/u", "MIT", "MIT", None), ("t/u", "MIT", "MIT", None),
    ])
    assert scan_licences(df.limit(0)).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(8)
    V = np.r_[r.normal(size=(700, 16)), 5 + 1e-3 * r.normal(size=(300, 16)), np.repeat(r.normal(size=(1, 16)), 40, axis=0)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(V)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [math.nan] + [1.0] * 15, 0), (2003, [math.inf] + [1.0] * 15, 0), (2004, [None] + [1.0] * 15, 0), (2005, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h int")
    got = nearest(df, df.filter("vec_id % 20 = 0"), 10, shard_rows=300).collect()
    by = defaultdict(list)
    for x in sorted(got, key=lambda x: x.rank):
        by[x.query_id].append((x.vec_id, x.score))
    hits = total = 0
    for q in range(0, len(V), 20):
        d = np.sqrt(((V - V[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(V)), d))[:10]
        assert all(abs(s - d[i]) < 1e-9 for i, s in by[q]) and [x for x in by[q]] == sorted(by[q], key=lambda x: (x[1], x[0]))
        hits += len(set(want) & {i for i, _ in by[q]})
        total += 10
    assert hits >= 0.95 * total
    assert [i for i, _ in by[1000]] == [1001 + i for i in range(10)]  # equal vectors: ties to smaller ids
    assert nearest(df.limit(0), df, 10).count() == 0
    assert sorted(r.vec_id for r in nearest(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 10).collect()) == [1, 2]


def brute_nearest(V, q, k):
    d = np.sqrt(((V - V[q]) ** 2).sum(1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(V)), d))[:k]


def test_nearest_with_repeated_rows(spark):
    r = np.random.default_rng(9)
    V = r.normal(size=(60, 4))
    V[6] = V[5]
    rows = [(i, v.tolist()) for i, v in enumerate(V)] + [(5, V[5].tolist())] * 15 + [(7, (V[7] + 9).tolist())] * 3
    V[7] = min(V[7].tolist(), (V[7] + 9).tolist())  # of several vectors under one id the least one is taken
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in sorted(nearest(df, df, 10).collect(), key=lambda x: x.rank):
        got[x.query_id].append(x.vec_id)
    assert got == {q: brute_nearest(V, q, 10).tolist() for q in range(60)}
    assert got[5][0] == 6 and got[6][0] == 5


def test_recall_over_many_shards(spark):
    """Queries search as many cells as the sample tells."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet") if os.path.isdir("/root/testdata/sf0.1") else None
    if e is None:
        pytest.skip("no test data")
    got = nearest(e, e.filter("vec_id % 20 = 0"), 10, shard_rows=50).collect()
    rows = e.orderBy("vec_id").collect()
    V, ids = np.array([x.embedding for x in rows], float), np.array([x.vec_id for x in rows])
    found = defaultdict(set)
    for x in got:
        found[x.query_id].add(x.vec_id)
    hits = sum(len(found[ids[q]] & set(ids[brute_nearest(V, q, 10)].tolist())) for q in range(len(ids)) if ids[q] % 20 == 0)
    assert hits >= 0.9 * 10 * sum(ids % 20 == 0)


@data
def test_recall_on_the_fixture(spark):
    got = queries.op10_nearest(spark, SF).collect()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    V, ids = np.array([r.embedding for r in e]), np.array([r.vec_id for r in e])
    hits = 0
    asked = {r.query_id for r in got}
    for q in asked:
        d = ((V - V[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 10 * len(asked)


@data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    from tools.compare import TABLES, digest, plain

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert digest([tuple(plain(r[c]) for c in cols) for r in df.collect()]) == digest([tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall()])


@data
def test_stages_keep_rows_without_doc_id_and_repeated_ones(spark):
    r = random.Random(11)
    ids = [None] * 40 + [7] * 20 + [8] * 6 + list(range(100, 160))
    pairs = [(i, None if n % 20 == 3 else " ".join(words(r.randrange(1, 12), n)), r.choice(["a", "b", None])) for n, i in enumerate(ids)]
    pairs += [(None, "same text", "a")] * 5 + [(7, "same text", "a")] * 5
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, "")
    size = lambda t: len((t or "").split())
    taken, mix = Counter(), Counter()
    for x in mixed.collect():
        taken[x.doc_id, x.source, size(x.text)] += 1
    for x in fair_mix(docs).collect():
        mix[x.doc_id, x.source, x.size] += x.repeats
    assert taken == +mix and any(i is None for i, _, _ in taken)
    rows = Counter(pairs)
    times = Counter((x.doc_id, x.text, x.source) for x in mixed.collect())
    assert mixed.columns == docs.columns and all(n <= 2 * rows[p] for p, n in times.items())
    out = stages["sharding"](spark, docs, "")
    assert [c for c in out.columns if c not in docs.columns] == ["size", "text_crc32", "slot"]
    out = out.collect()
    assert Counter((x.doc_id, x.text, x.source) for x in out) == rows
    assert len({(x.shard, x.slot) for x in out}) == len(pairs)
    assert all(x.size == len((x.text or "").encode()) + 1 and x.text_crc32 == zlib.crc32((x.text or "").encode()) for x in out)


CLASHING = SCHEMA + ", repeats int, size long, text_crc32 long, slot long, _row long, component_id long, turn int"


@data
@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_cases(spark, stage):
    """Clashing names, nulls, empty and long texts, repeated rows and ids, empty tables."""
    more = [(None, "z y x w v u", "a"), (None, "z y x w v u", "a"), (4, "other text under four, of eight words", "b"), (None, None, None), (None, "", "b")]
    pairs = EDGE + more
    docs = spark.createDataFrame([(*r, 5, 6, 7, 8, 9, 10, 11) for r in rows_of(pairs)], CLASHING)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, SF)
    if stage == "sharding":
        assert set(docs.columns) <= set(out.columns) and out.count() == len(pairs)
    else:
        assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    if stage == "mixing":
        assert all(0 < n <= 2 * Counter(pairs)[p] and p[1].split() for p, n in got.items())
    elif stage == "near_dedup":
        # One of each group: (4, 5), (6, 7, 7), (12, 13) and the two rows without doc_id; rows without words stay.
        gone = [(5, "One  TWO", "b"), (7, "ONE two three four five", "c"), (7, "ONE two three four five", "c"), (13, EDGE[-1][1], "b"), more[0]]
        assert got == Counter(pairs) - Counter(gone)
    else:
        assert got == Counter(pairs)
    assert run(spark, docs.limit(0), SF).count() == 0


def test_rows_are_told_apart(spark, tmp_path):
    """By file and place where the frame is a scan, else by a written number."""
    from textloom.llm._util import Workspace, with_place

    docs = spark.range(50).selectExpr("id % 3 as doc_id", "'t' as text", "1 as _file")
    docs.repartition(4).write.parquet(f"{tmp_path}/d")
    scan = spark.read.parquet(f"{tmp_path}/d")
    for frame, n in ((docs, 50), (scan, 50), (scan.filter("doc_id = 1"), 17), (scan.union(scan), 100), (scan.selectExpr("doc_id", "text", "explode(array(1, 2)) as _file"), 100)):
        rows, at = with_place(frame, Workspace(spark, "test"))
        assert rows.columns == [*frame.columns, *at] and rows.select(*at).distinct().count() == n


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert all(i in kept for i, t in truth.items() if not t)
    one = stages["near_dedup"](spark, docs, sf)
    want = brute_components({r.doc_id: r.text for r in docs.collect()})
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {r.doc_id for r in docs.collect() if any(t in (r.text or "") for t in items)}
    left = stages["decontamination"](spark, docs, sf)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - held
    mixed = stages["mixing"](spark, one, sf)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    want_times = {r.doc_id: r.repeats for r in fair_mix(one).collect() if r.repeats}
    assert times == want_times
    out = stages["sharding"](spark, mixed, sf).collect()
    assert len(out) == sum(times.values())
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    run = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) <= set(run.columns) and run.count() > 0

"""Properties of the corpus, pair and search operators."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vector as V
from textloom.operators import corpus as C
from textloom.operators import pairs as P
from textloom.operators import search as S
from textloom.sources import readers as R
from textloom.sources import writers as W


def test_first_copy_is_chosen_before_the_quality_rule(spark):
    a = spark.createDataFrame([(1, "x", 0.1)], "id long, text string, rate double")
    b = spark.createDataFrame([(1, "x", 0.9), (2, "y", 0.9)], "id long, text string, rate double")
    got = C.merge([a, b], "text", ["id"], F.col("rate") >= 0.5).select("text").collect()
    assert [r.text for r in got] == ["y"]


def test_rank_is_gapless_and_ordered(spark):
    rows = C.with_rank(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), [F.col("k")], "rk").collect()
    assert sorted((r.k, r.rk) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_coverage_ends_at_one(spark):
    got = C.coverage(spark.createDataFrame([("a",), ("b",), ("a",)], "w string"), "w", None).orderBy("rk").collect()
    assert [r.w for r in got] == ["a", "b"] and got[-1].coverage == 1.0


def test_jaccard_is_exact(spark):
    rows = [(1, x) for x in "abcd"] + [(2, x) for x in "abce"] + [(3, x) for x in "xyz"]
    got = P.similar_sets(spark.createDataFrame(rows, "id long, el string"), 0.5).collect()
    assert [(r.id1, r.id2, r.overlap, r.jaccard) for r in got] == [(1, 2, 3, 0.6)]


def test_cluster_quality_equals_pairs(spark):
    df = spark.createDataFrame([(i, 0, [float(i), 1.0, 2.0]) for i in range(5)], "vec_id long, label int, embedding array<double>")
    inside = S.cluster_quality(df).first().inside
    a, b = df.select(F.col("vec_id").alias("i"), F.col("embedding").alias("x")), df.select(F.col("vec_id").alias("j"), F.col("embedding").alias("y"))
    mean = a.join(b, F.col("i") != F.col("j")).agg(F.avg(V.cosine(F.col("x"), F.col("y")))).first()[0]
    assert abs(inside - mean) < 1e-9


def test_zero_vector_has_cosine_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_chunks_reach_the_end(spark):
    for n in (0, 1, 9, 10, 64, 65, 118, 119, 500):
        ws = [str(i) for i in range(n)]
        got = spark.createDataFrame([(ws,)], "w array<string>").select(T.chunks(F.col("w"), 64, 10).alias("c")).first().c
        want, at = [], 0
        while n and True:
            want.append(" ".join(ws[at : at + 64]))
            if at + 64 >= n:
                break
            at += 54
        assert got == want, n


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([("D-ro. Zamenhof venis. Li parolis! Ĉu vere? Jes.",)], "t string")
    assert df.select(T.split_sentences(F.col("t")).alias("s")).first().s == ["D-ro. Zamenhof venis.", "Li parolis!", "Ĉu vere?", "Jes."]


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([("  a   b — c “d” ĝx cxu ",)], "t string")
    once = df.select(T.preprocess(F.col("t")).alias("t"))
    assert once.first().t == once.select(T.preprocess(F.col("t")).alias("t")).first().t


def test_html(spark):
    df = spark.createDataFrame([("<p>a&nbsp;<b>b</b></p><script>x<y</script><!-- c -->d",)], "t string")
    assert df.select(T.html_to_text(F.col("t")).alias("t")).first().t == "a b d"


def test_latin1_and_utf8_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ĉevalo".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    got = {r.path[-5:]: r.text for r in R.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "ĉevalo", "b.txt": "é"}
    assert {r.text for r in R.read_texts_ignoring_errors(spark, str(tmp_path)).collect()} == {"ĉevalo", ""}


def test_lexicon_lines(spark, tmp_path):
    (tmp_path / "uv.txt").write_text("abel|abeille|bee|Biene|pchela|pszczola\nabel|x|x|x|x|x\nbad line\n")
    got = R.read_lexicon(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].root == "abel" and got[0].translations["en"] == "bee"


def test_root_map(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"roots": {"hund": {"en": "dog"}, "kat": {"en": "cat"}}}')
    assert {r.root: r.entry["en"] for r in R.read_root_map(spark, str(tmp_path / "r.json")).collect()} == {"hund": "dog", "kat": "cat"}


def test_listed_files_in_order(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    got = R.read_listed(spark, str(tmp_path), ["c.txt", "a.txt"]).orderBy("order").collect()
    assert [r.line for r in got] == ["c", "a"]
    assert [r.file for r in R.missing_files(spark, str(tmp_path), ["a.txt", "z.txt"]).collect()] == ["z.txt"]


def test_existing_output_is_refused(spark, tmp_path):
    df = spark.range(3)
    W.write_jsonl(df, str(tmp_path / "o"))
    try:
        W.write_jsonl(df, str(tmp_path / "o"))
    except Exception as e:
        assert "PATH_ALREADY_EXISTS" in str(e)
    else:
        raise AssertionError("written twice")


def test_ids_go_on(spark, tmp_path):
    path = str(tmp_path / "m")
    for _ in range(2):
        W.append_with_ids(spark.range(3).toDF("k"), path, [F.col("k")])
    assert sorted(r.entry_id for r in spark.read.parquet(path).collect()) == [f"LTM-{i:06d}" for i in range(1, 7)]


def _query(spark, tmp_path, name, **tables):
    """The query's rows and those of its SQL on tables of one's own."""
    import duckdb

    from textloom.plans import all_queries, registry  # noqa: F401

    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    rel = con.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    return df, sorted(map(tuple, df.collect()), key=str), sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_quality_of_empty_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a \u00a7 b")], "doc_id long, text string")
    _, got, want = _query(spark, tmp_path, "assess_quality", documents=docs)
    assert got == want and len(got) == 3


def test_overlaps_are_counted_once(spark, tmp_path):
    """A pair is counted where its first set is: no join on pairs, no sets brought to them."""
    rows = spark.range(3000).selectExpr("id * 7 % 40 AS l_suppkey", "id * 13 % 150 AS l_partkey")
    df, got, want = _query(spark, tmp_path, "overlap_pairs", lineitem=rows)
    assert got == want and "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_large_group_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "GROUP_BLOCK", 16)
    rows = spark.range(300).selectExpr("id AS vec_id", "IF(id < 200, 1, id % 3) AS label").union(spark.sql("SELECT 999L, NULL"))
    df, got, want = _query(spark, tmp_path, "cluster_pairs", embeddings=rows)
    assert got == want and "i#" in df._jdf.queryExecution().executedPlan().toString()


def test_prices_meet_in_ranges(spark, tmp_path):
    prices = [0.0, 9.9, 10.0, 10.001, 19.99, 20.0, -0.5, -9.9, 1e18, 1e18, float("inf"), float("inf"), float("nan"), None, 30.0, 20.002]
    part = spark.createDataFrame([(i, "b", 1, p) for i, p in enumerate(prices)], "p_partkey long, p_brand string, p_size int, p_retailprice double")
    df, got, want = _query(spark, tmp_path, "value_conflicts", part=part)
    assert got == want and len(got) > 10 and "FLOOR" in df._jdf.queryExecution().executedPlan().toString().upper()


def test_similar_sets_in_blocks(spark, monkeypatch):
    """Against plain Python, in one block and in several, with pieces and frequent elements."""
    import random

    rnd = random.Random(3)
    sets = {i: frozenset(rnd.sample(range(5), 3)) | frozenset(rnd.sample(range(5, 60), rnd.randint(0, 6))) for i in range(150)}
    df = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id long, el long")
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.4}
    for piece in (1024, 20):
        monkeypatch.setattr(P, "PIECE", piece)
        out = P.similar_sets(df, 0.4)
        got = out.collect()
        assert {(r.id1, r.id2): r.jaccard for r in got} == want and len(got) == len(want)
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    # Pieces inside of one pair of blocks, with side 0 and 1.
    import pyarrow as pa

    rows = [(i, sorted(s), int(i % 2)) for i, s in sets.items()]
    table = pa.table({"id": [r[0] for r in rows], "els": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "side": [r[2] for r in rows]})
    met = P._meet(table, 0.4).to_pylist()
    assert {(min(r["id1"], r["id2"]), max(r["id1"], r["id2"])): r["jaccard"] for r in met} == {k: v for k, v in want.items() if sum(k) % 2}


def test_a_search_holds_no_more_than_its_best(spark, monkeypatch):
    """Ties are decided where they are met, and blocks of both sides give what one place gives."""
    import numpy as np
    import pyarrow as pa

    one = S._Nearest(pa.array([7]), np.ones((1, 2)), 3, "cosine", 512)
    for at in (500, 0):
        one.meet(pa.array(range(at, at + 500)), np.ones((500, 2)))
    assert one.found[0].num_rows == 3 and [b["vec_id"].to_pylist() for b in one.batches()] == [[0, 1, 2]]
    rnd = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rnd.integers(-3, 4, 4 + 2 * (i % 2)).astype(float).tolist()) for i in range(120)], "vec_id long, v array<double>")
    df = df.union(spark.sql("SELECT 999L, CAST(NULL AS array<double>)"))
    asked = df.toDF("query_id", "qv")
    key = lambda out: sorted((r.query_id, r.rk, r.vec_id, r.score) for r in out.collect())
    want = key(S.knn(asked, df, 5, "l2"))
    monkeypatch.setattr(S, "SHIPPED", 0)
    monkeypatch.setattr(S, "BLOCK_NUMBERS", 100)
    out = S.knn(asked, df, 5, "l2")
    assert key(out) == want and len(want) == 600 and "CoGroups" in out._jdf.queryExecution().executedPlan().toString()


def test_stream_reads_many_files_at_once(spark, tmp_path, monkeypatch):
    from textloom.plans import io_queries

    seen = []
    read = io_queries.replay.stream_parquet
    monkeypatch.setattr(io_queries.replay, "stream_parquet", lambda s, path, *a: seen.append((path, a[1])) or read(s, path, *a))
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 90) AS text")
    _, got, want = _query(spark, tmp_path, "stream_dedup", documents=docs)
    files = [f for f in os.listdir(seen[0][0].removeprefix("file:")) if f.endswith(".parquet")]
    assert got == want and len(files) > 3 and seen[0][1] == 2


def test_generation_is_scored_in_its_row(spark):
    import random
    from collections import Counter

    from textloom.operators import structure as O

    rnd = random.Random(5)
    rows = [(i, [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]) for i in range(60)]
    out = O.generation_scores(spark.createDataFrame(rows, "k long, x array<string>, y array<string>"), ["k"])
    got = {r.k: r for r in out.collect()}
    for k, x, y in rows:
        for n, score in ((1, got[k].rouge1), (2, got[k].rouge2)):
            a, b = (Counter(zip(*[w[i:] for i in range(n)])) for w in (x, y))
            m, size = sum((a & b).values()), sum(a.values()) + sum(b.values())
            assert abs(score - (2 * m / size if size else 0)) < 1e-9
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_partners_are_found_once_for_a_beginning(spark):
    """Nothing is grouped or ranked for single new words; copies of a word are one."""
    new = spark.createDataFrame([(f"abcd{i % 20}",) for i in range(40)] + [("ab",), ("zz",)], "new_w string")
    known = spark.createDataFrame([(w,) for w in ("abcde", "abcx", "abz", "abcdd", "b", "a")], "w string")
    out = P.prefix_similar(new, "new_w", known, "w", 4, 3)
    got = {(r.new_w, r.rk): (r.w, r.shared) for r in out.collect()}
    want = {1: ("abcdd", 4), 2: ("abcde", 4), 3: ("abcx", 3)}
    assert {k: v for k, v in got.items() if k[0] != "ab"} == {(f"abcd{i}", rk): v for i in range(20) for rk, v in want.items()}
    assert [got["ab", i] for i in (1, 2, 3)] == [("abcdd", 2), ("abcde", 2), ("abcx", 2)] and len(got) == 63
    assert "Window [row_number() windowspecdefinition(begin" in out._jdf.queryExecution().optimizedPlan().toString()


def test_cooccurrence_counts_where_the_texts_are(spark, tmp_path):
    texts = ["a b a c", "b a ĉ a", None, "", "a", "z z z", "a b"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "a b a b"), (1, "ĉ ĉ b")]
    df, got, want = _query(spark, tmp_path, "cooccurrence", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want and got
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_cooccurrence_in_pieces():
    words = [f"w{i * i % 7}" for i in range(50)]
    text = np.repeat(np.arange(10), 5)
    want = Counter(tuple(sorted((words[i], words[j]))) for i in range(50) for j in range(i + 1, min(i + 4, 50)) if text[i] == text[j])
    parts = [r for i in range(0, 50, 8) for r in P._pairs_near(pa.array(words[i : i + 11]), text[i : i + 11], 3, 4, 8)]
    got = {}
    for bucket in {r[0] for r in parts}:
        table = pa.table({c: [r[k] for r in parts if r[0] == bucket] for k, c in enumerate(["bucket", "lengths", "letters", "a", "b", "n"])})
        got |= {(r["w1"], r["w2"]): r["n"] for r in P._pairs_summed(table, 2).to_pylist()}
    assert got == {k: n for k, n in want.items() if n >= 2}


def test_signs_of_the_language_are_one_search(spark, tmp_path):
    texts = ["x as xo o. Xas k. LA. lak. xla. KUN1. aj. kaj. ŭ. Ĝ", "xyz. X1o. xy1o. xyo1. x-o. xoj-x. o xn. bcd", "İo. \U0001d400o. \U0001d400\U0001d400o. éo. xéo", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang")
    df, got, want = _query(spark, tmp_path, "has_markers", documents=docs)
    assert got == want and got
    assert "regexp_extract_all" not in df._jdf.queryExecution().executedPlan().toString()

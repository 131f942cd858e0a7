"""Queries over vectors, questions and answers, metrics, registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx
from textloom.functions import qa as Q
from textloom.functions import text as T
from textloom.functions import vector as V
from textloom.operators import search as S
from textloom.operators.pairs import parts_of
from textloom.operators.shared import written
from textloom.plans.registry import Tables, query
from textloom.plans.text_queries import EXPANDED, QUESTIONS, questions, strip_sql

DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
L2 = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: (CAST({0}[i] AS DOUBLE) - CAST({1}[i] AS DOUBLE)) * (CAST({0}[i] AS DOUBLE) - CAST({1}[i] AS DOUBLE))))"
COS = f"({DOT.format('a.embedding', 'b.embedding')} / ({NORM.format('a.embedding')} * {NORM.format('b.embedding')}))"


def asked(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def stored(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").alias("v"), "label")


@query("scan_vectors", f"SELECT vec_id, label, len(embedding) AS dim, round({NORM.format('embedding')}, 6) AS norm FROM embeddings")
def scan_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("cosine_pairs", f"SELECT a.vec_id AS id1, b.vec_id AS id2, round({COS}, 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t: Tables) -> DataFrame:
    a, b = t.embeddings.toDF("id1", "va", "la"), t.embeddings.toDF("id2", "vb", "lb")
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cos"))


@query("l2_normalize", f"SELECT vec_id, i, round(embedding[i] / {NORM.format('embedding')}, 6) AS x FROM embeddings, range(1, 65) r(i)")
def l2_normalize(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("p", "x"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("vector_topk", f"SELECT b.vec_id, round({DOT.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {DOT.format('a.embedding', 'b.embedding')} DESC, b.vec_id LIMIT 10")
def vector_topk(t: Tables) -> DataFrame:
    q = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("qv"))
    scored = stored(t).join(F.broadcast(q), F.lit(True)).select("vec_id", V.dot(F.col("qv"), F.col("v")).alias("s"))  # one query
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


KNN = f"""SELECT query_id, vec_id, round(s, 6) AS score, rk FROM (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rk FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rk <= 10"""


@query("knn_topk", KNN)
def knn_topk(t: Tables) -> DataFrame:
    out = S.knn(asked(t), stored(t), 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


@query("l2_topk", f"""SELECT query_id, vec_id, round(s, 6) AS score, rk FROM (SELECT a.vec_id AS query_id, b.vec_id, {L2.format('a.embedding', 'b.embedding')} AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2.format('a.embedding', 'b.embedding')}, b.vec_id) AS rk FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rk <= 10""")
def l2_topk(t: Tables) -> DataFrame:
    out = S.knn(asked(t), stored(t), 10, "l2")
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


@query("mean_pool", "SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def mean_pool(t: Tables) -> DataFrame:
    rows = S.mean_pool(t.embeddings, ["label"], "embedding").select("label", F.posexplode("embedding").alias("p", "x"))
    return rows.select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("role_pool", """SELECT label, i, round(CASE WHEN label % 2 = 1 AND i <= 32 THEN -1 ELSE 1 END * sum(embedding[i] * w) / sum(w), 6) AS x FROM (
  SELECT label, i, CAST(embedding[i] AS DOUBLE) AS e, embedding, (CASE vec_id % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 1.5 ELSE 1.0 END)::DOUBLE AS w FROM embeddings, range(1, 65) r(i)) GROUP BY label, i""")
def role_pool(t: Tables) -> DataFrame:
    w = F.when(F.col("vec_id") % 3 == 0, 1.2).when(F.col("vec_id") % 3 == 1, 1.5).otherwise(1.0)
    pooled = S.mean_pool(t.embeddings, ["label"], "embedding", w)
    pooled = pooled.select("label", V.flip_half(F.col("embedding"), F.col("label") % 2 == 1).alias("v"))
    return pooled.select("label", F.posexplode("v").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("analogy", f"SELECT b.vec_id, round({DOT.format('q', 'b.embedding')}, 6) AS score FROM (SELECT list_transform(range(1, 65), lambda i: CAST(x.embedding[i] AS DOUBLE) + y.embedding[i] - z.embedding[i]) AS q FROM embeddings x, embeddings y, embeddings z WHERE x.vec_id = 2 AND y.vec_id = 1 AND z.vec_id = 0), embeddings b ORDER BY {DOT.format('q', 'b.embedding')} DESC, b.vec_id LIMIT 5")
def analogy(t: Tables) -> DataFrame:
    one = lambda i, n: t.embeddings.filter(f"vec_id = {i}").select(F.col("embedding").alias(n))
    q = one(2, "c").join(one(1, "b")).join(one(0, "a")).select(V.add(V.add(F.col("c"), F.col("b")), F.col("a"), -1.0).alias("q"))  # single rows
    scored = stored(t).join(F.broadcast(q), F.lit(True)).select("vec_id", V.dot(F.col("q"), F.col("v")).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(5).select("vec_id", F.round("s", 6).alias("score"))


@query("cluster_separation", f"SELECT label, count(DISTINCT x) AS n, round(avg(c), 6) AS inside FROM (SELECT a.label, a.vec_id AS x, {COS} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) GROUP BY label")
def cluster_separation(t: Tables) -> DataFrame:
    return S.cluster_quality(t.embeddings).filter("n > 1").select("label", "n", F.round("inside", 6).alias("inside"))


@query("relation_accuracy", f"""SELECT kind, count(*) AS n, round(avg(CAST(CASE kind WHEN 'synonym' THEN c >= 0.3 WHEN 'antonym' THEN c < 0.3 ELSE c BETWEEN 0.15 AND 0.8 END AS INT)), 6) AS accuracy FROM (
  SELECT CASE a.vec_id % 3 WHEN 0 THEN 'synonym' WHEN 1 THEN 'antonym' ELSE 'hierarchy' END AS kind, {COS} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY kind""")
def relation_accuracy(t: Tables) -> DataFrame:
    a, b = t.embeddings.toDF("id1", "va", "la"), t.embeddings.toDF("id2", "vb", "lb")
    kind = F.when(F.col("id1") % 3 == 0, "synonym").when(F.col("id1") % 3 == 1, "antonym").otherwise("hierarchy")
    p = a.join(b, F.col("id2") == F.col("id1") + 1).select(kind.alias("kind"), V.cosine(F.col("va"), F.col("vb")).alias("c"))
    right = F.when(F.col("kind") == "synonym", F.col("c") >= 0.3).when(F.col("kind") == "antonym", F.col("c") < 0.3).otherwise(F.col("c").between(0.15, 0.8))
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))


@query("pair_eval", f"""SELECT round(corr(c, y), 6) AS pearson, round(avg(CAST((c >= 0.4) = (y = 1) AS INT)), 6) AS accuracy, round(avg(c) FILTER (WHERE y = 1), 6) AS pos, round(avg(c) FILTER (WHERE y = 0), 6) AS neg FROM (
  SELECT {COS} AS c, CAST(a.label = b.label AS INT) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def pair_eval(t: Tables) -> DataFrame:
    a, b = t.embeddings.toDF("id1", "va", "la"), t.embeddings.toDF("id2", "vb", "lb")
    p = a.join(b, F.col("id2") == F.col("id1") + 1).select(V.cosine(F.col("va"), F.col("vb")).alias("c"), (F.col("la") == F.col("lb")).cast("int").alias("y"))
    mean = lambda y: F.round(F.avg(F.when(F.col("y") == y, F.col("c"))), 6)
    hit = ((F.col("c") >= 0.4) == (F.col("y") == 1)).cast("int")
    return p.agg(F.round(F.corr("c", "y"), 6).alias("pearson"), F.round(F.avg(hit), 6).alias("accuracy"), mean(1).alias("pos"), mean(0).alias("neg"))


@query("random_pairs", f"SELECT count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd FROM (SELECT {COS} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))")
def random_pairs(t: Tables) -> DataFrame:
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    a = t.embeddings.toDF("id1", "va", "la").join(F.broadcast(n), F.lit(True)).withColumn("id2", (F.col("id1") * 7 + 3) % F.col("n"))  # one row
    p = a.join(t.embeddings.toDF("id2", "vb", "lb"), "id2").select(V.cosine(F.col("va"), F.col("vb")).alias("c"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c"), 6).alias("sd"))


@query("collapse_metrics", "SELECT round(avg(sd), 6) AS mean_sd, round(max(sd), 6) AS max_sd FROM (SELECT i, stddev_samp(CAST(embedding[i] AS DOUBLE)) AS sd FROM embeddings, range(1, 65) r(i) GROUP BY i)")
def collapse_metrics(t: Tables) -> DataFrame:
    sd = t.embeddings.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.stddev_samp(F.col("x").cast("double")).alias("sd"))
    return sd.agg(F.round(F.avg("sd"), 6).alias("mean_sd"), F.round(F.max("sd"), 6).alias("max_sd"))


@query("outlier", f"SELECT label, arg_min(id, (s, id)) AS id FROM (SELECT a.label, a.vec_id AS id, round(avg({COS}), 9) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2) GROUP BY label")
def outlier(t: Tables) -> DataFrame:
    """The member least similar to its label: its mean cosine follows from the label's sum of unit vectors."""
    unit = t.embeddings.select("label", "vec_id", V.normalize(F.col("embedding")).alias("u"))
    total = S.mean_pool(unit, ["label"], "u").withColumnRenamed("u", "m")
    n = unit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = unit.join(total, "label").join(n, "label")
    mean = F.round((V.dot(F.col("u"), F.col("m")) * F.col("n") - V.dot(F.col("u"), F.col("u"))) / (F.col("n") - 1), 9)
    return rows.groupBy("label").agg(F.min(F.struct(mean.alias("s"), F.col("vec_id").alias("id"))).alias("b")).select("label", F.col("b.id").alias("id"))


@query("one_hot", "SELECT l_returnflag || l_linestatus AS k, CAST(sum(CAST(l_returnflag = 'A' AS INT)) AS BIGINT) AS a, CAST(sum(CAST(l_returnflag = 'N' AS INT)) AS BIGINT) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS r FROM lineitem GROUP BY 1")
def one_hot(t: Tables) -> DataFrame:
    v = V.one_hot(F.col("l_returnflag"), ["A", "N", "R"])
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("k"), v.alias("v"))
    return rows.groupBy("k").agg(*[F.sum(F.get("v", F.lit(i))).cast("long").alias(c) for i, c in enumerate("anr")])


@query("vocab_lookup", "SELECT o_orderkey, coalesce(c_custkey, -1) AS idx FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def vocab_lookup(t: Tables) -> DataFrame:
    v = t.customer.filter("c_acctbal > 0").select("c_custkey")
    return t.orders.join(v, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_custkey", F.lit(-1)).alias("idx"))


@query("expand_vocab", r"""WITH old AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark), new AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM conversations)
SELECT w, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY w) - 1 AS id FROM new WHERE w NOT IN (SELECT w FROM old)""")
def expand_vocab(t: Tables) -> DataFrame:
    from textloom.operators.corpus import with_rank

    ws = lambda df: df.select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    old = ws(t.benchmark)
    n = old.agg(F.count(F.lit(1)).alias("n"))
    new = with_rank(ws(t.conversations).join(old, "w", "left_anti"), [F.col("w")], "rk")
    return new.join(F.broadcast(n), F.lit(True)).select("w", (F.col("n") + F.col("rk") - 1).alias("id"))  # one row


def hashed_sql(src: str, dim: int) -> str:
    """CTE ``ch`` (w, i from 1, x) of the distinct words w of ``src``."""
    return rf"""hg AS (SELECT w, unnest(list_transform(range(1, greatest(length(w), 1) + 1), lambda i: substr('^' || w || '$', i, 3))) AS g FROM {src}),
hb AS (SELECT w, ('0x' || left(md5(g), 8))::BIGINT % {dim} + 1 AS i, count(*) AS c FROM hg GROUP BY 1, 2), hn AS (SELECT w, sqrt(sum(c * c)) AS norm FROM hb GROUP BY w),
ch AS (SELECT hn.w, r.i, coalesce(c, 0) / norm AS x FROM hn CROSS JOIN range(1, {dim + 1}) r(i) LEFT JOIN hb ON hb.w = hn.w AND hb.i = r.i)"""


def numbered_parts(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, i (from 1), x of each vector."""
    out = rows.select(*keys, F.posexplode(vector).alias("p", "x"))
    return out.select(*keys, (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("char_hash_embed", rf"WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS w FROM benchmark), {hashed_sql('s', 32)} SELECT w, i, round(x, 6) AS x FROM ch")
def char_hash_embed(t: Tables) -> DataFrame:
    ws = t.benchmark.select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return numbered_parts(ws.select("w", V.char_hash(F.col("w"), 32).alias("v")), ["w"], "v")


@query("affix_transform", """WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT vec_id, e, list_sum(list_transform(range(1, 65), lambda i: e[i] * sin(i - 1))) AS a, list_sum(list_transform(range(1, 65), lambda i: e[i] * cos(i - 1))) AS b FROM d)
SELECT vec_id, i, round(e[i] + a * cos(i - 1) / 64 + b * sin(i - 1) / 64, 6) + 0.0 AS x FROM p, range(1, 65) r(i)""")
def affix_transform(t: Tables) -> DataFrame:
    """x + U (D x) with fixed matrices of rank 2."""
    dims = F.sequence(F.lit(0), F.lit(63))
    down = F.array(F.transform(dims, lambda i: F.sin(i)), F.transform(dims, lambda i: F.cos(i)))
    up = F.transform(dims, lambda i: F.array(F.cos(i) / 64, F.sin(i) / 64))
    rows = t.embeddings.select("vec_id", F.posexplode(V.low_rank(F.col("embedding"), down, up)).alias("p", "x"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@query("knn_all", KNN.replace(" WHERE a.vec_id % 50 = 0", ""))
def knn_all(t: Tables) -> DataFrame:
    """All vectors as queries, in blocks."""
    every = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    out = S.knn(every, stored(t), 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


@query("embed_word", rf"""WITH v AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS vec_id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS w FROM conversations)),
kn AS (SELECT w, embedding::DOUBLE[] AS e FROM v JOIN embeddings USING (vec_id)), ws AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{{L}}]+')) AS word FROM benchmark),
a AS (SELECT word, lower(word) AS low, regexp_matches(word, '^\p{{Lu}}') AS name, k.e AS own, m.e AS of_root FROM ws LEFT JOIN kn k ON k.w = lower(word) LEFT JOIN kn m ON m.w = {strip_sql('lower(word)', lx.ROOT_ENDINGS)}),
s AS (SELECT DISTINCT low AS w FROM a), {hashed_sql('s', 64)}
SELECT word, CASE WHEN own IS NOT NULL THEN 'known' WHEN name THEN 'proper_noun' WHEN of_root IS NOT NULL THEN 'morpheme' ELSE 'char_hash' END AS method, i,
  round(coalesce(own[i], CASE WHEN name THEN 0.125 END, of_root[i], x), 6) + 0.0 AS x FROM a JOIN ch ON ch.w = low""")
def embed_word(t: Tables) -> DataFrame:
    """Words of a vocabulary take their stored vector, names a fixed one, words whose root is in it that root's, others a hash of their letters.

    The vocabulary is that of ``conversations``, in order; its first words have the vectors of ``embeddings``.
    """
    from textloom.operators.corpus import with_rank

    ws = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).distinct()
    vocabulary = with_rank(t.conversations.select(F.explode(T.words(F.col("text"))).alias("w")).distinct(), [F.col("w")], "rk")
    known = written(vocabulary.select("w", (F.col("rk") - 1).alias("vec_id")).join(t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "vec_id").drop("vec_id"), "vocabulary")
    rows = ws.withColumns({"low": F.lower("word"), "root": T.strip_ending(F.lower("word"))})
    rows = rows.join(known.toDF("low", "stored"), "low", "left").join(known.toDF("root", "of_root"), "root", "left")
    name = F.col("word").rlike(r"^\p{Lu}")
    kind = F.when(F.col("stored").isNotNull(), "known").when(name, "proper_noun").when(F.col("of_root").isNotNull(), "morpheme").otherwise("char_hash")
    fixed = F.array_repeat(F.lit(0.125), 64)
    vec = F.coalesce("stored", F.when(name, fixed), "of_root", V.char_hash(F.col("low"), 64))
    out = numbered_parts(rows.select("word", kind.alias("method"), vec.alias("v")), ["word", "method"], "v")
    return out.withColumn("x", F.col("x") + 0.0)


SENT_VEC = rf"""sw AS (SELECT item_id, w, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS w FROM benchmark) WHERE length(w) > 3 GROUP BY 1, 2), s AS (SELECT DISTINCT w FROM sw), {hashed_sql('s', 32)},
sm AS (SELECT item_id, i, sum(m * x) / sum(m) AS x FROM sw JOIN ch USING (w) GROUP BY 1, 2), sv AS (SELECT item_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM sm)"""


def sentence_vectors(t: Tables) -> DataFrame:
    """item_id, v: words are hashed once, however many items have them."""
    ws = t.benchmark.select("item_id", F.explode(T.words(F.col("text"))).alias("w")).filter(F.length("w") > 3)
    vectors = ws.select("w").distinct().select("w", V.char_hash(F.col("w"), 32).alias("v"))
    pooled = S.mean_pool(ws.join(vectors, "w"), ["item_id"], "v")
    return pooled.select("item_id", V.normalize(F.col("v")).alias("v"))


@query("embed_sentence", f"WITH {SENT_VEC} SELECT item_id, i, round(x, 6) AS x FROM sv")
def embed_sentence(t: Tables) -> DataFrame:
    return numbered_parts(sentence_vectors(t), ["item_id"], "v")


@query("semantic_search", f"""WITH {SENT_VEC}, d AS (SELECT a.item_id AS query_id, b.item_id AS vec_id, sum(a.x * b.x) AS s FROM sv a JOIN sv b USING (i) GROUP BY 1, 2)
SELECT query_id, rk, vec_id, round(s, 6) AS score, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rk FROM d) JOIN benchmark ON item_id = vec_id WHERE rk <= 5""")
def semantic_search(t: Tables) -> DataFrame:
    """All test items as queries against their own sentence vectors, with the text attached to hits only."""
    v = written(sentence_vectors(t), "sentences")
    out = S.knn(v.toDF("query_id", "qv"), v.toDF("vec_id", "v"), 5, "dot")
    return out.join(t.benchmark.withColumnRenamed("item_id", "vec_id"), "vec_id").select("query_id", F.col("rk").cast("long").alias("rk"), "vec_id", F.round("score", 6).alias("score"), "text")


@query("search_enriched")
def search_enriched(t: Tables) -> DataFrame:
    """Hits of the search with their words analysed: only hits are parsed, each text once."""
    from textloom.operators import syntax
    from textloom.plans.language_queries import roots

    hits = written(semantic_search(t), "hits")
    texts = hits.select(F.col("vec_id").alias("sent_id"), "text").distinct()
    stats = syntax.sentence_types(syntax.with_roles(syntax.parsed(texts, roots(t)))).select(F.col("sent_id").alias("vec_id"), "fraztipo", "total_words", "esperanto_words")
    return hits.drop("text").join(stats, "vec_id", "left")


# ---- questions and answers

#: Sentences of the kinds that questions ask for, one put after each answer.
SAID = [
    "Zamenhof fondis la klubon en 1887.", "La klubo estis fondita de Ludoviko Zamenhof.", "La libro estas nova kaj bona.", "La domo, tio estas granda konstruaĵo.",
    "Ŝi venis la 14-an de majo.", "Ili loĝas en Granda Urbo ĉe Rivero.", "Li vojaĝis per trajno, ĉar forte pluvis.", "Oni lernas uzante librojn kaj 3 000 vortojn.", "La vorto signifas amikon, do pro tio oni uzas ĝin.",
]
CAND = f"""{QUESTIONS}, c AS (SELECT q.conv_id, q.turn, q.q, d.turn AS dturn, d.text || ' ' || ({SAID})[(d.conv_id + d.turn) % 9 + 1] AS doc, 1.0 / (1 + d.turn) AS original FROM questions q JOIN conversations d ON d.conv_id = q.conv_id AND d.role <> 'user')"""


def candidates(t: Tables) -> DataFrame:
    """Each question with the answers of its conversation as retrieved texts."""
    said = F.get(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % 9).cast("int"))
    d = t.conversations.filter("role <> 'user'").select("conv_id", F.col("turn").alias("dturn"), F.concat("text", F.lit(" "), said).alias("doc"))
    return questions(t).join(d, "conv_id").withColumn("original", F.lit(1.0) / (1 + F.col("dturn")))


def case_sql(col: str, i: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(lower(trim({col})), '{r[0]}') THEN {r[i]!r}" for r in lx.QUESTION_WORDS) + f" ELSE {default} END"


STOPS = ", ".join(f"'{w}'" for w in lx.QUESTION_STOP)
ROOTS = f"list_filter(list_transform(list_filter(regexp_extract_all(lower(q), '[a-zĉĝĥĵŝŭ]+'), lambda w: length(w) > 3 AND w NOT IN ({STOPS})), lambda w: {strip_sql('w', lx.ROOT_ENDINGS)}), lambda r: length(r) > 2)"
NUM = r"CASE WHEN regexp_matches(lower(q), '[\p{L}\p{N}_]oj(?:$|[^\p{L}\p{N}_])') THEN 'plural' ELSE 'singular' END"
TENSE = r"CASE WHEN regexp_matches(lower(q), '[\p{L}\p{N}_]is(?:$|[^\p{L}\p{N}_])') THEN 'past' WHEN regexp_matches(lower(q), '[\p{L}\p{N}_]os(?:$|[^\p{L}\p{N}_])') THEN 'future' ELSE 'present' END"


@query("question_analysis", f"WITH {QUESTIONS} SELECT conv_id, turn, {case_sql('q', 1, repr('unknown'))} AS kind, {case_sql('q', 2, repr('aliaj'))} AS role, CAST({case_sql('q', 3, '0.5')} AS DOUBLE) AS weight, {NUM} AS number, {TENSE} AS tense, md5(array_to_string({ROOTS}, ' ')) AS roots FROM questions")
def question_analysis(t: Tables) -> DataFrame:
    q = F.col("q")
    return questions(t).select(
        "conv_id", "turn", Q.question_attribute(q, 1, "unknown").alias("kind"), Q.question_attribute(q, 2, "aliaj").alias("role"),
        Q.question_attribute(q, 3, 0.5).alias("weight"), Q.number_of(q).alias("number"), Q.tense_of(q).alias("tense"), F.md5(F.array_join(Q.key_roots(q), " ")).alias("roots"))


# The signs of each type, by tokens where a pattern has word boundaries; written apart from the patterns of the column functions.
TK = r"regexp_extract_all(lower(doc), '[\p{L}\p{N}_]+')"
_AMONG = lambda *ws: f"least(len(list_filter(tk, lambda w: w IN {ws})), 3)"
_COUNT = lambda pattern: f"least(len(regexp_extract_all(lower(doc), '{pattern}')), 3)"
_LETTER, _EDGE = "[a-zĉĝĥĵŝŭ]", r"(?:^|[^\p{L}\p{N}_])"
_ENDS = lambda e: f"least(len(list_filter(tk, lambda w: ends_with(w, '{e}') AND length(w) > 1)), 3)"
TYPE_SQL = rf"""least(1.0::DOUBLE, CASE kind
  WHEN 'person' THEN 0.3::DOUBLE * {_COUNT(rf"{_LETTER}{{2,}}(?:\s+{_LETTER}{{2,}})?")} + 0.2::DOUBLE * {_AMONG('homo', 'persono', 'viro', 'virino', 'ulo', 'ano')}
  WHEN 'thing' THEN 0.2::DOUBLE * {_COUNT(r"estas\s+[\p{L}\p{N}_]+")} + 0.1::DOUBLE * {_AMONG('afero', 'objekto', 'ilo', 'aĵo')}
  WHEN 'time' THEN 0.4::DOUBLE * least(len(list_filter(tk, lambda w: w BETWEEN '1800' AND '2029' AND regexp_full_match(w, '[0-9]{{4}}'))), 3) + 0.3::DOUBLE * {_COUNT(_EDGE + r"(?:en|dum|post|antaŭ)\s+(?:la\s+)?(?:jar|monat|tag)")}
    + 0.2::DOUBLE * {_AMONG('januaro', 'februaro', 'marto', 'aprilo', 'majo', 'junio', 'julio', 'aŭgusto', 'septembro', 'oktobro', 'novembro', 'decembro')}
  WHEN 'location' THEN 0.3::DOUBLE * {_COUNT(_EDGE + rf"(?:en|ĉe|sur|sub)\s+{_LETTER}{{2,}}")} + 0.1::DOUBLE * {_AMONG('urbo', 'lando', 'loko', 'regiono', 'mondo')}
  WHEN 'manner' THEN 0.2::DOUBLE * {_COUNT(_EDGE + r"(?:per|uzante|kun|laŭ)\s+[\p{L}\p{N}_]+")} + 0.1::DOUBLE * {_ENDS('e')}
  WHEN 'reason' THEN 0.3::DOUBLE * {_AMONG('ĉar', 'pro', 'tial', 'sekve')} + 0.2::DOUBLE * {_AMONG('kaŭzo', 'kialo', 'motivo')}
  WHEN 'quantity' THEN 0.3::DOUBLE * least(len(list_filter(tk, lambda w: regexp_full_match(w, '[0-9]+'))), 3) + 0.2::DOUBLE * {_AMONG('unu', 'du', 'tri', 'kvar', 'kvin', 'ses', 'sep', 'ok', 'naŭ', 'dek', 'cent', 'mil')}
    + 0.1::DOUBLE * {_AMONG('multe', 'malmulte', 'kelkaj', 'ĉiuj')}
  WHEN 'quality' THEN 0.1::DOUBLE * {_ENDS('a')} ELSE 0 END)"""
N = lambda e: f"len(list_filter(tk, lambda w: ends_with(w, '{e}') AND length(w) > {len(e)}))"
GRAMMAR_SQL = f"""least(1.0, CASE WHEN number = 'plural' THEN CASE WHEN {N('oj')} > 0 THEN 0.5 ELSE 0 END ELSE CASE WHEN {N('o')} >= {N('oj')} THEN 0.3 ELSE 0 END END::DOUBLE
  + CASE WHEN tense = 'past' THEN CASE WHEN {N('is')} > 0 THEN 0.5 ELSE 0 END WHEN tense = 'future' THEN CASE WHEN {N('os')} > 0 THEN 0.5 ELSE 0 END ELSE 0.3 END::DOUBLE)"""
COMMON = "CASE r " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.COMMON_ROOT_WEIGHTS.items()) + " ELSE 0.0 END"
DOC_ROOTS = f"list_transform(regexp_extract_all(lower(doc), '[a-zĉĝĥĵŝŭ]+'), lambda w: {strip_sql('w', lx.ROOT_ENDINGS)})"
ENTITY_SQL = f"""CASE WHEN len(roots) = 0 THEN 0.0 ELSE least(1.0, coalesce(list_sum(list_transform(list_filter(roots, lambda r: len(list_filter(droots, lambda d: contains(d, r))) > 0), lambda r: (1.0 - {COMMON})::DOUBLE)), 0) / len(roots)) END"""
ROLE_SQL = r"""CASE role WHEN 'subjekto' THEN least(1.0, CASE WHEN kind = 'person' AND regexp_matches(doc, '^[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lower(doc), '^(la\s+)?[\p{L}]+o\s+(est|far|dir|vid)') THEN 0.3 ELSE 0 END)
  WHEN 'objekto' THEN CASE WHEN regexp_matches(lower(doc), '[\p{L}\p{N}_]n(?:$|[^\p{L}\p{N}_])') THEN 0.4 ELSE 0 END
  WHEN 'aliaj' THEN CASE WHEN regexp_matches(lower(doc), '(?:^|[^\p{L}\p{N}_])(en|sur|sub|ĉe|per|kun|por|al)\s') THEN 0.3 ELSE 0 END ELSE 0 END"""
ANALYSED = f"""{CAND}, an AS (SELECT *, {case_sql('q', 1, repr('unknown'))} AS kind, {case_sql('q', 2, repr('aliaj'))} AS role, {NUM} AS number, {TENSE} AS tense, {ROOTS} AS roots, {DOC_ROOTS} AS droots, {TK} AS tk FROM c),
sc AS (SELECT *, CAST({TYPE_SQL} AS DOUBLE) AS t, CAST({GRAMMAR_SQL} AS DOUBLE) AS g, CAST({ENTITY_SQL} AS DOUBLE) AS e, CAST({ROLE_SQL} AS DOUBLE) AS r FROM an)"""


def scored_candidates(t: Tables) -> DataFrame:
    """Questions are analysed once, before they meet their candidates."""
    q, doc = F.col("q"), F.col("doc")
    rows = candidates(t).withColumns({
        "kind": Q.question_attribute(q, 1, "unknown"), "role": Q.question_attribute(q, 2, "aliaj"), "number": Q.number_of(q), "tense": Q.tense_of(q), "roots": Q.key_roots(q),
        "droots": F.transform(F.regexp_extract_all(F.lower(doc), F.lit(Q.WORD), F.lit(0)), lambda w: T.strip_ending(w))})
    return rows.withColumns({
        "t": Q.score_type(doc, F.col("kind")), "g": Q.score_grammar(doc, F.col("number"), F.col("tense")),
        "e": Q.score_entity(F.col("droots"), F.col("roots")), "r": Q.score_role(doc, F.col("role"), F.col("kind"))})


for _name, _col in (("score_type", "t"), ("score_grammar", "g"), ("score_entity", "e"), ("score_role", "r")):
    query(_name, f"WITH {ANALYSED} SELECT conv_id, turn, dturn, round({_col}, 6) AS score FROM sc")(
        lambda t, c=_col: scored_candidates(t).select("conv_id", "turn", "dturn", F.round(c, 6).alias("score")))


@query("rerank", f"""WITH {ANALYSED}, f AS (SELECT *, round(0.6 * (0.3 * t + 0.2 * g + 0.3 * e + 0.2 * r) + 0.4 * original, 6) AS score FROM sc)
SELECT conv_id, turn, dturn, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, dturn) AS rk FROM f) WHERE rk <= 3""")
def rerank(t: Tables) -> DataFrame:
    rows = scored_candidates(t)
    score = F.round(Q.combined(F.col("t"), F.col("g"), F.col("e"), F.col("r"), F.col("original")), 6)
    rk = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "dturn"))
    return rows.withColumn("score", score).withColumn("rk", rk).filter("rk <= 3").select("conv_id", "turn", "dturn", "score", F.col("rk").cast("long").alias("rk"))


TERMS = r"""list_filter(list_filter(regexp_extract_all(lower(q), '[a-zĉĝĥĵŝŭ]+'), lambda w: length(w) > 2 AND w NOT IN ('la', 'de', 'en', 'kaj', 'al', 'por', 'kun', 'ĉu', 'estas')),
  lambda w, i: NOT (w IN ('kiu', 'kio', 'kiel', 'kiam', 'kie', 'kial', 'kiom', 'kia') AND i = list_position(list_filter(regexp_extract_all(lower(q), '[a-zĉĝĥĵŝŭ]+'), lambda v: length(v) > 2 AND v NOT IN ('la', 'de', 'en', 'kaj', 'al', 'por', 'kun', 'ĉu', 'estas')), w)))"""
SENT = rf"""{CAND}, st AS (SELECT conv_id, turn, dturn, kind, terms, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS s FROM (
  SELECT conv_id, turn, dturn, {case_sql('q', 1, repr('unknown'))} AS kind, {TERMS} AS terms, list_filter(list_transform(string_split(regexp_replace(doc, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM c))"""
HELD = "len(list_filter(terms, lambda x: contains(lower(s), x)))"


def candidate_sentences(t: Tables) -> DataFrame:
    q = F.col("q")
    rows = candidates(t).select("conv_id", "turn", "dturn", Q.question_attribute(q, 1, "unknown").alias("kind"), Q.key_terms(q).alias("terms"), F.posexplode(T.sentences(F.col("doc"))).alias("p", "s"))
    return rows.withColumn("pos", (F.col("p") + 1).cast("long")).drop("p")


# Kind, pattern, group and confidence in the order of trial, written apart from the patterns of the column functions.
_W, _NAME = r"[\p{L}\p{N}_]+", "[a-zĉĝĥĵŝŭ]{2,}"
_TRIALS = [
    ("thing", rf"{_W}\s+estas\s+(.+?)\.", 1, 0.8), ("thing", r",\s*tio\s+estas\s+(.+?)\.", 1, 0.7), ("thing", rf"{_W}\s+signifas\s+(.+?)\.", 1, 0.7), ("thing", rf"{_W}\s+nomiĝas\s+(.+?)\.", 1, 0.7),
    ("person", rf"({_W}(?:\s+{_W})?)\s+fondis\s", 1, 0.9), ("person", rf"({_W}(?:\s+{_W})?)\s+kreis\s", 1, 0.9), ("person", rf"estis\s+(?:fondita|kreita)\s+de\s+({_W}(?:\s+{_W})?)", 1, 0.8), ("person", rf"^de\s+({_W}(?:\s+{_W})?)", 1, 0.6),
    ("time", r"en\s+(?:la\s+jaro\s+)?([0-9]{4})", 1, 0.9), ("time", rf"la\s+[0-9]{{1,2}}[—-]?an?\s+de\s+{_W}", 0, 0.8), ("time", r"(?:^|[^\p{L}\p{N}_])(1[89][0-9]{2}|20[0-2][0-9])(?:$|[^\p{L}\p{N}_])", 1, 0.5),
    ("location", rf"en\s+({_NAME}(?:\s+{_NAME})?)", 1, 0.8), ("location", rf"ĉe\s+({_NAME})", 1, 0.7),
    ("quantity", r"([0-9]+(?:\s*[0-9]+)*)", 1, 0.7), ("quantity", "unu|du|tri|kvar|kvin|ses|sep|ok|naŭ|dek|cent|mil", 0, 0.6),
    ("manner", r"per\s+(.+?)(?:\.|,|$)", 1, 0.7), ("manner", r"uzante?\s+(.+?)(?:\.|,|$)", 1, 0.7), ("reason", r"ĉar\s+(.+?)(?:\.|$)", 1, 0.8), ("reason", r"pro\s+(.+?)(?:\.|,|$)", 1, 0.7),
]
PATTERN_SQL = "CASE " + " ".join(
    f"WHEN kind = '{k}' AND regexp_matches(s, '(?i){p}') THEN struct_pack(answer := trim(regexp_extract(s, '(?i){p}', {g})), confidence := round(least(1.0::DOUBLE, {c}::DOUBLE + 0.1::DOUBLE * {HELD}), 6))" for k, p, g, c in _TRIALS) + " END"


@query("extract_pattern", f"WITH {SENT} SELECT conv_id, turn, dturn, pos, a.answer AS answer, a.confidence AS confidence FROM (SELECT *, {PATTERN_SQL} AS a FROM st) WHERE a IS NOT NULL")
def extract_pattern(t: Tables) -> DataFrame:
    rows = candidate_sentences(t).withColumn("a", Q.pattern_answer(F.col("s"), F.col("kind"), F.col("terms"))).filter("a is not null")
    return rows.select("conv_id", "turn", "dturn", "pos", "a.answer", "a.confidence")


SCORE_SQL = rf"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.2::DOUBLE * {HELD} + CASE WHEN kind = 'thing' AND contains(lower(s), 'estas') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN kind = 'time' AND regexp_matches(s, '[0-9]{{4}}') THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN kind = 'person' THEN 0.1::DOUBLE * len(regexp_extract_all(s, '[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+')) ELSE 0 END - CASE WHEN len(regexp_extract_all(s, '\S+')) < 5 THEN 0.1 ELSE 0 END::DOUBLE
  - """ + " - ".join(f"CASE WHEN contains(lower(s), '{p}') THEN 0.3 ELSE 0 END::DOUBLE" for p in lx.NEGATIVE_PHRASES) + "))"


@query("sentence_score", f"WITH {SENT} SELECT conv_id, turn, dturn, pos, round({SCORE_SQL}, 6) AS score FROM st")
def sentence_score(t: Tables) -> DataFrame:
    return candidate_sentences(t).select("conv_id", "turn", "dturn", "pos", F.round(Q.sentence_score(F.col("s"), F.col("kind"), F.col("terms")), 6).alias("score"))


@query("extract_answer", rf"""WITH {SENT}, x AS (SELECT *, {PATTERN_SQL} AS a, round({SCORE_SQL}, 6) AS sc FROM st),
y AS (SELECT conv_id, turn, arg_min(a.answer, (dturn, pos)) FILTER (WHERE a.confidence >= 0.6) AS pa, arg_min(a.confidence, (dturn, pos)) FILTER (WHERE a.confidence >= 0.6) AS pc,
  arg_max(s, (sc, -dturn, -pos)) AS bs, max(sc) AS bsc, arg_min(s, (dturn, pos)) AS fs FROM x GROUP BY 1, 2),
z AS (SELECT qu.conv_id, qu.turn, regexp_matches(lower(q), 'marso|luno|kostas') AS never, {TERMS} AS terms, pa, pc, bs, bsc, fs FROM questions qu LEFT JOIN y ON y.conv_id = qu.conv_id AND y.turn = qu.turn),
w AS (SELECT *, CASE WHEN never THEN 'negative_detection' WHEN pa IS NOT NULL THEN 'pattern' WHEN bsc > 0.2 THEN 'sentence' ELSE 'fallback' END AS method,
  coalesce(trim(list_filter(regexp_split_to_array(bs, '[,;:]'), lambda c: len(list_filter(terms, lambda t: contains(lower(c), t))) > 0)[1]), bs) AS clause FROM z)
SELECT conv_id, turn, method, CASE WHEN never OR fs IS NULL THEN 'Mi ne scias.' WHEN method = 'pattern' THEN CASE WHEN length(pa) > 150 THEN left(pa, 150) || '...' ELSE pa END
  WHEN method = 'sentence' THEN CASE WHEN length(bs) <= 150 THEN bs WHEN length(clause) > 150 THEN left(clause, 150) || '...' ELSE clause END ELSE left(fs, 150) END AS answer,
  round(CASE WHEN never THEN 0.7 WHEN fs IS NULL THEN 0.0 WHEN method = 'pattern' THEN pc WHEN method = 'sentence' THEN bsc * 0.6::DOUBLE ELSE 0.1 END, 6) AS confidence FROM w""")
def extract_answer(t: Tables) -> DataFrame:
    """No answer to what no text tells; else the first confident pattern in document order, the best sentence, or the first one: one aggregation."""
    s = F.col("s")
    rows = candidate_sentences(t).withColumns({"a": Q.pattern_answer(s, F.col("kind"), F.col("terms")), "sc": F.round(Q.sentence_score(s, F.col("kind"), F.col("terms")), 6)})
    sure = F.when(F.col("a.confidence") >= 0.6, F.struct("dturn", "pos", "a.answer", "a.confidence"))
    g = rows.groupBy("conv_id", "turn").agg(
        F.min(sure).alias("p"), F.max(F.struct("sc", (-F.col("dturn")).alias("x"), (-F.col("pos")).alias("y"), "s")).alias("b"), F.min(F.struct("dturn", "pos", "s")).alias("f"))
    g = questions(t).select("conv_id", "turn", Q.unanswerable(F.col("q")).alias("never"), Q.key_terms(F.col("q")).alias("terms")).join(g, ["conv_id", "turn"], "left")
    no, none, pat, best = F.col("never"), F.col("f").isNull(), F.col("p").isNotNull(), F.coalesce(F.col("b.sc") > 0.2, F.lit(False))
    pick = lambda a, b, c, d, e: F.when(no, a).when(none, b).when(pat, c).when(best, d).otherwise(e)
    method = pick(F.lit("negative_detection"), F.lit("fallback"), F.lit("pattern"), F.lit("sentence"), F.lit("fallback"))
    answer = pick(F.lit(Q.UNKNOWN), F.lit(Q.UNKNOWN), Q.shortened(F.col("p.answer")), Q.shortened_sentence(F.col("b.s"), F.col("terms")), F.left(F.col("f.s"), F.lit(150)))
    confidence = pick(F.lit(0.7), F.lit(0.0), F.col("p.confidence"), F.col("b.sc") * 0.6, F.lit(0.1))
    return g.select("conv_id", "turn", method.alias("method"), answer.alias("answer"), F.round(confidence, 6).alias("confidence"))


@query("hybrid_retrieve", rf"""WITH n AS (SELECT count(*) AS n FROM embeddings),
t AS (SELECT doc_id AS text_id, regexp_extract_all(lower(text), '[a-zĉĝĥĵŝŭ]+') AS ws, embedding FROM documents, n, embeddings WHERE vec_id = doc_id % n),
qs AS (SELECT item_id AS query_id, text AS q, embedding FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'Kiu estas xyzabc123?'), n, embeddings WHERE vec_id = (item_id + n) % n),
kw AS (SELECT query_id, embedding, list_distinct(list_concat(list_filter({ROOTS}, lambda r: r NOT IN ('est', 'hav', 'far')), list_filter(list_transform(regexp_extract_all(q, '[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ({STOPS})))) AS keywords FROM qs),
el AS (SELECT DISTINCT text_id, unnest(list_distinct(list_concat(ws, list_transform(ws, lambda w: {strip_sql('w', lx.ROOT_ENDINGS)})))) AS el FROM t),
met AS (SELECT DISTINCT query_id, text_id FROM (SELECT query_id, unnest(keywords) AS el FROM kw) k JOIN el USING (el)),
tot AS (SELECT query_id, count(*) AS total FROM met GROUP BY 1),
pool AS (SELECT query_id, text_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_id) AS i FROM met) WHERE i <= 100
  UNION ALL SELECT query_id, text_id FROM kw, t WHERE query_id NOT IN (SELECT query_id FROM tot)),
s AS (SELECT p.query_id, p.text_id, {COS} AS score FROM pool p JOIN kw a ON a.query_id = p.query_id JOIN t b ON b.text_id = p.text_id)
SELECT s.query_id, rk, text_id, round(score, 6) AS score, len(keywords) AS n_keywords, coalesce(total, 0) AS total_candidates, least(coalesce(total, 0), 100) AS candidates_reranked, CASE WHEN total IS NULL THEN 'semantic' ELSE 'hybrid' END AS mode
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text_id) AS rk FROM s) s JOIN kw USING (query_id) LEFT JOIN tot USING (query_id) WHERE rk <= 5""")
def hybrid_retrieve(t: Tables) -> DataFrame:
    """Two stages: keywords by an inverted index, then cosine; a query that no text answers to is searched among all."""
    n = F.broadcast(t.embeddings.agg(F.count(F.lit(1)).alias("n")))  # one row
    vector = t.embeddings.select("vec_id", "embedding")
    items = t.benchmark.select("item_id", "text").unionByName(t.region.limit(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit("Kiu estas xyzabc123?").alias("text")))
    q = items.join(n, F.lit(True)).withColumn("vec_id", (F.col("item_id") + F.col("n")) % F.col("n")).join(vector, "vec_id")
    names = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+"), F.lit(0)), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*lx.QUESTION_STOP))
    common = [r for r, w in lx.COMMON_ROOT_WEIGHTS.items() if w <= 0.2]
    roots = F.filter(Q.key_roots(F.col("text")), lambda r: ~r.isin(*common))
    ws = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(Q.WORD), F.lit(0)))
    texts = t.documents.join(n, F.lit(True)).withColumn("vec_id", F.col("doc_id") % F.col("n")).join(vector, "vec_id")
    out = S.two_stage(
        q.select(F.col("item_id").alias("query_id"), F.array_distinct(F.concat(roots, names)).alias("keywords"), F.col("embedding").alias("qv")),
        texts.select(F.col("doc_id").alias("text_id"), F.concat(ws, F.transform(ws, lambda w: T.strip_ending(w))).alias("elements"), F.col("embedding").alias("v")), 5)
    return out.withColumn("score", F.round("score", 6))


_LC = lambda c: "[" + ", ".join(f"(length(lower({c})) - length(replace(lower({c}), '{x}', '')))::DOUBLE" for x in "abcdefghijklmnopqrstuvwxyzĉĝĥĵŝŭ") + "]"


@query("enhanced_retrieve", f"""WITH {EXPANDED}, tx AS (SELECT item_id, text, {_LC('text')} AS embedding FROM benchmark), vv AS (SELECT conv_id, turn, x, row_number() OVER () AS v, {_LC('variant')} AS embedding FROM vr),
sc AS (SELECT conv_id, turn, x, v, item_id, text, CASE WHEN {NORM.format('a.embedding')} * {NORM.format('b.embedding')} > 0 THEN {COS} ELSE 0 END AS s FROM vv a, tx b),
hit AS (SELECT conv_id, turn, item_id, s * CASE WHEN contains(lower(text), lower(x)) THEN 1.2::DOUBLE ELSE 1.0 END AS s FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY s DESC, item_id) AS i FROM sc) WHERE i <= 10),
best AS (SELECT conv_id, turn, item_id, max(s) AS s FROM hit GROUP BY 1, 2, 3)
SELECT conv_id, turn, item_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, item_id) AS rk FROM best) WHERE rk <= 5""")
def enhanced_retrieve(t: Tables) -> DataFrame:
    """Query expansion, search with every variant, boost of the entity, best score for each text."""
    q = questions(t).select(F.struct("conv_id", "turn").alias("query_id"), "q")
    out = S.expanded_search(q, t.benchmark.select(F.col("item_id").alias("text_id"), "text"), V.letter_counts, 5)
    return out.select("query_id.conv_id", "query_id.turn", F.col("text_id").alias("item_id"), F.round("score", 6).alias("score"))


@query("qa_pipeline", f"""WITH {ANALYSED}, f AS (SELECT *, round(0.6 * (0.3 * t + 0.2 * g + 0.3 * e + 0.2 * r) + 0.4 * original, 6) AS score FROM sc)
SELECT kind, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, dturn) AS rk FROM f) WHERE rk = 1 GROUP BY kind""")
def qa_pipeline(t: Tables) -> DataFrame:
    rows = scored_candidates(t)
    score = F.round(Q.combined(F.col("t"), F.col("g"), F.col("e"), F.col("r"), F.col("original")), 6)
    rk = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "dturn"))
    return rows.withColumn("score", score).withColumn("rk", rk).filter("rk = 1").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("baseline_answer", "SELECT conv_id, 'Mi ne scias.' AS answer FROM conversations GROUP BY conv_id")
def baseline_answer(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id").distinct().withColumn("answer", F.lit("Mi ne scias."))


@query("extractive_answer", "SELECT q.conv_id, coalesce(arg_min(d.text, d.turn), 'not found') AS answer, count(d.turn) AS n_sources FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN (SELECT * FROM conversations WHERE role <> 'user') d ON d.conv_id = q.conv_id GROUP BY 1")
def extractive_answer(t: Tables) -> DataFrame:
    said = F.col("role") != "user"
    first = F.min(F.when(said, F.struct("turn", "text")))["text"]
    return t.conversations.groupBy("conv_id").agg(F.coalesce(first, F.lit("not found")).alias("answer"), F.count_if(said).alias("n_sources"))


INTENTS = [("question", r"^(kiu|kio|kie|kiam|what|who)"), ("math", r"[0-9]+\s*[-+*/]\s*[0-9]+"), ("numbers", "[0-9]"), ("temporal", "(hodiaŭ|hieraŭ|today|when)"), ("summary", "(resum|summar)"), ("grammar", "(gramatik|verb)"), ("command", "^(go|do|fari|iru)")]


@query("intent", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in INTENTS) + " ELSE 'statement' END AS intent FROM conversations")
def intent(t: Tables) -> DataFrame:
    case, low = None, F.lower("text")
    for k, p in INTENTS:
        case = F.when(low.rlike(p), k) if case is None else case.when(low.rlike(p), k)
    return t.conversations.select("conv_id", "turn", case.otherwise("statement").alias("intent"))


@query("dispatch", "SELECT event_id, coalesce(x, 'default') AS expert FROM events LEFT JOIN (VALUES ('click', 'web'), ('purchase', 'sales'), ('login', 'account')) v(k, x) ON event_type = k")
def dispatch(t: Tables) -> DataFrame:
    table = F.create_map(*map(F.lit, ["click", "web", "purchase", "sales", "login", "account"]))
    return t.events.select("event_id", F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("default")).alias("expert"))


@query("simple_statement", "SELECT doc_id, quality IS NOT NULL AND toxic IS NOT NULL AS complete FROM documents LEFT JOIN labels USING (doc_id)")
def simple_statement(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", (F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("complete"))


@query("decompose", "SELECT conv_id, turn, unnest(range(1, len(ps) + 1)) AS step, unnest(ps) AS part FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' and '), lambda x: trim(x)), lambda x: x <> '') AS ps FROM conversations)")
def decompose(t: Tables) -> DataFrame:
    ps = F.filter(F.transform(F.split("text", " and "), lambda x: F.trim(x)), lambda x: x != "")
    return t.conversations.select("conv_id", "turn", F.posexplode(ps).alias("p", "part")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("step"), "part")


@query("keyword_relevance", r"""WITH g AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}]+')) AS g FROM benchmark), q AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}]+')) AS q FROM conversations)
SELECT conv_id, turn, item_id, round(len(list_intersect(q, g)) / len(g), 6) AS relevance FROM q, g WHERE len(list_intersect(q, g)) / len(g) > 0.3""")
def keyword_relevance(t: Tables) -> DataFrame:
    """Goals meet queries by shared words only, which loses nothing above a relevance of 0."""
    g = t.benchmark.select("item_id", F.array_distinct(T.words(F.col("text"))).alias("g"))
    q = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    met = q.join(g.select("item_id", F.size("g").alias("n"), F.explode("g").alias("w")), "w").groupBy("conv_id", "turn", "item_id", "n").agg(F.count(F.lit(1)).alias("c"))
    return met.filter("c / n > 0.3").select("conv_id", "turn", "item_id", F.round(F.col("c") / F.col("n"), 6).alias("relevance"))


@query("value_selection", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part) WHERE rk <= 2")
def value_selection(t: Tables) -> DataFrame:
    rk = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.withColumn("rk", rk).filter("rk <= 2").select("p_brand", "p_partkey")


@query("value_conflicts", "SELECT a.p_partkey AS k1, b.p_partkey AS k2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 10")
def value_conflicts(t: Tables) -> DataFrame:
    """Parts meet by ranges of price a little wider than 10, so partners are in one range or the next."""
    price = F.col("p_retailprice")
    rows = t.part.select("p_brand", "p_size", "p_partkey", price, F.floor(price / 10.001).alias("at"))
    near = F.explode(F.array(F.try_subtract("at", F.lit(1)), F.col("at"), F.try_add("at", F.lit(1))))
    a = rows.select("p_brand", "p_size", "at", F.col("p_partkey").alias("k1"), price.alias("x"))
    b = rows.select("p_brand", "p_size", near.alias("at"), F.col("p_partkey").alias("k2"), price.alias("y"))
    keys, n = ["p_brand", "p_size", "at"], parts_of(rows)
    # Pairs are many where rows are few, so partitions are not merged by size.
    return a.repartition(n, *keys).join(b.repartition(n, *keys).hint("merge"), keys).filter("k1 < k2 and abs(x - y) < 10").select("k1", "k2")


# ---- metrics

_PAIR = r"""p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(a.text), '[\p{L}]+')) AS x, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}]+')) AS y, lower(a.text) AS ta, lower(b.text) AS tb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def turn_pairs(t: Tables) -> DataFrame:
    low = F.lower("text")
    c = t.conversations.select("conv_id", "turn", F.array_distinct(T.words(F.col("text"))).alias("x"), low.alias("ta"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("y", F.lead("x").over(w)).withColumn("tb", F.lead("ta").over(w)).filter("tb is not null")


F1 = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(list_intersect(x, y)) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END"


@query("token_f1", f"WITH {_PAIR} SELECT conv_id, turn, round(CAST({F1} AS DOUBLE), 6) AS f1 FROM p")
def token_f1(t: Tables) -> DataFrame:
    return turn_pairs(t).select("conv_id", "turn", F.round(Q.token_f1(F.col("x"), F.col("y")), 6).alias("f1"))


@query("match_flags", f"WITH {_PAIR} SELECT conv_id, turn, ta = tb AS exact, contains(tb, left(ta, 5)) AS partial, len(list_intersect(x, y)) > 5 AS hit FROM p")
def match_flags(t: Tables) -> DataFrame:
    return turn_pairs(t).select("conv_id", "turn", (F.col("ta") == F.col("tb")).alias("exact"), F.contains("tb", F.left("ta", F.lit(5))).alias("partial"), (F.size(F.array_intersect("x", "y")) > 5).alias("hit"))


@query("prf", f"WITH {_PAIR} SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(x), 6) AS precision, round(len(list_intersect(x, y)) / len(y), 6) AS recall FROM p WHERE len(x) > 0 AND len(y) > 0")
def prf(t: Tables) -> DataFrame:
    both = F.size(F.array_intersect("x", "y"))
    return turn_pairs(t).filter("size(x) > 0 and size(y) > 0").select("conv_id", "turn", F.round(both / F.size("x"), 6).alias("precision"), F.round(both / F.size("y"), 6).alias("recall"))


@query("qa_metrics", f"""WITH {_PAIR} SELECT CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(*) AS n, round(avg(CAST({F1} AS DOUBLE)), 6) AS f1 FROM p GROUP BY GROUPING SETS ((CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END), ())""")
def qa_metrics(t: Tables) -> DataFrame:
    rows = turn_pairs(t).select(F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("category"), Q.token_f1(F.col("x"), F.col("y")).alias("v"))
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("f1"))


@query("precision_recall_mrr", f"""WITH k AS ({KNN}), r AS (SELECT k.query_id, rk, CAST(b.label = a.label AS INT) AS rel FROM k JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = k.vec_id WHERE k.vec_id <> query_id)
SELECT query_id, round(sum(rel) / 10, 6) AS p_at_10, round(sum(rel) / least(21, 10), 6) AS r_at_10, round(coalesce(1.0 / min(rk) FILTER (WHERE rel = 1), 0), 6) AS rr FROM r GROUP BY query_id""")
def precision_recall_mrr(t: Tables) -> DataFrame:
    k = S.knn(asked(t), stored(t), 10).filter("vec_id <> query_id")
    lab = t.embeddings.select("vec_id", "label")
    r = k.join(lab.toDF("query_id", "ql"), "query_id").join(lab, "vec_id").withColumn("rel", (F.col("label") == F.col("ql")).cast("int"))
    rr = F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rk"))), F.lit(0.0))
    return r.groupBy("query_id").agg(F.round(F.sum("rel") / 10, 6).alias("p_at_10"), F.round(F.sum("rel") / 10, 6).alias("r_at_10"), F.round(rr, 6).alias("rr"))


@query("diversity", "SELECT conv_id, round(count(DISTINCT split_part(text, ' ', 1)) / count(*), 6) AS diversity, min(length(text)) AS lo, max(length(text)) AS hi FROM conversations GROUP BY conv_id")
def diversity(t: Tables) -> DataFrame:
    n = F.length("text").cast("long")
    return t.conversations.groupBy("conv_id").agg(F.round(F.countDistinct(F.substring_index("text", " ", 1)) / F.count(F.lit(1)), 6).alias("diversity"), F.min(n).alias("lo"), F.max(n).alias("hi"))


@query("compare_models", "SELECT coalesce(a.label, b.label) AS label, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1) a FULL OUTER JOIN (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1) b ON a.label = b.label")
def compare_models(t: Tables) -> DataFrame:
    n = F.when(F.col("vec_id") % 2 == 1, 1).otherwise(-1)
    return t.embeddings.groupBy("label").agg(F.sum(n).alias("delta"))


# ---- registry, memory, structure


@query("select_by_key", "SELECT event_id, user_id, event_type FROM events WHERE event_id = 17")
def select_by_key(t: Tables) -> DataFrame:
    return t.events.filter("event_id = 17").select("event_id", "user_id", "event_type")


@query("memory_search", "SELECT event_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY ts DESC, event_id LIMIT 30")
def memory_search(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase' and ts >= timestamp '2024-01-05 00:00:00'").orderBy(F.desc("ts"), "event_id").limit(30).select("event_id")


@query("memory_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def memory_count(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("insert_ids", "SELECT event_id, 'LTM-' || lpad(CAST(row_number() OVER (ORDER BY ts, event_id) AS VARCHAR), 6, '0') AS entry_id FROM events")
def insert_ids(t: Tables) -> DataFrame:
    from textloom.operators.corpus import with_rank

    rows = with_rank(t.events.select("event_id", "ts"), [F.col("ts"), F.col("event_id")], "n")
    return rows.select("event_id", F.concat(F.lit("LTM-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("entry_id"))


@query("consolidate", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def consolidate(t: Tables) -> DataFrame:
    new = t.events.filter("event_type = 'click'").select("user_id").distinct()
    return new.join(t.events.filter("event_type = 'signup'").select("user_id").distinct(), "user_id", "left_anti")


@query("registry_stats", "SELECT source, count(*) AS texts, count(*) FILTER (WHERE quality = 1) AS valid, CAST(coalesce(sum(n_chars) FILTER (WHERE toxic = 1), 0) AS BIGINT) AS toxic_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def registry_stats(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("quality") == 1).alias("valid"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n_chars"))), F.lit(0)).alias("toxic_chars"))


@query("verify_chunks", "SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, count(*) FILTER (WHERE doc_id IS NULL) AS no_id FROM documents GROUP BY source")
def verify_chunks(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_if(F.col("doc_id").isNull()).alias("no_id"))


@query("graph_union", "SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer) AS node, 'supplier' AS part FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer")
def graph_union(t: Tables) -> DataFrame:
    off = t.customer.agg((F.max("c_custkey") + 1).alias("off"))
    b = t.supplier.join(F.broadcast(off), F.lit(True)).select((F.col("s_suppkey") + F.col("off")).alias("node"), F.lit("supplier").alias("part"))  # one row
    return b.union(t.customer.select(F.col("c_custkey").alias("node"), F.lit("customer").alias("part")))


@query("assign_ids", "SELECT p_type, dense_rank() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)")
def assign_ids(t: Tables) -> DataFrame:
    from textloom.operators.corpus import with_rank

    return with_rank(t.part.select("p_type").distinct(), [F.col("p_type")], "id").select("p_type", "id")


@query("freq_tier", r"SELECT w, CASE WHEN n >= 10 THEN 'very_common' WHEN n >= 5 THEN 'common' ELSE 'rare' END AS tier FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark) GROUP BY w)")
def freq_tier(t: Tables) -> DataFrame:
    n = t.benchmark.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return n.select("w", F.when(F.col("n") >= 10, "very_common").when(F.col("n") >= 5, "common").otherwise("rare").alias("tier"))


@query("slot_overlap", r"""WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}]+')) AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS w FROM a),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]+'))) AS w FROM benchmark)
SELECT item_id, doc_id, shared FROM (SELECT item_id, doc_id, count(*) AS shared, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rk FROM q JOIN e USING (w) GROUP BY 1, 2) WHERE rk <= 5""")
def slot_overlap(t: Tables) -> DataFrame:
    slots = lambda df, c: df.select(c, F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    m = slots(t.benchmark, "item_id").join(slots(t.documents, "doc_id"), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    rk = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return m.withColumn("rk", rk).filter("rk <= 5").drop("rk")


@query("embedding_quality", r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark)
SELECT conv_id, turn, count(v.w) AS known, count(*) - count(v.w) AS unknown, round(count(v.w) / count(*), 6) AS quality FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM conversations) c LEFT JOIN v ON c.w = v.w GROUP BY 1, 2""")
def embedding_quality(t: Tables) -> DataFrame:
    v = t.benchmark.select(F.explode(T.words(F.col("text"))).alias("w")).distinct().withColumn("hit", F.lit(1))
    c = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    g = c.join(v, "w", "left").groupBy("conv_id", "turn").agg(F.count("hit").alias("known"), F.count(F.lit(1)).alias("all"))
    return g.select("conv_id", "turn", "known", (F.col("all") - F.col("known")).alias("unknown"), F.round(F.col("known") / F.col("all"), 6).alias("quality"))


@query("compare_pair", f"WITH {_PAIR} SELECT conv_id, turn, len(list_intersect(x, y)) AS shared, len(x) - len(list_intersect(x, y)) AS only_first, len(y) - len(list_intersect(x, y)) AS only_second FROM p")
def compare_pair(t: Tables) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return turn_pairs(t).select("conv_id", "turn", n(F.array_intersect("x", "y")).alias("shared"), n(F.array_except("x", "y")).alias("only_first"), n(F.array_except("y", "x")).alias("only_second"))

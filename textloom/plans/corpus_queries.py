"""Queries that build corpora and vocabularies: tiers, merging, joins, counts, windows, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx
from textloom.functions import text as T
from textloom.operators import corpus as C
from textloom.plans.registry import Tables, query
from textloom.plans.text_queries import DISTINCT_WORDS, PARSE_RATE, WORDS, distinct_words, parse_rates, strip_sql, word_rows

TIER_SQL = "CASE WHEN source IS NULL THEN 6 ELSE CAST(substr(source, 4) AS INT) % 7 + 1 END"


def tier_of(source: Column) -> Column:
    """Tier 1 .. 7 of the fixture sources src0 .. src19."""
    return F.when(source.isNull(), 6).otherwise(F.substring(source, 4, 9).cast("int") % 7 + 1)


WEIGHT_MERGE = "CASE tier " + " ".join(f"WHEN {t} THEN {w[0]}" for t, w in lx.TIER_WEIGHTS.items()) + " END"
WEIGHT_TRAIN = "CASE tier " + " ".join(f"WHEN {t} THEN {w[1]}" for t, w in lx.TIER_WEIGHTS.items()) + " END"


def weight_of(tier: Column, which: int) -> Column:
    case = None
    for t, w in lx.TIER_WEIGHTS.items():
        case = F.when(tier == t, w[which]) if case is None else case.when(tier == t, w[which])
    return case


TIERS = f"tiers AS (SELECT source, {TIER_SQL} AS tier FROM documents WHERE source <> 'src19' GROUP BY source)"


def tier_table(t: Tables) -> DataFrame:
    return t.documents.filter("source <> 'src19'").select("source").distinct().withColumn("tier", tier_of(F.col("source")))


@query("join_left_default", f"WITH {TIERS} SELECT doc_id, coalesce(tier, 6) AS tier FROM documents LEFT JOIN tiers USING (source)")
def join_left_default(t: Tables) -> DataFrame:
    return t.documents.join(tier_table(t), "source", "left").select("doc_id", F.coalesce("tier", F.lit(6)).alias("tier"))


@query("annotate_tier", f"""WITH {TIERS} SELECT doc_id, coalesce(tier, 6) AS tier, coalesce(tier, 6) <= 5 AS verified,
  CASE WHEN doc_id % 2 = 0 THEN source || ':p' || doc_id ELSE source || ':L' || (doc_id + 1) END AS citation FROM documents LEFT JOIN tiers USING (source)""")
def annotate_tier(t: Tables) -> DataFrame:
    rows = C.annotate(t.documents, tier_table(t), paragraph=F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), line=F.col("doc_id") + 1)
    return rows.select("doc_id", "tier", "verified", "citation")


@query("route_by_tier", f"""SELECT CASE WHEN tier IN (1, 2, 3) THEN 'authoritative' WHEN tier = 5 THEN 'literature' ELSE 'general' END AS category,
  count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT *, {TIER_SQL} AS tier FROM documents) GROUP BY 1""")
def route_by_tier(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("category", C.category(tier_of(F.col("source"))))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("split_ok_failed", f"WITH {PARSE_RATE} SELECT CASE WHEN known / total >= 0.3 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM rates GROUP BY 1")
def split_ok_failed(t: Tables) -> DataFrame:
    status = F.when(F.col("known") / F.col("total") >= 0.3, "ok").otherwise("failed")
    return parse_rates(t).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_metadata", "SELECT count(*) AS entries, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents")
def corpus_metadata(t: Tables) -> DataFrame:
    return t.documents.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("merge_corpora", f"""WITH {PARSE_RATE}, u AS (
  SELECT 0 AS phase, item_id AS id, text, 'benchmark' AS source, 1.0 AS rate FROM benchmark UNION ALL
  SELECT 1, doc_id, text, source, coalesce(known / total, 1.0) FROM documents LEFT JOIN rates USING (doc_id))
SELECT phase, id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY phase, id) AS rn FROM u) WHERE rn = 1 AND rate >= 0.1""")
def merge_corpora(t: Tables) -> DataFrame:
    rates = parse_rates(t).select("doc_id", (F.col("known") / F.col("total")).alias("rate"))
    general = t.documents.join(rates, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "source", "rate")
    first = t.benchmark.select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("source"))
    return C.merge([first, general], "text", ["id"], F.coalesce("rate", F.lit(1.0)) >= 0.1).select("phase", "id", "source")


@query("dedup_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_first(t: Tables) -> DataFrame:
    """By digest: partial minima, and no text is shuffled."""
    return t.documents.groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("join_pairs_vocab", f"""WITH {WORDS}, v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS id FROM words GROUP BY w ORDER BY id LIMIT 300),
p AS (SELECT a.w AS w1, b.w AS w2, count(*) AS n FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY 1, 2)
SELECT x.id AS id1, y.id AS id2, n FROM p JOIN v x ON p.w1 = x.w JOIN v y ON p.w2 = y.w""")
def join_pairs_vocab(t: Tables) -> DataFrame:
    words = word_rows(t.documents)
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(300)
    v = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "w")).cast("long")).select("w", "id")
    nxt = words.withColumn("w2", F.lead("w").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("w2 is not null")
    p = nxt.groupBy(F.col("w").alias("w1"), "w2").agg(F.count(F.lit(1)).alias("n"))
    one = p.join(F.broadcast(v.toDF("w1", "id1")), "w1").join(F.broadcast(v.toDF("w2", "id2")), "w2")  # 300 rows
    return one.select("id1", "id2", "n")


@query("join_semi", r"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark), """ + DISTINCT_WORDS + " SELECT w FROM vw WHERE w IN (SELECT w FROM b)")
def join_semi(t: Tables) -> DataFrame:
    return distinct_words(t.documents).join(distinct_words(t.benchmark), "w", "left_semi")


@query("join_anti", r"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark), """ + DISTINCT_WORDS + " SELECT w FROM b WHERE w NOT IN (SELECT w FROM vw)")
def join_anti(t: Tables) -> DataFrame:
    return distinct_words(t.benchmark).join(distinct_words(t.documents), "w", "left_anti")


@query("join_full_merge", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'customer' ELSE 'supplier' END AS source,
  coalesce(a.n, 0) AS n_customer, coalesce(b.n, 0) AS n_supplier
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def join_full_merge(t: Tables) -> DataFrame:
    a = t.customer.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customer"))
    b = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_supplier"))
    return C.merge_with_precedence(a, b, "k", "customer", "supplier").select("k", "source", F.coalesce("n_customer", F.lit(0)).alias("n_customer"), F.coalesce("n_supplier", F.lit(0)).alias("n_supplier"))


@query("enrich_vocab", r"""SELECT p_partkey, coalesce(a.n, 0) AS n_lines, coalesce(b.n, 0) AS n_returned, coalesce(c.n, 0) AS n_suppliers FROM part
LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a ON a.k = p_partkey
LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.k = p_partkey
LEFT JOIN (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) c ON c.k = p_partkey""")
def enrich_vocab(t: Tables) -> DataFrame:
    """Three counters of one key are one aggregation, so one shuffle of the fact table."""
    n = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_returned", "n_suppliers")]
    return t.part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", *zero)


@query("jaccard_pairs", r"""WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}]+'))) AS ws FROM documents),
r AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY ws) AS rep FROM s WHERE len(ws) > 0), e AS (SELECT doc_id AS id, len(ws) AS n, unnest(ws) AS w FROM r WHERE doc_id = rep),
i AS (SELECT a.id AS d1, b.id AS d2, a.n AS n1, b.n AS n2, count(*) AS c FROM e a JOIN e b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n)
SELECT d1, d2, round(c / (n1 + n2 - c), 6) AS jaccard FROM i WHERE c / (n1 + n2 - c) >= 0.2 UNION ALL SELECT rep, doc_id, 1.0 FROM r WHERE doc_id <> rep""")
def jaccard_pairs(t: Tables) -> DataFrame:
    """All pairs of different word sets of whole texts; equal sets are named by their smallest doc_id."""
    from textloom.operators.pairs import similar_sets

    el = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("el"))
    return similar_sets(el, 0.2, collapse=True).select(F.col("id1").alias("d1"), F.col("id2").alias("d2"), F.round("jaccard", 6).alias("jaccard"))


@query("overlap_pairs", """WITH e AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS el FROM lineitem),
i AS (SELECT a.id AS id1, b.id AS id2, count(*) AS both_ FROM e a JOIN e b ON a.el = b.el AND a.id < b.id GROUP BY 1, 2)
SELECT id1, id2, both_ AS overlap FROM i""")
def overlap_pairs(t: Tables) -> DataFrame:
    """Suppliers that share parts, over all line items."""
    from textloom.operators.pairs import shared_elements

    return shared_elements(t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("el")).distinct())


@query("affix_jaccard", f"""WITH {DISTINCT_WORDS}, p AS (SELECT left(w, 2) AS affix, substr(w, 3) AS root FROM vw WHERE length(w) BETWEEN 5 AND 7),
k AS (SELECT affix FROM p GROUP BY affix HAVING count(*) >= 50), e AS (SELECT p.* FROM p JOIN k USING (affix)), c AS (SELECT affix, count(*) AS n FROM e GROUP BY 1),
i AS (SELECT a.affix AS a1, b.affix AS a2, count(*) AS both_ FROM e a JOIN e b ON a.root = b.root AND a.affix < b.affix GROUP BY 1, 2)
SELECT a1, a2, round(both_ / (x.n + y.n - both_), 6) AS jaccard FROM i JOIN c x ON a1 = x.affix JOIN c y ON a2 = y.affix WHERE both_ / (x.n + y.n - both_) > 0.05""")
def affix_jaccard(t: Tables) -> DataFrame:
    from textloom.operators.pairs import similar_sets

    p = distinct_words(t.documents).filter(F.length("w").between(5, 7)).select(F.left("w", F.lit(2)).alias("id"), F.substring("w", 3, 99).alias("el"))
    big = p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 50").select("id")
    out = similar_sets(p.join(big, "id", "left_semi"), 0.0).filter("jaccard > 0.05")
    return out.select(F.col("id1").alias("a1"), F.col("id2").alias("a2"), F.round("jaccard", 6).alias("jaccard"))


@query("cooccurrence", f"""WITH {WORDS} SELECT least(a.w, b.w) AS w1, greatest(a.w, b.w) AS w2, count(*) AS n FROM words a JOIN words b
ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 3 GROUP BY 1, 2 HAVING count(*) >= 3""")
def cooccurrence(t: Tables) -> DataFrame:
    from textloom.operators.pairs import cooccurrence as co

    docs = t.documents.filter("doc_id is not null")
    lists = docs.select("doc_id", T.words(F.col("text")).alias("ws"))
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    if not again.isEmpty():  # texts under one doc_id meet word by word: each such pair is a list of its own
        rows = word_rows(docs.join(again, "doc_id", "left_semi"))
        after = rows.select("doc_id", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 3)).alias("pos"), F.col("w").alias("before"))
        met = after.join(rows, ["doc_id", "pos"]).select("doc_id", F.array("before", "w").alias("ws"))
        lists = lists.join(again, "doc_id", "left_anti").union(met)
    return co(lists, "ws", 3, least=3)


@query("cluster_pairs", "SELECT a.label, a.vec_id AS id1, b.vec_id AS id2 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cluster_pairs(t: Tables) -> DataFrame:
    from textloom.operators.pairs import group_pairs

    return group_pairs(t.embeddings.select("label", "vec_id"), ["label"], "vec_id")


@query("dialogue_pairs", """WITH w AS (SELECT conv_id, turn, role, text, list(struct_pack(r := role, x := text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nx FROM conversations)
SELECT conv_id, turn, list_filter(nx, lambda e: e.r <> 'user' AND length(e.x) >= 10)[1].x AS answer, coalesce(len(nx), 0) AS n_context FROM w WHERE role = 'user'""")
def dialogue_pairs(t: Tables) -> DataFrame:
    nxt = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 5)
    rows = t.conversations.withColumn("nx", F.collect_list(F.struct("role", "text")).over(nxt)).filter("role = 'user'")
    said = F.filter("nx", lambda e: (e["role"] != "user") & (F.length(e["text"]) >= 10))
    return rows.select("conv_id", "turn", F.get(said, 0)["text"].alias("answer"), F.size("nx").cast("long").alias("n_context"))


@query("prefix_similar", f"""WITH {DISTINCT_WORDS}, q AS (SELECT w AS new_w FROM vw WHERE length(w) >= 9), k AS (SELECT w FROM vw WHERE length(w) BETWEEN 4 AND 6),
c AS (SELECT new_w, k.w, max(n) AS shared FROM q CROSS JOIN (VALUES (4), (3), (2), (1)) v(n) JOIN k ON left(new_w, n) = left(k.w, n) GROUP BY 1, 2)
SELECT new_w, w, shared, rk FROM (SELECT *, row_number() OVER (PARTITION BY new_w ORDER BY shared DESC, w) AS rk FROM c) WHERE rk <= 5""")
def prefix_similar(t: Tables) -> DataFrame:
    from textloom.operators.pairs import prefix_similar as near

    v = distinct_words(t.documents)
    q = v.filter(F.length("w") >= 9).withColumnRenamed("w", "new_w")
    out = near(q, "new_w", v.filter(F.length("w").between(4, 6)), "w", 4, 5)
    return out.select("new_w", "w", "shared", F.col("rk").cast("long").alias("rk"))


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("ready_steps", """WITH d AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT event_id FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM d)""")
def ready_steps(t: Tables) -> DataFrame:
    done = t.events.filter("event_type = 'purchase'").select("user_id").distinct()
    return t.events.filter("event_type = 'view'").join(done, "user_id", "left_semi").select("event_id")


# ---- aggregation


@query("count_by_source", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def count_by_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("grouping_sets_stats", f"""SELECT tier, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT *, {TIER_SQL} AS tier FROM documents)
GROUP BY GROUPING SETS ((tier), (source), ())""")
def grouping_sets_stats(t: Tables) -> DataFrame:
    rows = t.documents.select(tier_of(F.col("source")).alias("tier"), "source", "n_chars")
    g = rows.groupingSets([["tier"], ["source"], []], "tier", "source")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select("tier", "source", "n", "chars")


ROOT_COUNTS = f"{WORDS}, rc AS (SELECT {strip_sql('w', lx.ROOT_ENDINGS)} AS root, count(*) AS n FROM words GROUP BY 1)"


def root_counts(t: Tables) -> DataFrame:
    """Words are counted before their endings are cut: distinct words are far fewer."""
    words = t.documents.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return words.groupBy(T.strip_ending(F.col("w")).alias("root")).agg(F.sum("c").alias("n"))


@query("root_vocab", f"WITH {ROOT_COUNTS} SELECT root, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, root) + 3 AS id FROM rc WHERE n >= 5")
def root_vocab(t: Tables) -> DataFrame:
    return C.with_rank(root_counts(t).filter("n >= 5"), [F.desc("n"), F.col("root")], "id").select("root", "n", (F.col("id") + 3).alias("id"))


@query("token_vocab", r"""SELECT tok, id FROM (SELECT tok, row_number() OVER (ORDER BY n DESC, tok) + 3 AS id FROM (
  SELECT tok, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS tok FROM documents) WHERE tok <> '' GROUP BY tok ORDER BY n DESC, tok LIMIT 996))
UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<bos>', 2), ('<eos>', 3)) v(tok, id)""")
def token_vocab(t: Tables) -> DataFrame:
    tok = t.documents.select(F.explode(F.split("text", " ")).alias("tok")).filter("tok <> ''").groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    top = tok.orderBy(F.desc("n"), "tok").limit(996)
    ids = top.select("tok", (F.row_number().over(Window.orderBy(F.desc("n"), "tok")) + 3).cast("long").alias("id"))
    return ids.union(t.documents.sparkSession.createDataFrame([("<pad>", 0), ("<unk>", 1), ("<bos>", 2), ("<eos>", 3)], "tok string, id long"))


@query("root_coverage", r"""SELECT w, n, rk, round(n / total, 9) AS share, round(cum / total, 9) AS coverage FROM (
  SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS rk, CAST(sum(n) OVER (ORDER BY n DESC, w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total
  FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM documents) GROUP BY w)) WHERE rk <= 1000""")
def root_coverage(t: Tables) -> DataFrame:
    return C.coverage(t.documents.select(F.explode(T.words(F.col("text"))).alias("w")), "w", 1000)


@query("cumulative_coverage", r"""SELECT milestone, min(rk) AS n_roots FROM (
  SELECT row_number() OVER (ORDER BY n DESC, w) AS rk, sum(n) OVER (ORDER BY n DESC, w ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cov
  FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM documents) GROUP BY w))
JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) m(milestone) ON cov >= milestone GROUP BY milestone""")
def cumulative_coverage(t: Tables) -> DataFrame:
    cov = C.coverage(t.documents.select(F.explode(T.words(F.col("text"))).alias("w")), "w", None, digits=None)
    mins = cov.agg(*[F.min(F.when(F.col("coverage") >= m, F.col("rk"))).alias(str(i)) for i, m in enumerate((0.5, 0.8, 0.9, 0.95))])
    pairs = F.array(*[F.struct(F.lit(m).alias("milestone"), F.col(str(i)).alias("n_roots")) for i, m in enumerate((0.5, 0.8, 0.9, 0.95))])
    return mins.select(F.inline(pairs))


PROPER = r"""pn AS (SELECT doc_id, pos, w, CASE WHEN regexp_matches(w, '(o|on|oj|ojn)$') AND length(w) > 4 THEN regexp_replace(w, '(ojn|oj|on|o)$', '') ELSE w END AS base FROM (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}]+') AS ws FROM documents))
  WHERE length(w) >= 2 AND regexp_matches(w, '^\p{Lu}') AND upper(w) <> w)"""


def proper_nouns(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("p", "w"))
    rows = rows.filter((F.length("w") >= 2) & F.col("w").rlike(r"^\p{Lu}") & (F.upper("w") != F.col("w")))
    base = F.when(F.col("w").rlike("(o|on|oj|ojn)$") & (F.length("w") > 4), F.regexp_replace("w", "(ojn|oj|on|o)$", "")).otherwise(F.col("w"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "w", base.alias("base"))


@query("proper_noun_dict", f"""WITH {PROPER} SELECT base, count(*) AS n, list(doc_id ORDER BY doc_id, pos)[1:5] AS first_docs,
  CASE WHEN ends_with(base, 'land') THEN 'place' WHEN ends_with(base, 'er') THEN 'person' ELSE 'other' END AS category FROM pn GROUP BY base HAVING count(*) >= 3""")
def proper_noun_dict(t: Tables) -> DataFrame:
    return C.noun_dictionary(proper_nouns(t), least=3, contexts=5)


@query("safe_ratio", "SELECT source, CASE WHEN count(*) FILTER (WHERE lang = 'de') > 0 THEN round(count(*) FILTER (WHERE lang = 'fr') / count(*) FILTER (WHERE lang = 'de'), 6) ELSE 0 END AS ratio FROM documents GROUP BY source")
def safe_ratio(t: Tables) -> DataFrame:
    ratio = F.coalesce(F.try_divide(F.count_if(F.col("lang") == "fr"), F.count_if(F.col("lang") == "de")), F.lit(0.0))
    return t.documents.groupBy("source").agg(F.round(ratio, 6).alias("ratio"))


@query("removal_stats", """SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'both' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' ELSE 'kept' END AS reason,
  count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def removal_stats(t: Tables) -> DataFrame:
    reason = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "both").when(F.col("quality") == 0, "low_quality").when(F.col("toxic") == 1, "toxic").otherwise("kept")
    return t.documents.join(t.labels, "doc_id").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("samples_per_group", "SELECT source, doc_id, rk FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM documents) WHERE rk <= 10")
def samples_per_group(t: Tables) -> DataFrame:
    return C.sample_per_group(t.documents, "source", "doc_id", 10).select("source", "doc_id", F.col("rk").cast("long").alias("rk"))


@query("affix_roots", f"""WITH {DISTINCT_WORDS} SELECT p AS affix, count(*) AS n_roots FROM vw JOIN (VALUES {', '.join(f"('{p}')" for p in lx.PREFIXES)}) v(p)
ON starts_with(w, p) AND length(w) > length(p) + 2 GROUP BY p""")
def affix_roots(t: Tables) -> DataFrame:
    fits = F.filter(F.array(*map(F.lit, lx.PREFIXES)), lambda p: F.startswith(F.col("w"), p) & (F.length("w") > F.length(p) + 2))
    return distinct_words(t.documents).select(F.explode(fits).alias("affix"), "w").groupBy("affix").agg(F.count(F.lit(1)).alias("n_roots"))


@query("pair_max_target", "SELECT l_partkey AS a, l_suppkey AS b, max(round(l_discount * 10, 3)) AS target, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pair_max_target(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max(F.round(F.col("l_discount") * 10, 3)).alias("target"), F.count(F.lit(1)).alias("n"))


@query("best_per_text", "SELECT l_partkey AS k, max(l_extendedprice * CASE WHEN l_returnflag = 'R' THEN 1.2 ELSE 1.0 END) AS best, arg_max(l_orderkey, (l_extendedprice * CASE WHEN l_returnflag = 'R' THEN 1.2 ELSE 1.0 END, -l_orderkey)) AS at FROM lineitem GROUP BY 1")
def best_per_text(t: Tables) -> DataFrame:
    score = F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", 1.2).otherwise(1.0)
    best = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.struct(score.alias("s"), (-F.col("l_orderkey")).alias("o"))).alias("b"))
    return best.select("k", F.col("b.s").alias("best"), (-F.col("b.o")).alias("at"))


@query("latency_stats", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS lo, max(value) AS hi,
  round(coalesce(stddev_samp(value), 0), 6) AS sd, list(value ORDER BY value)[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type""")
def latency_stats(t: Tables) -> DataFrame:
    return C.latency(t.events, ["event_type"], "value")


@query("effective_weight", f"""WITH c AS (SELECT tier, count(*) AS n FROM (SELECT {TIER_SQL} AS tier FROM documents) GROUP BY tier)
SELECT tier, n, round(n * {WEIGHT_MERGE} / sum(n * {WEIGHT_MERGE}) OVER (), 9) AS share_merge, round(n * {WEIGHT_TRAIN} / sum(n * {WEIGHT_TRAIN}) OVER (), 9) AS share_train FROM c""")
def effective_weight(t: Tables) -> DataFrame:
    c = t.documents.groupBy(tier_of(F.col("source")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    a, b = (F.col("n") * weight_of(F.col("tier"), i) for i in (0, 1))
    every = Window.partitionBy()
    return c.select("tier", "n", F.round(a / F.sum(a).over(every), 9).alias("share_merge"), F.round(b / F.sum(b).over(every), 9).alias("share_train"))


@query("usage_category", r"""SELECT left(w, 4) AS stem, CASE WHEN v > n AND v > a THEN 'verb' WHEN n >= v AND n >= a THEN 'noun' ELSE 'adjective' END AS category FROM (
  SELECT w, count(*) FILTER (WHERE regexp_matches(x, '(as|is|os|i)$')) AS v, count(*) FILTER (WHERE regexp_matches(x, '(o|oj|on)$')) AS n, count(*) FILTER (WHERE regexp_matches(x, '(a|aj|an)$')) AS a
  FROM (SELECT left(x, 4) AS w, x FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS x FROM documents) WHERE length(x) > 5) GROUP BY w)""")
def usage_category(t: Tables) -> DataFrame:
    x = t.documents.select(F.explode(T.words(F.col("text"))).alias("x")).filter(F.length("x") > 5)
    n = lambda p: F.count_if(F.col("x").rlike(p))
    g = x.groupBy(F.left("x", F.lit(4)).alias("stem")).agg(n("(as|is|os|i)$").alias("v"), n("(o|oj|on)$").alias("n"), n("(a|aj|an)$").alias("a"))
    return g.select("stem", F.when((F.col("v") > F.col("n")) & (F.col("v") > F.col("a")), "verb").when((F.col("n") >= F.col("v")) & (F.col("n") >= F.col("a")), "noun").otherwise("adjective").alias("category"))


@query("first_wins", "SELECT p_brand, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY p_brand")
def first_wins(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("p_type"))


@query("language_share", "SELECT lang, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, CAST(floor(1000000 * count(*) / (SELECT count(*) FROM documents)) AS BIGINT) AS estimate FROM documents GROUP BY lang")
def language_share(t: Tables) -> DataFrame:
    c = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return c.select("lang", F.round(F.col("n") / total, 6).alias("share"), F.floor(1000000 * F.col("n") / total).alias("estimate"))


@query("quality_bands", f"WITH {PARSE_RATE} SELECT CASE WHEN known / total >= 0.5 THEN 'high' WHEN known / total >= 0.3 THEN 'mid' WHEN known / total >= 0.1 THEN 'low' ELSE 'poor' END AS band, count(*) AS n FROM rates GROUP BY 1")
def quality_bands(t: Tables) -> DataFrame:
    r = F.col("known") / F.col("total")
    band = F.when(r >= 0.5, "high").when(r >= 0.3, "mid").when(r >= 0.1, "low").otherwise("poor")
    return parse_rates(t).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_count", f"WITH {DISTINCT_WORDS} SELECT count(*) AS n FROM vw")
def distinct_count(t: Tables) -> DataFrame:
    return distinct_words(t.documents).agg(F.count(F.lit(1)).alias("n"))


@query("failed_words", f"""WITH {DISTINCT_WORDS}, wc AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM documents) GROUP BY w),
f AS (SELECT CASE WHEN length(w) <= 2 THEN 'short' WHEN regexp_matches(w, '[ĉĝĥĵŝŭéèñßäöü]') THEN 'accented' ELSE 'plain' END AS category, w, n FROM wc
  WHERE w NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) FROM benchmark))
SELECT category, w, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, w) AS rk FROM f) WHERE rk <= 20""")
def failed_words(t: Tables) -> DataFrame:
    wc = t.documents.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    f = wc.join(distinct_words(t.benchmark), "w", "left_anti")
    cat = F.when(F.length("w") <= 2, "short").when(F.col("w").rlike("[ĉĝĥĵŝŭéèñßäöü]"), "accented").otherwise("plain")
    f = f.withColumn("category", cat)
    rk = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "w"))
    return f.withColumn("rk", rk).filter("rk <= 20").select("category", "w", "n")


@query("error_classes", r"SELECT CASE WHEN props LIKE '%1}' THEN 'timeout' WHEN props LIKE '%2}' THEN 'parse' ELSE 'other' END AS class, regexp_extract(props, '([0-9])\}', 1) AS digit, count(*) AS n FROM events GROUP BY 1, 2")
def error_classes(t: Tables) -> DataFrame:
    c = F.when(F.col("props").like("%1}"), "timeout").when(F.col("props").like("%2}"), "parse").otherwise("other")
    return t.events.groupBy(c.alias("class"), F.regexp_extract("props", r"([0-9])\}", 1).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_quality", f"""WITH {PARSE_RATE} SELECT lang, source, CAST(sum(total) AS BIGINT) AS words, CAST(sum(known) AS BIGINT) AS known_words, round(sum(known) / sum(total), 6) AS rate
FROM rates JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def corpus_quality(t: Tables) -> DataFrame:
    rows = parse_rates(t).join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    g = rows.rollup("lang", "source").agg(F.sum("total").alias("words"), F.sum("known").alias("known_words"))
    return g.withColumn("rate", F.round(F.col("known_words") / F.col("words"), 6))


@query("trace_stats", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, count(*) >= 5 AS pattern FROM events GROUP BY event_type HAVING count(*) >= 3""")
def trace_stats(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))
    return g.filter("n >= 3").withColumn("pattern", F.col("n") >= 5)


@query("intent_priority", """SELECT event_type, round(0.6 * least(count(*) / 20, 1) + 0.4 * least(avg(value) / 100, 1), 6) AS priority FROM events GROUP BY event_type""")
def intent_priority(t: Tables) -> DataFrame:
    p = 0.6 * F.least(F.count(F.lit(1)) / 20, F.lit(1.0)) + 0.4 * F.least(F.avg("value") / 100, F.lit(1.0))
    return t.events.groupBy("event_type").agg(F.round(p, 6).alias("priority"))


@query("inventory", "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def inventory(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


# ---- windows, order, sets, samples


@query("negated_verb", f"WITH {WORDS} SELECT doc_id, pos, w FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS before_ FROM words) WHERE before_ IN ('not', 'ne', 'no', 'nicht', 'pas')")
def negated_verb(t: Tables) -> DataFrame:
    rows = word_rows(t.documents).withColumn("before_", F.lag("w").over(Window.partitionBy("doc_id").orderBy("pos")))
    return rows.filter(F.col("before_").isin("not", "ne", "no", "nicht", "pas")).select("doc_id", "pos", "w")


@query("carry_forward", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'login' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_start,
  count(CASE WHEN event_type = 'login' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM events""")
def carry_forward(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("event_type") == "login", F.col("event_id"))
    return t.events.select("event_id", "user_id", F.last(start, ignorenulls=True).over(w).alias("session_start"), F.count(start).over(w).alias("session_no"))


@query("trend", "SELECT DISTINCT event_type, first_value(value) OVER w AS first_v, last_value(value) OVER w AS last_v FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def trend(t: Tables) -> DataFrame:
    """First and last by order are a minimum and a maximum: no window over whole types."""
    v = F.struct("ts", "event_id", "value")
    g = t.events.groupBy("event_type").agg(F.min(v).alias("a"), F.max(v).alias("b"))
    return g.select("event_type", F.col("a.value").alias("first_v"), F.col("b.value").alias("last_v"))


@query("last_n", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_n(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id")


@query("by_hour", "SELECT CAST(extract(hour FROM ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1")
def by_hour(t: Tables) -> DataFrame:
    return t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("default_scores", "SELECT conv_id, turn, round(1 - (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / count(*) OVER (PARTITION BY conv_id), 6) AS score FROM conversations")
def default_scores(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", F.round(1 - (F.row_number().over(w.orderBy("turn")) - 1) / F.count(F.lit(1)).over(w), 6).alias("score"))


@query("top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("sorted_ids", f"WITH {DISTINCT_WORDS} SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM vw")
def sorted_ids(t: Tables) -> DataFrame:
    return C.with_rank(distinct_words(t.documents), [F.col("w")], "id").select("w", (F.col("id") - 1).alias("id"))


@query("recent_events", "SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) ORDER BY ts DESC, event_id LIMIT 20")
def recent_events(t: Tables) -> DataFrame:
    newest = t.events.agg((F.max("ts") - F.expr("INTERVAL 10 DAY")).alias("since"))
    rows = t.events.filter("event_type = 'click'").join(F.broadcast(newest), F.col("ts") >= F.col("since"))  # one row
    return rows.orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "event_type")


@query("vocab_setops", r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM conversations)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def vocab_setops(t: Tables) -> DataFrame:
    a, b = distinct_words(t.benchmark), distinct_words(t.conversations)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "first")).union(n(b.subtract(a), "second"))


@query("relation_pairs", "SELECT DISTINCT least(o_custkey % 50, o_orderkey % 50) AS a, greatest(o_custkey % 50, o_orderkey % 50) AS b FROM orders WHERE o_custkey % 50 <> o_orderkey % 50")
def relation_pairs(t: Tables) -> DataFrame:
    x, y = F.col("o_custkey") % 50, F.col("o_orderkey") % 50
    return t.orders.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


@query("counter_addition", r"SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) FROM conversations) GROUP BY w) GROUP BY w")
def counter_addition(t: Tables) -> DataFrame:
    n = lambda df: df.select(F.explode(T.words(F.col("text"))).alias("w"))
    return n(t.benchmark).union(n(t.conversations)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


JUNK = [("short", "^.{1,2}$"), ("repeated", "^(the|an|er|on)+$"), ("accented", "[éèñßäöüçêíóú]"), ("compound", "^.{15,}$"), ("ending", "(tion|ing|ment)$"), ("prefix", "^(re|un|dis)")]


@query("junk_classes", r"WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark), " + DISTINCT_WORDS + ", j AS (SELECT w FROM vw EXCEPT SELECT w FROM b) SELECT CASE "
       + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{k}'" for k, p in JUNK) + " ELSE 'other' END AS class, count(*) AS n FROM j GROUP BY 1")
def junk_classes(t: Tables) -> DataFrame:
    case = None
    for k, p in JUNK:
        case = F.when(F.col("w").rlike(p), k) if case is None else case.when(F.col("w").rlike(p), k)
    return distinct_words(t.documents).subtract(distinct_words(t.benchmark)).groupBy(case.otherwise("other").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("root_audit", f"WITH {DISTINCT_WORDS} SELECT w, w IN (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) FROM benchmark) AS in_first, regexp_matches(w, '^[a-z]+$') AS ascii FROM vw WHERE length(w) <= 4")
def root_audit(t: Tables) -> DataFrame:
    b = distinct_words(t.benchmark).withColumn("hit", F.lit(True))
    rows = distinct_words(t.documents).filter(F.length("w") <= 4).join(b, "w", "left")
    return rows.select("w", F.coalesce("hit", F.lit(False)).alias("in_first"), F.col("w").rlike("^[a-z]+$").alias("ascii"))


@query("sample_capped", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS rk FROM documents) WHERE lang <> 'en' OR rk <= 100")
def sample_capped(t: Tables) -> DataFrame:
    other = t.documents.filter("lang <> 'en'").select("doc_id")
    one = t.documents.filter("lang = 'en'").orderBy(F.md5(F.concat("doc_id", F.lit(":42"))), "doc_id").limit(100)
    return other.union(one.select("doc_id"))


@query("stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk, (SELECT greatest(1, 200 // count(DISTINCT source)) FROM documents) AS k FROM documents) WHERE rk <= k")
def stratified_sample(t: Tables) -> DataFrame:
    k = t.documents.agg(F.greatest(F.lit(1), F.floor(F.lit(200) / F.countDistinct("source")).cast("int")).alias("k"))
    rk = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return t.documents.select("source", "doc_id", rk.alias("rk")).join(F.broadcast(k), F.col("rk") <= F.col("k")).select("source", "doc_id")


@query("query_sample", "SELECT vec_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 50")
def query_sample(t: Tables) -> DataFrame:
    return t.embeddings.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(50).select("vec_id")


@query("hard_negatives", f"""WITH {DISTINCT_WORDS}, s AS (SELECT w FROM vw WHERE length(w) = 5), p AS (SELECT a.w AS w1, b.w AS w2 FROM s a JOIN s b ON left(a.w, 3) = left(b.w, 3) AND a.w < b.w)
SELECT w1, w2 FROM p WHERE right(w1, 1) <> right(w2, 1) ORDER BY md5(w1 || w2), w1, w2 LIMIT 200""")
def hard_negatives(t: Tables) -> DataFrame:
    s = distinct_words(t.documents).filter(F.length("w") == 5).withColumn("k", F.left("w", F.lit(3)))
    p = s.toDF("w1", "k").join(s.toDF("w2", "k"), "k").filter("w1 < w2 and right(w1, 1) <> right(w2, 1)")
    return p.orderBy(F.md5(F.concat("w1", "w2")), "w1", "w2").limit(200).select("w1", "w2")


@query("negative_pairs", r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark), s AS (SELECT w, i, md5(i || ':' || w) AS h, greatest(1, length(ltrim(bin((SELECT count(*) FROM v) // 10000), '0'))) AS bits FROM v, range(0, 3) r(i)),
l AS (SELECT w, lead(w) OVER (PARTITION BY i, ('0x' || left(h, 8))::BIGINT >> (32 - bits)::INT ORDER BY h, w) AS o FROM s),
p AS (SELECT item_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}]+') AS ws FROM benchmark)),
near AS (SELECT DISTINCT least(a.w, b.w) AS w1, greatest(a.w, b.w) AS w2 FROM p a JOIN p b ON a.item_id = b.item_id AND b.pos - a.pos BETWEEN 1 AND 3)
SELECT DISTINCT least(w, o) AS w1, greatest(w, o) AS w2 FROM l WHERE o IS NOT NULL AND w <> o AND (least(w, o), greatest(w, o)) NOT IN (SELECT (w1, w2) FROM near)""")
def negative_pairs(t: Tables) -> DataFrame:
    """Each word with a word chosen by hash, without pairs that stand together in a text."""
    from textloom.operators.pairs import cooccurrence as co
    from textloom.operators.pairs import hashed_pairs

    positives = co(t.benchmark.select(T.words(F.col("text")).alias("ws")), "ws", 3)
    return hashed_pairs(distinct_words(t.benchmark), "w", 3).join(positives.select("w1", "w2"), ["w1", "w2"], "left_anti")


@query("sentence_pairs", """WITH f AS (SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM documents) WHERE rk <= 101),
s AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY rk) AS o FROM f), c AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY rk ORDER BY source) AS o FROM f WHERE rk <= 100)
SELECT doc_id AS id1, o AS id2, 1 AS target FROM s WHERE o IS NOT NULL UNION ALL SELECT doc_id, o, 0 FROM c WHERE o IS NOT NULL""")
def sentence_pairs(t: Tables) -> DataFrame:
    """Neighbours by hash within a source (target 1) and across sources (target 0), at most 100 a source."""
    from textloom.operators.pairs import source_pairs

    return source_pairs(t.documents.select("doc_id", "source"), "doc_id", "source", 100)

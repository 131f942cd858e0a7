"""The opN_<name> queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import quality, toxicity
from textloom.llm.ann import nearest
from textloom.llm._labelled import held_out
from textloom.llm.decontaminate import contaminated
from textloom.llm.license_scan import TEMPLATES, passages_of, scan_licences
from textloom.llm.line_dedup import drop_frequent_lines
from textloom.llm.mixing import fair_mix
from textloom.llm.near_dedup import near_duplicates
from textloom.llm.sharding import shard
from textloom.llm.suffix_dedup import drop_repeats


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), percent=85).drop("node")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return _scored(quality.score(docs, quality.fit(docs, labels)), 0.3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(_read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return _scored(toxicity.score(docs, toxicity.fit(docs, labels)), 0.5)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents"), n_shards=8).drop("linked")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents only, once for each item they hold."""
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = fair_mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), budget_share=1.5, max_repeats=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``; one that is a licence statement for a fifth or more is a licence file of its directory."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    files = docs.select(path.alias("path"), "text")
    out = scan_licences(files)
    doc_id = F.substring_index("path", "/", -1).cast("long").alias("doc_id")
    return out.select(doc_id, "declared", "score", "licence", "from_dir")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_repeats": op5_repeats,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_licences": op9_licences,
    "op10_nearest": op10_nearest,
}

_TEMPLATE_ROWS = ", ".join(f"('{k}', {i}, '{v.lower()}')" for (k, i), v in passages_of(TEMPLATES).items())

ORACLES = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT x AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY x
""",
    "op5_repeats": r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS p FROM h)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
hit AS (SELECT g.doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY g.doc_id ORDER BY p) + 50, true) AS new FROM g JOIN f USING (s) WHERE g.doc_id > least),
run AS (SELECT doc_id, p, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM span),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone, max(b) AS tail, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) AS kept
  FROM piece JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * tail + 1), x))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
""",
    "op9_licences": rf"""
WITH files AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS path, text FROM documents),
t AS (SELECT name, nth, unnest(regexp_extract_all(body, '[a-z0-9]+(?:\.[0-9]+)?')) AS w FROM (VALUES {_TEMPLATE_ROWS}) v(name, nth, body)),
tf AS (SELECT name, nth, w, count(*) AS c FROM t GROUP BY 1, 2, 3), terms AS (SELECT DISTINCT w FROM tf),
fw AS (SELECT DISTINCT path, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)?')) AS w FROM files),
df AS (SELECT terms.w, count(fw.path) AS df FROM terms LEFT JOIN fw USING (w) GROUP BY 1),
total AS (SELECT count(*) AS n FROM files),
idf AS (SELECT w, 1 + ln((1 + n)::DOUBLE / (1 + df)) AS idf FROM df, total),
vec AS (SELECT name, nth, w, c * idf AS x FROM tf JOIN idf USING (w)), vn AS (SELECT name, nth, sqrt(sum(x * x)) AS norm FROM vec GROUP BY name, nth),
un AS (SELECT path, text, list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(regexp_replace(text, '(?m)^[^\p{{L}}\p{{N}}\n]+$', '', 'g'), '\n\n+'), lambda p: contains(trim(p, chr(10)), chr(10)))) AS us FROM files),
lines AS (SELECT path, len(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)?')) AS n_words, unnest(range(1, len(us) + 1)) AS line, unnest(us) AS l FROM un),
lw AS (SELECT path, n_words, line, w, count(*) AS c FROM (SELECT path, n_words, line, unnest(regexp_extract_all(lower(l), '[a-z0-9]+(?:\.[0-9]+)?')) AS w FROM lines) GROUP BY 1, 2, 3, 4),
ln_ AS (SELECT path, line, sqrt(sum(pow(c * coalesce(idf, 1 + ln(1.0 + n)), 2))) AS norm, sum(c) / max(n_words) AS share FROM lw LEFT JOIN idf USING (w), total GROUP BY 1, 2),
dots AS (SELECT path, line, name, nth, sum(c * idf * x / vn.norm) AS dot FROM lw JOIN idf USING (w) JOIN vec USING (w) JOIN vn USING (name, nth) GROUP BY 1, 2, 3, 4),
best AS (SELECT path, -b.s AS score, -b.sh AS share, b.name AS licence FROM (
  SELECT path, min(struct_pack(s := -round(dot / norm, 9), sh := -share, name := name)) AS b FROM dots JOIN ln_ USING (path, line) WHERE round(dot / norm, 9) >= 0.8 GROUP BY path)),
rows_ AS (SELECT files.*, score, share, licence FROM files LEFT JOIN best USING (path)),
dirs AS (SELECT dir, b.licence AS dir_licence FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, min(struct_pack(s := -score, path := path, licence := licence)) AS b FROM rows_ WHERE share >= 0.2 AND licence IS NOT NULL GROUP BY 1))
SELECT doc_id, licence AS declared, score, coalesce(licence, dir_licence) AS licence, CASE WHEN licence IS NULL THEN dir END AS from_dir
FROM rows_ LEFT JOIN dirs ON regexp_replace(path, '/[^/]*$', '') = dir
""",
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, rn, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rn) >= 10)
SELECT keyed.doc_id, count(*) AS n_lines, count(frequent.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE frequent.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k GROUP BY keyed.doc_id, rn
""",
    "op8_mixing": r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS src FROM base GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][(src - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2 AS cap FROM s),
f AS (SELECT *, cap / weight AS fill, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY fill, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (
  SELECT *, (SELECT level FROM l WHERE level <= fill ORDER BY fill, src LIMIT 1) AS time FROM l),
targets AS (SELECT *, least(CAST(cap AS DOUBLE), coalesce(time * weight, CAST(cap AS DOUBLE))) AS target FROM t),
q AS (
  SELECT base.*, src, weight, source_size, target, budget,
         sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source),
p AS (
  SELECT *, sum(size) OVER (ORDER BY (cum + turn * source_size) / weight, src, h, doc_id, turn ROWS UNBOUNDED PRECEDING) AS spent
  FROM q, (VALUES (0), (1)) AS v(turn) WHERE size > 0),
taken AS (SELECT src, cum, count(*) AS turns FROM p WHERE spent <= budget GROUP BY src, cum)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * coalesce(turns, 0) ELSE 0 END AS BIGINT) AS taken
FROM q LEFT JOIN taken USING (src, cum)
""",
}

"""Queries over lines, sections and plans; generation metrics; word composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vector as V
from textloom.operators import search as S
from textloom.operators import structure as O
from textloom.plans.language_queries import analysis_sql, made_sentences, roots, stems
from textloom.operators import syntax
from textloom.operators.shared import written
from textloom.plans.registry import Tables, query
from textloom.plans.text_queries import _BODY, LINES, line_rows, substitute_sql

_DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]))"


@query("join_wrapped_lines", rf"""WITH {LINES}, l AS (SELECT doc_id, pos, trim(line) AS t, regexp_matches(trim(line), '[.!?:»"”]$') AS ends FROM lines),
g AS (SELECT *, coalesce(sum(CAST(t = '' OR ends AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k, max(pos) OVER (PARTITION BY doc_id) AS last FROM l),
b AS (SELECT doc_id, k, string_agg(t, ' ' ORDER BY pos) FILTER (WHERE t <> '') AS block, bool_or(ends OR t = '') AS closed FROM g GROUP BY doc_id, k)
SELECT doc_id, trim(coalesce(string_agg(block || CASE WHEN closed THEN chr(10) ELSE '' END, '' ORDER BY k), '')) AS text FROM b GROUP BY doc_id""")
def join_wrapped_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", O.join_wrapped(F.col("text")).alias("text"))


@query("skip_front_matter", rf"""WITH {LINES}, h AS (SELECT *, length(line) < 40 AS short, sum(CAST(length(line) >= 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM lines WHERE pos <= 200),
r AS (SELECT *, sum(CAST(short AS INT)) OVER (PARTITION BY doc_id, island ORDER BY pos) AS run FROM h), p AS (SELECT *, lag(run) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r),
s AS (SELECT doc_id, coalesce(min(pos) FILTER (WHERE regexp_matches(line, '{O.BODY_MARKERS.replace('(?iu)', '(?i)')}')), min(pos) FILTER (WHERE length(line) > 100 AND before > 5), 1) AS start FROM p GROUP BY doc_id)
SELECT doc_id, min(pos) AS start, count(*) AS n FROM lines JOIN s USING (doc_id) WHERE pos >= start GROUP BY doc_id""")
def skip_front_matter(t: Tables) -> DataFrame:
    return O.skip_front_matter(line_rows(t.documents)).groupBy("doc_id").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))


@query("wiki_articles", "SELECT doc_id, CAST(length(trim(text)) > 200 AS BIGINT) * 2 AS n FROM documents")
def wiki_articles(t: Tables) -> DataFrame:
    """Two copies of a text between category tags are two articles."""
    joined = F.concat("text", F.lit("[[Kategorio:A]]"), "text", F.lit("[[Category:B]]"))
    return t.documents.select("doc_id", F.size(O.wiki_articles(joined)).cast("long").alias("n"))


LITERARY_STEPS = [*T.HTML_STEPS[:4], (r"[\w.+-]+@[\w-]+\.[\w.]+", " "), (r"\{[^}]*\}", " "), (r"https?://\S+", " "), (r"[ \t]+", " ")]


@query("clean_literary", f"SELECT doc_id, trim({substitute_sql('text', LITERARY_STEPS)}) AS text FROM documents")
def clean_literary(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.trim(T.substitute(F.col("text"), LITERARY_STEPS)).alias("text"))


WIKI_STEPS = [
    (r"(?s)\{\{[^{}]*\}\}", ""), (r"(?s)\{\|.*?\|\}", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"\[https?://\S+\s?([^\]]*)\]", "$1"), (r"'{2,}", ""), (r"(?m)^[*#:;]+\s*", ""),
]
WIKI_SQL = "'{{box|a}}' || repeat(chr(39), 3) || text || repeat(chr(39), 3) || ' [[Page|label]] [http://a.b site]' || chr(10) || '* item<ref>x</ref>'"


@query("clean_mediawiki", f"SELECT doc_id, {substitute_sql(WIKI_SQL, WIKI_STEPS)} AS text FROM documents")
def clean_mediawiki(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("{{box|a}}'''"), "text", F.lit("''' [[Page|label]] [http://a.b site]\n* item<ref>x</ref>"))
    return t.documents.select("doc_id", T.substitute(marked, WIKI_STEPS).alias("text"))


@query("clean_gutenberg", rf"""SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(string_split({_BODY}, chr(10)), lambda x: NOT regexp_matches(x, '^\s*\[|^\s*[0-9]+\s*$|^\s*[*]+')), chr(10)), '[_=]+', '', 'g')) AS text FROM documents""")
def clean_gutenberg(t: Tables) -> DataFrame:
    lines = T.drop_lines(T.strip_boilerplate(F.col("text")), r"^\s*\[|^\s*[0-9]+\s*$|^\s*[*]+")
    return t.documents.select("doc_id", F.trim(F.regexp_replace(lines, r"[_=]+", "")).alias("text"))


@query("section_fill", f"WITH {LINES} SELECT doc_id, pos, CASE WHEN pos > 1 THEN 'Head' END AS section, CASE WHEN pos > 1 THEN 2 ELSE 0 END AS section_level FROM lines WHERE pos <> 2")
def section_fill(t: Tables) -> DataFrame:
    """The second line of each text stands for a heading."""
    lines = line_rows(t.documents).withColumn("line", F.when(F.col("pos") == 2, "== Head ==").otherwise(F.regexp_replace("line", "^=+", "")))
    return O.fill_sections(lines).select("doc_id", "pos", "section", "section_level")


@query("exercise_rows", f"WITH {LINES} SELECT doc_id, '7' AS exercise, pos - 2 AS nth, '§7:' || (pos - 2) AS citation FROM lines WHERE pos BETWEEN 3 AND 6")
def exercise_rows(t: Tables) -> DataFrame:
    lines = line_rows(t.documents).withColumn("line", F.when(F.col("pos") == 2, "§ 7").otherwise(F.regexp_replace("line", "^§", "")))
    return O.exercises(lines, 1, 6).select("doc_id", "exercise", F.col("nth").cast("long").alias("nth"), "citation")


@query("rule_question", "SELECT conv_id, turn, CASE WHEN contains(text, 'OBJ') THEN 'Kion?' WHEN contains(text, 'SUBJ') THEN 'Kiu?' ELSE 'Kio okazas?' END AS question FROM conversations")
def rule_question(t: Tables) -> DataFrame:
    q = F.when(F.contains("text", F.lit("OBJ")), "Kion?").when(F.contains("text", F.lit("SUBJ")), "Kiu?").otherwise("Kio okazas?")
    return t.conversations.select("conv_id", "turn", q.alias("question"))


@query("plan_levels", "WITH RECURSIVE n AS (SELECT n_nationkey AS k, 0 AS level FROM nation WHERE n_nationkey < 5 UNION ALL SELECT k + 5, level + 1 FROM n WHERE k + 5 < 25) SELECT k AS step, level FROM n")
def plan_levels(t: Tables) -> DataFrame:
    """Step k needs step k - 5."""
    steps = t.nation.select(F.col("n_nationkey").alias("step"))
    needs = steps.filter("step >= 5").select("step", (F.col("step") - 5).alias("need"))
    return O.step_levels(steps, needs)


_SIDES = ", ".join(f"g{c}{n} AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))) AS g FROM p WHERE len({c}) >= {n}) GROUP BY 1, 2, 3)" for c in "xy" for n in (1, 2))
_MATCH = ", ".join(f"m{n} AS (SELECT conv_id, turn, sum(least(a.c, b.c)) AS m{n} FROM gx{n} a JOIN gy{n} b USING (conv_id, turn, g) GROUP BY 1, 2)" for n in (1, 2))


@query("generation_metrics", rf"""WITH p AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[\p{{L}}]+') AS x, regexp_extract_all(lower(b.text), '[\p{{L}}]+') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
{_SIDES}, {_MATCH}, j AS (SELECT p.conv_id, p.turn, len(x) AS a, len(y) AS b, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2 FROM p LEFT JOIN m1 USING (conv_id, turn) LEFT JOIN m2 USING (conv_id, turn))
SELECT conv_id, turn, round(CASE WHEN a + b > 0 THEN 2.0::DOUBLE * m1 / (a + b) ELSE 0 END, 6) AS rouge1, round(CASE WHEN greatest(a - 1, 0) + greatest(b - 1, 0) > 0 THEN 2.0::DOUBLE * m2 / (greatest(a - 1, 0) + greatest(b - 1, 0)) ELSE 0 END, 6) AS rouge2,
  round(CASE WHEN a > 0 THEN exp(ln((m1 + 1e-9) / a) / 2 + ln((m2 + 1e-9) / greatest(a - 1, 1)) / 2 + least(0.0::DOUBLE, 1.0::DOUBLE - b / a)) ELSE 0 END, 6) AS bleu FROM j""")
def generation_metrics(t: Tables) -> DataFrame:
    """Every turn against the next one, as a prediction of it."""
    said = t.conversations.select("conv_id", "turn", "text")
    said = said.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    p = said.select("conv_id", "turn", T.words(F.col("text")).alias("x"), T.words(F.col("next")).alias("y"))
    return O.generation_scores(p, ["conv_id", "turn"]).select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "bleu")])


@query("compose_word")
def compose_word(t: Tables) -> DataFrame:
    """root + mean(prefixes) + mean(suffixes), with hashed vectors for the parts."""
    w = written(syntax.analysed_forms(made_sentences(t), roots(t)).select("w.radiko", "w.prefiksoj", "w.sufiksoj").distinct(), "words")
    # Parts are hashed once, however many words have them.
    part = lambda c, kind: w.select(F.explode(c).alias("part")) if kind else w.select(F.col(c).alias("part"))
    parts = part("radiko", False).union(part("prefiksoj", True)).union(part("sufiksoj", True)).distinct()
    vectors = written(parts.select("part", V.char_hash(F.col("part"), 32).alias("pv")), "parts")
    mean = lambda c: S.mean_pool(w.select("radiko", "prefiksoj", "sufiksoj", F.explode(c).alias("part")).join(vectors, "part"), ["radiko", "prefiksoj", "sufiksoj"], "pv")
    zero = F.array_repeat(F.lit(0.0), 32)
    rows = w.join(vectors.withColumnsRenamed({"part": "radiko", "pv": "rv"}), "radiko")
    for c in ("prefiksoj", "sufiksoj"):
        rows = rows.join(mean(c).withColumnRenamed("pv", f"{c}_v"), ["radiko", "prefiksoj", "sufiksoj"], "left")
    before, after = (F.coalesce(F.col(f"{c}_v"), zero) for c in ("prefiksoj", "sufiksoj"))
    return rows.select("radiko", "prefiksoj", "sufiksoj", V.add(V.add(F.col("rv"), before), after).alias("v"))


@query("compose_ways", f"""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS r, b.embedding::DOUBLE[] AS x, c.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2),
d AS (SELECT *, {_DOT('r', 'r')} / 8 AS sr, {_DOT('r', 'x')} / 8 AS sx, {_DOT('r', 'y')} / 8 AS sy FROM p), e AS (SELECT *, exp(sr - m) AS er, exp(sx - m) AS ex, exp(sy - m) AS ey FROM (SELECT *, greatest(sr, sx, sy) AS m FROM d)),
v AS (SELECT *, unnest(range(1, 65)) AS i FROM e)
SELECT vec_id, i, round(r[i] + (x[i] + y[i]) / 2, 5) + 0.0 AS sum, round((er * r[i] + ex * x[i] + ey * y[i]) / (er + ex + ey), 5) + 0.0 AS attention,
  round(r[i] + (x[i] / (1 + exp(-(0.5::DOUBLE * r[i] + 0.25::DOUBLE * x[i]))) + y[i] / (1 + exp(-(0.5::DOUBLE * r[i] + 0.25::DOUBLE * y[i])))) / 2, 5) + 0.0 AS gated FROM v""")
def compose_ways(t: Tables) -> DataFrame:
    """Root and affix vectors made into a word by sum, attention and gates; neighbours by id stand for the affixes."""
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = e.withColumnRenamed("v", "r")
    for k, name in ((1, "x"), (2, "y")):
        rows = rows.join(e.select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(name)), "vec_id")
    root, affixes = F.col("r"), F.array("x", "y")
    made = rows.select("vec_id", F.arrays_zip(V.compose_sum(root, affixes).alias("sum"), V.compose_attention(root, affixes).alias("attention"), V.compose_gated(root, affixes, 0.5, 0.25).alias("gated")).alias("z"))
    out = made.select("vec_id", F.posexplode("z").alias("p", "z")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), "z.*")
    return out.select("vec_id", "i", *[F.round(c, 5).alias(c) for c in ("sum", "attention", "gated")])


AFFIX = "m AS (SELECT vec_id % 12 AS affix, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2)"


@query("affix_similarity", f"WITH {AFFIX} SELECT a.affix AS a1, b.affix AS a2, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS cos FROM m a JOIN m b ON a.i = b.i AND a.affix < b.affix GROUP BY 1, 2")
def affix_similarity(t: Tables) -> DataFrame:
    """Similarity of affixes as the cosine of the mean vectors of their roots."""
    m = S.mean_pool(t.embeddings.withColumn("affix", F.col("vec_id") % 12), ["affix"], "embedding")
    b = m.toDF("a2", "vb")
    return m.toDF("a1", "va").join(b, F.col("a1") < F.col("a2")).select("a1", "a2", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cos"))  # one row for each affix


_DOC_WORDS = r"dw AS (SELECT doc_id AS sent_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\p{L}]+'), lambda w: replace(w, 'x', 'ks')), ' ') AS text FROM documents WHERE len(regexp_extract_all(lower(text), '[\p{L}]+')) > 0)"


@query("literary_sample", rf"""WITH {_DOC_WORDS}, {analysis_sql('dw', '')}, w AS (SELECT sent_id AS doc_id, count(*) AS n, count(*) FILTER (WHERE ok) AS good FROM wd GROUP BY 1)
SELECT source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '[.!?]+'))) AS BIGINT) AS n_sentences, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_words, CAST(sum(coalesce(good, 0)) AS BIGINT) AS n_parsed FROM documents LEFT JOIN w USING (doc_id) GROUP BY source""")
def literary_sample(t: Tables) -> DataFrame:
    """Sentences and parse success by source, over all words of all documents."""
    ws = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: F.replace(w, F.lit("x"), F.lit("ks")))
    words = syntax.parsed(t.documents.select(F.col("doc_id").alias("sent_id"), F.array_join(ws, " ").alias("text")), stems(t), fields=["parse_status"])
    good = F.size(F.filter("ws", lambda x: x["w"]["parse_status"] == "success"))
    parsed = words.select(F.col("sent_id").alias("doc_id"), F.size("ws").alias("n"), good.alias("good")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rows = t.documents.select("doc_id", "source", F.regexp_count("text", F.lit("[.!?]+")).cast("long").alias("s")).join(parsed, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("s").alias("n_sentences"), total("n").alias("n_words"), total("good").alias("n_parsed"))


@query("resume_point", "SELECT source, max(doc_id) AS last_id, count(*) AS processed FROM documents GROUP BY source")
def resume_point(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("processed"))

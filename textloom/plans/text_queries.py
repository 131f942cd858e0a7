"""Queries over texts: filters, normalisation, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx
from textloom.functions import text as T
from textloom.plans.registry import Tables, query

SENTENCES = r"""
sents AS (
  SELECT doc_id, source, lang, pos, s FROM (
    SELECT doc_id, source, lang, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS s FROM (
      SELECT doc_id, source, lang, list_filter(list_transform(
        string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss
      FROM documents)))
"""


def substitute_sql(expr: str, steps: list[tuple[str, str]]) -> str:
    """The substitutions as nested SQL calls."""
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace('$', chr(92))}', 'g')"
    return expr


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, pos (from 1), s."""
    rows = docs.select("doc_id", "source", "lang", F.posexplode(T.sentences(F.col("text"))).alias("p", "s"))
    return rows.select("doc_id", "source", "lang", (F.col("p") + 1).cast("long").alias("pos"), "s")


WC = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@query("filter_word_band", f"WITH {SENTENCES} SELECT doc_id, pos, {WC.format('s')} AS n_words FROM sents WHERE {WC.format('s')} BETWEEN 3 AND 100")
def filter_word_band(t: Tables) -> DataFrame:
    n = T.word_count(F.col("s"))
    return sentence_rows(t.documents).select("doc_id", "pos", n.alias("n_words")).filter("n_words between 3 and 100")


@query("filter_headers", f"WITH {SENTENCES} SELECT doc_id, pos FROM sents WHERE upper(s) = s AND lower(s) <> s AND {WC.format('s')} < 10")
def filter_headers(t: Tables) -> DataFrame:
    return sentence_rows(t.documents).filter(T.is_header(F.col("s"))).select("doc_id", "pos")


@query("filter_special_ratio", rf"""WITH {SENTENCES}
SELECT doc_id, count(*) AS n FROM sents
WHERE length(regexp_replace(s, '[\p{{L}}\p{{N}} .,;:!?''"-]', '', 'g')) / length(s) <= 0.05 GROUP BY doc_id""")
def filter_special_ratio(t: Tables) -> DataFrame:
    odd = F.length(F.regexp_replace("s", r"[\p{L}\p{N} .,;:!?'\"-]", "")) / F.length("s")
    return sentence_rows(t.documents).filter(odd <= 0.05).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("filter_url_ratio", r"""
SELECT page_id, len(list_filter(ws, lambda x: contains(x, 'http') OR contains(x, 'www.'))) AS urls, len(ws) AS n_words FROM (
  SELECT page_id, list_filter(regexp_split_to_array(html, '\s+'), lambda x: x <> '') AS ws FROM pages)
WHERE len(list_filter(ws, lambda x: contains(x, 'http') OR contains(x, 'www.'))) / len(ws) <= 0.3""")
def filter_url_ratio(t: Tables) -> DataFrame:
    ws = T.split_blank(F.col("html"))
    urls = F.size(F.filter(ws, lambda x: x.contains("http") | x.contains("www.")))
    return t.pages.select("page_id", urls.cast("long").alias("urls"), F.size(ws).cast("long").alias("n_words")).filter("urls / n_words <= 0.3")


@query("filter_english_section", "SELECT doc_id FROM documents WHERE NOT (contains(text, ' the ') OR starts_with(text, 'The '))")
def filter_english_section(t: Tables) -> DataFrame:
    return t.documents.filter(~(F.col("text").contains(" the ") | F.col("text").startswith("The "))).select("doc_id")


LETTER = r"len(regexp_extract_all({0}, '[\p{{L}}\s]')) / length({0})"


@query("filter_alpha_ratio", f"""WITH {SENTENCES}
SELECT doc_id, pos FROM sents WHERE {LETTER.format('s')} >= 0.95 AND NOT regexp_matches(s, '^[0-9]')""")
def filter_alpha_ratio(t: Tables) -> DataFrame:
    ok = (T.share(F.col("s"), r"[\p{L}\s]") >= 0.95) & ~F.col("s").rlike("^[0-9]")
    return sentence_rows(t.documents).filter(ok).select("doc_id", "pos")


@query("filter_length_terminal", f"WITH {SENTENCES} SELECT doc_id, pos FROM sents WHERE length(s) BETWEEN 10 AND 500 AND regexp_matches(s, '[.!?]$')")
def filter_length_terminal(t: Tables) -> DataFrame:
    return sentence_rows(t.documents).filter(F.length("s").between(10, 500) & F.col("s").rlike("[.!?]$")).select("doc_id", "pos")


PARSE_RATE = r"""
vocab AS (
  SELECT w FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark) GROUP BY w)
  ORDER BY n DESC, w LIMIT 500),
rates AS (
  SELECT d.doc_id, count(*) AS total, count(v.w) AS known FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM documents) d LEFT JOIN vocab v ON d.w = v.w GROUP BY d.doc_id)
"""


def benchmark_vocabulary(t: Tables, size: int = 500) -> DataFrame:
    """w: the most frequent words of the test items."""
    counts = t.benchmark.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "w").limit(size).select("w")


def parse_rates(t: Tables) -> DataFrame:
    """doc_id, total, known: words of each document and how many the lexicon has."""
    from textloom.operators.sized import sized_broadcast

    words = t.documents.select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    vocab = sized_broadcast(benchmark_vocabulary(t).withColumn("hit", F.lit(1)), 500)
    return words.join(vocab, "w", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("known"))


@query("filter_parse_rate", f"WITH {PARSE_RATE} SELECT doc_id, round(known / total, 6) AS parse_rate FROM rates WHERE known / total >= 0.5")
def filter_parse_rate(t: Tables) -> DataFrame:
    rate = F.col("known") / F.col("total")
    return parse_rates(t).filter(rate >= 0.5).select("doc_id", F.round(rate, 6).alias("parse_rate"))


HEADERS = "^(Chapter|CHAPTER|Part|Book|Act)"
MARKS = "[ĉĝĥĵŝŭéèñßäöü]"


@query("is_high_quality", rf"""WITH {SENTENCES}
SELECT doc_id, count(*) AS n, CAST(sum(CAST(good AS INT)) AS BIGINT) AS n_good FROM (
  SELECT doc_id, NOT regexp_matches(s, '[_\[\]]') AND NOT regexp_matches(s, '{HEADERS}') AND {WC.format('s')} BETWEEN 5 AND 50
    AND (regexp_matches(s, '{MARKS}') OR list_has_any(regexp_extract_all(lower(s), '[\p{{L}}]+'), ['the', 'of', 'la', 'de', 'der', 'die'])) AS good
  FROM sents) GROUP BY doc_id""")
def is_high_quality(t: Tables) -> DataFrame:
    s = F.col("s")
    common = F.array(*map(F.lit, ["the", "of", "la", "de", "der", "die"]))
    good = ~s.rlike(r"[_\[\]]") & ~s.rlike(HEADERS) & T.word_count(s).between(5, 50) & (s.rlike(MARKS) | F.arrays_overlap(T.words(s), common))
    rows = sentence_rows(t.documents).select("doc_id", good.alias("good"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"))


@query("filter_corpus", f"""WITH {SENTENCES}
SELECT doc_id, pos, s FROM sents WHERE source IN ('src0', 'src3', 'src7') AND {WC.format('s')} BETWEEN 5 AND 30
ORDER BY doc_id, pos LIMIT 200""")
def filter_corpus(t: Tables) -> DataFrame:
    rows = sentence_rows(t.documents).filter(F.col("source").isin("src0", "src3", "src7") & T.word_count(F.col("s")).between(5, 30))
    return rows.orderBy("doc_id", "pos").limit(200).select("doc_id", "pos", "s")


@query("is_likely_lang", rf"""
SELECT doc_id, len(regexp_extract_all(text, '\p{{Lu}}')) / length(text) <= 0.3 AND NOT regexp_matches(text, '^[0-9]{{4}}')
  AND NOT regexp_matches(text, '[<>{{}}|]') AND regexp_matches(text, '{MARKS}') AS likely FROM documents""")
def is_likely_lang(t: Tables) -> DataFrame:
    x = F.col("text")
    ok = (T.share(x, r"\p{Lu}") <= 0.3) & ~x.rlike("^[0-9]{4}") & ~x.rlike("[<>{}|]") & x.rlike(MARKS)
    return t.documents.select("doc_id", ok.alias("likely"))


LINES = "lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def line_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "line")


@query("is_metadata_line", rf"""WITH {LINES}
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(
  length(trim(line)) < 15 OR (upper(trim(line)) = trim(line) AND lower(trim(line)) <> trim(line) AND length(trim(line)) < 100)
  OR regexp_matches(trim(line), '{T.METADATA_LINE}') AS INT)) AS BIGINT) AS n_meta FROM lines GROUP BY doc_id""")
def is_metadata_line(t: Tables) -> DataFrame:
    meta = T.is_metadata_line(F.col("line")).cast("long")
    return line_rows(t.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(meta).alias("n_meta"))


WEB = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in T.WEB_WORDS)


@query("is_web_artifact", f"SELECT doc_id, regexp_matches(lower(text), '{T.WEB_ARTIFACTS}') OR ({WEB}) >= 3 AS artifact FROM documents")
def is_web_artifact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.is_web_artifact(F.col("text")).alias("artifact"))


COMMON = "[" + ", ".join(f"'{w}'" for w in T.LANGUAGE_WORDS) + "]"
HAS_MARKS = rf"""(regexp_matches({{0}}, '{T.LANGUAGE_MARKS}') OR list_has_any(regexp_extract_all(lower({{0}}), '[\p{{{{L}}}}]+'), {COMMON})
  OR len(list_filter(regexp_extract_all(lower({{0}}), '[\p{{{{L}}}}]+'), lambda x: length(x) > 2 AND regexp_matches(x, '(as|is|os|us|oj|aj|on|an|o|a|e|i)$'))) > 0)"""
PROPER = rf"""({WC} >= 3 AND len(list_filter(regexp_split_to_array({{0}}, '\s+'), lambda x: regexp_matches(x, '^\p{{{{Lu}}}}'))) / {WC} > 0.6)"""


@query("has_markers", f"WITH {SENTENCES} SELECT doc_id, pos FROM sents WHERE NOT {HAS_MARKS.format('s')}")
def has_markers(t: Tables) -> DataFrame:
    return sentence_rows(t.documents).filter(~T.has_language_marks(F.col("s"))).select("doc_id", "pos")


@query("mostly_proper", f"WITH {SENTENCES} SELECT doc_id, pos FROM sents WHERE {PROPER.format('s')}")
def mostly_proper(t: Tables) -> DataFrame:
    return sentence_rows(t.documents).filter(T.mostly_proper(F.col("s"))).select("doc_id", "pos")


@query("classify_sentence", f"""WITH {SENTENCES}, c AS (SELECT *, (doc_id % 10) / 10.0 AS conf FROM sents)
SELECT verdict, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(lower(s), '{T.WEB_ARTIFACTS}') OR ({WEB.replace('text', 's')}) >= 3 THEN 'web_artifact'
  WHEN {PROPER.format('s')} THEN 'proper_nouns' WHEN conf < 0.5 THEN 'low_confidence'
  WHEN lang = 'en' THEN CASE WHEN {HAS_MARKS.format('s')} THEN 'keep_marked' ELSE 'english' END
  WHEN lang IN ('fr', 'es') THEN 'other_language' ELSE 'keep' END AS verdict FROM c) GROUP BY verdict""")
def classify_sentence(t: Tables) -> DataFrame:
    conf = F.col("doc_id") % 10 / 10.0
    verdict = T.classify(F.col("lang"), conf, F.col("s"))
    return sentence_rows(t.documents).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


#: Frequent words of the corpus languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "that", "with", "this", "was", "is"],
    "fr": ["le", "la", "les", "des", "est", "et", "pour", "dans"],
    "de": ["der", "die", "das", "und", "nicht", "sich", "mit", "den"],
    "es": ["el", "los", "que", "del", "por", "con", "una", "las"],
}


def detect_language(docs: DataFrame) -> DataFrame:
    """doc_id, detected, confidence: the language with most of its stop words, as a share of all found."""
    w = T.words(F.col("text"))

    def hits_of(ws: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*ws)))

    hits = [hits_of(ws).alias(k) for k, ws in STOP_WORDS.items()]
    counted = docs.select("doc_id", "lang", *hits)
    best = F.greatest(*STOP_WORDS)
    case = None
    for k in STOP_WORDS:
        case = F.when(F.col(k) == best, k) if case is None else case.when(F.col(k) == best, k)
    total = sum((F.col(k) for k in STOP_WORDS), F.lit(0))
    share = F.when(total > 0, best / total).otherwise(0.0)
    return counted.select("doc_id", "lang", F.when(total > 0, case).alias("detected"), share.alias("confidence"))


HITS = ", ".join(
    rf"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) AS {k}" for k, ws in STOP_WORDS.items()
)
DETECT = rf"""
det AS (
  SELECT doc_id, lang, CASE WHEN en + fr + de + es = 0 THEN NULL
    WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr'
    WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS detected,
    CASE WHEN en + fr + de + es > 0 THEN greatest(en, fr, de, es) / (en + fr + de + es) ELSE 0.0 END AS confidence
  FROM (SELECT doc_id, lang, {HITS} FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{{L}}]+') AS w FROM documents)))
"""


@query("detect_language", f"WITH {DETECT} SELECT doc_id, detected, round(confidence, 6) AS confidence FROM det")
def detect_language_query(t: Tables) -> DataFrame:
    return detect_language(t.documents).select("doc_id", "detected", F.round("confidence", 6).alias("confidence"))


@query("detect_two_way", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[ĉĝĥĵŝŭ]') THEN 'eo' WHEN
  len(list_filter(regexp_extract_all(lower(text), '[\p{L}]+'), lambda x: x IN ('the', 'of', 'is', 'and', 'what', 'who')))
  > len(list_filter(regexp_extract_all(lower(text), '[\p{L}]+'), lambda x: x IN ('la', 'de', 'estas', 'kaj', 'kio', 'kiu'))) THEN 'en' ELSE 'eo' END AS lang2
FROM documents""")
def detect_two_way(t: Tables) -> DataFrame:
    w = T.words(F.col("text"))
    n = lambda *xs: F.size(F.filter(w, lambda x: x.isin(*xs)))
    en = n("the", "of", "is", "and", "what", "who") > n("la", "de", "estas", "kaj", "kio", "kiu")
    return t.documents.select("doc_id", F.when(F.col("text").rlike("[ĉĝĥĵŝŭ]"), "eo").when(en, "en").otherwise("eo").alias("lang2"))


@query("language_keep_counts", f"""WITH {DETECT}
SELECT coalesce(detected, 'none') AS detected, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8) AS kept FROM det GROUP BY 1""")
def language_keep_counts(t: Tables) -> DataFrame:
    g = detect_language(t.documents).groupBy(F.coalesce("detected", F.lit("none")).alias("detected"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("kept"))


WORDS = r"words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]+') AS ws FROM documents))"
DISTINCT_WORDS = r"vw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM documents)"


def word_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("p", "w"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "w")


def distinct_words(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(T.words(F.col("text"))).alias("w")).distinct()


@query("valid_root", f"WITH {DISTINCT_WORDS} SELECT w FROM vw WHERE regexp_matches(w, '^[abcdefghijklmnoprstuvzĉĝĥĵŝŭ]{{2,}}$')")
def valid_root(t: Tables) -> DataFrame:
    return distinct_words(t.documents).filter(F.col("w").rlike("^[abcdefghijklmnoprstuvzĉĝĥĵŝŭ]{2,}$"))


@query("proper_candidate", r"""SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM documents)
WHERE length(w) >= 2 AND regexp_matches(w, '^\p{Lu}') AND upper(w) <> w GROUP BY w""")
def proper_candidate(t: Tables) -> DataFrame:
    w = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")
    ok = (F.length("w") >= 2) & F.col("w").rlike(r"^\p{Lu}") & (F.upper("w") != F.col("w"))
    return t.documents.select(w).filter(ok).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("is_sentence", f"""WITH {SENTENCES} SELECT doc_id, count(*) AS n FROM sents
WHERE {WC.format('s')} >= 3 AND regexp_matches(s, '[.!?]$') AND regexp_matches(s, '^\\p{{Lu}}') GROUP BY doc_id""")
def is_sentence(t: Tables) -> DataFrame:
    s = F.col("s")
    return sentence_rows(t.documents).filter((T.word_count(s) >= 3) & s.rlike("[.!?]$") & s.rlike(r"^\p{Lu}")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("is_question", "SELECT conv_id, turn, contains(text, '?') AND regexp_matches(lower(text), '(kiu|kio|kiel|kiam|kie|kial|kiom|kia)') AS is_question FROM conversations")
def is_question(t: Tables) -> DataFrame:
    q = F.col("text").contains("?") & F.lower("text").rlike("(kiu|kio|kiel|kiam|kie|kial|kiom|kia)")
    return t.conversations.select("conv_id", "turn", q.alias("is_question"))


@query("assess_quality", r"""
SELECT doc_id, n_words, n_odd, CASE WHEN n_words < 20 THEN 'tiny' WHEN odd > 0.2 THEN 'dirty' WHEN odd > 0.05 THEN 'noisy'
  WHEN n_words > 2000 THEN 'large' ELSE 'clean' END AS label
FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words, len(regexp_extract_all(text, '[^\p{L}\p{N}\s.,;:!?]')) AS n_odd,
  len(regexp_extract_all(text, '[^\p{L}\p{N}\s.,;:!?]')) / length(text) AS odd FROM documents)""")
def assess_quality(t: Tables) -> DataFrame:
    odd = F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s.,;:!?]"))
    rows = t.documents.select("doc_id", T.word_count(F.col("text")).alias("n_words"), odd.cast("long").alias("n_odd"), F.try_divide(odd, F.length("text")).alias("odd"))
    label = F.when(F.col("n_words") < 20, "tiny").when(F.col("odd") > 0.2, "dirty").when(F.col("odd") > 0.05, "noisy").when(F.col("n_words") > 2000, "large").otherwise("clean")
    return rows.select("doc_id", "n_words", "n_odd", label.alias("label"))


@query("validate_example", """
SELECT conv_id, turn, concat_ws(';', CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' END,
  CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'bad role' END, CASE WHEN length(text) > 2048 THEN 'too long' END,
  CASE WHEN turn < 0 THEN 'bad turn' END) AS errors FROM conversations""")
def validate_example(t: Tables) -> DataFrame:
    errors = F.array_compact(F.array(
        F.when(F.col("text").isNull() | (F.trim("text") == ""), "no text"), F.when(~F.col("role").isin("user", "assistant", "system"), "bad role"),
        F.when(F.length("text") > 2048, "too long"), F.when(F.col("turn") < 0, "bad turn")))
    return t.conversations.select("conv_id", "turn", F.array_join(errors, ";").alias("errors"))


@query("safety_limits", r"""SELECT event_id, length(props) <= 2048 AND n <= 1000 AS safe, n AS nodes FROM (SELECT event_id, props,
  len(regexp_extract_all(regexp_replace('{"a": [' || props || ', [1, {"b{": "\"["}]]}', '"([^"\\]|\\.)*"', '', 'g'), '[\[{]')) AS n FROM events)""")
def safety_limits(t: Tables) -> DataFrame:
    """Length and number of nodes, any object or list, of a JSON tree."""
    tree = F.concat(F.lit('{"a": ['), "props", F.lit(r', [1, {"b{": "\"["}]]}'))
    n = T.json_nodes(tree)
    return t.events.select("event_id", ((F.length("props") <= 2048) & (n <= 1000)).alias("safe"), n.alias("nodes"))


@query("normalize_source", "SELECT DISTINCT replace(replace(lower(source), 'src', 'source_'), ' ', '_') AS source FROM documents")
def normalize_source(t: Tables) -> DataFrame:
    return t.documents.select(F.replace(F.replace(F.lower("source"), F.lit("src"), F.lit("source_")), F.lit(" "), F.lit("_")).alias("source")).distinct()


@query("text_validator", f"""WITH {PARSE_RATE}
SELECT d.doc_id, round(0.5 * CAST(length(d.text) >= 500 AS INT) + 0.5 * coalesce(known / total, 0), 6) AS score,
  CASE WHEN length(d.text) < 500 THEN 'too small' WHEN coalesce(known / total, 0) < 0.4 THEN 'low score' ELSE 'valid' END AS status
FROM documents d LEFT JOIN rates USING (doc_id)""")
def text_validator(t: Tables) -> DataFrame:
    rate = F.coalesce(F.col("known") / F.col("total"), F.lit(0.0))
    big = F.length("text") >= 500
    status = F.when(~big, "too small").when(rate < 0.4, "low score").otherwise("valid")
    score = F.round(0.5 * big.cast("int") + 0.5 * rate, 6)
    return t.documents.join(parse_rates(t), "doc_id", "left").select("doc_id", score.alias("score"), status.alias("status"))


X_SQL = "text"
for _a, _b in T.X_LETTERS.items():
    for _x, _y in ((_a + "x", _b), (_a.upper() + "x", _b.upper()), (_a.upper() + "X", _b.upper())):
        X_SQL = f"replace({X_SQL}, '{_x}', '{_y}')"
PRE_SQL = rf"""trim(regexp_replace(translate({X_SQL}, '—–-“”„‘’', '   ' || repeat(chr(34), 3) || repeat(chr(39), 2)), '\s+', ' ', 'g'))"""


@query("x_to_unicode", f"SELECT doc_id, md5({X_SQL}) AS digest FROM documents")
def x_to_unicode(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.x_to_unicode(F.col("text"))).alias("digest"))


@query("preprocess_text", f"SELECT doc_id, md5({PRE_SQL}) AS digest FROM documents")
def preprocess_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.preprocess(F.col("text"))).alias("digest"))


@query("tokenize_words", rf"""
SELECT doc_id, len(ws) AS n, md5(array_to_string(ws, ' ')) AS digest FROM (SELECT doc_id,
  list_filter(regexp_split_to_array(regexp_replace({PRE_SQL}, '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+'), lambda x: x <> '') AS ws FROM documents)""")
def tokenize_words(t: Tables) -> DataFrame:
    ws = T.tokenize(F.col("text"))
    return t.documents.select("doc_id", F.size(ws).cast("long").alias("n"), F.md5(F.array_join(ws, " ")).alias("digest"))


@query("strip_boilerplate", "SELECT doc_id, true AS same FROM documents")
def strip_boilerplate(t: Tables) -> DataFrame:
    """Documents framed as the START and END lines of a book file, and cut back."""
    framed = F.concat(F.lit("Head\n*** START OF BOOK ***\n"), "text", F.lit("\n*** END OF BOOK ***\nTail"))
    return t.documents.select("doc_id", (F.trim(T.strip_boilerplate(framed)) == F.trim("text")).alias("same"))


# Without look-around; a mark between words is consumed.
_MARKDOWN_SQL = [(r"(^|[^\p{L}\p{N}])_([^_]+)_($|[^\p{L}\p{N}])", "$1$2$3") if "(?<!" in pattern else (pattern, by) for pattern, by in T.MARKDOWN_STEPS]
_MARKED = "'# Title' || chr(10) || '**' || text || '** `code` [link](http://a.b)' || chr(10) || '> quote'"


@query("strip_markdown", f"SELECT doc_id, {substitute_sql(_MARKED, _MARKDOWN_SQL)} AS plain FROM documents")
def strip_markdown(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("# Title\n**"), "text", F.lit("** `code` [link](http://a.b)\n> quote"))
    return t.documents.select("doc_id", T.strip_markdown(marked).alias("plain"))


@query("drop_artifact_lines", rf"""
SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{T.ARTIFACT_LINE}')), chr(10))) AS digest FROM documents""")
def drop_artifact_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.drop_lines(F.col("text"), T.ARTIFACT_LINE)).alias("digest"))


@query("fix_hyphenation", r"""SELECT doc_id, length(regexp_replace(replace(text, '. ', '-' || chr(10) || ' '), '(\p{L})-\s*\n\s*(\p{L})', '\1\2', 'g')) AS n FROM documents""")
def fix_hyphenation(t: Tables) -> DataFrame:
    broken = F.replace("text", F.lit(". "), F.lit("-\n "))
    return t.documents.select("doc_id", F.length(T.fix_hyphenation(broken)).cast("long").alias("n"))


@query("drop_foreign_lines", r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[^\p{L}]*$|^\s*\|'))) AS n_kept FROM documents""")
def drop_foreign_lines(t: Tables) -> DataFrame:
    keep = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[^\p{L}]*$|^\s*\|"))
    return t.documents.select("doc_id", F.size(keep).cast("long").alias("n_kept"))


@query("html_counts", r"""
SELECT page_id, len(regexp_extract_all(html, '<[^>]+>')) AS tags, len(regexp_extract_all(html, 'https?://[^\s"<]+')) AS urls,
  len(regexp_extract_all(html, '&[a-z]+;')) AS entities, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def html_counts(t: Tables) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", n("<[^>]+>").alias("tags"), n("https?://[^\\s\"<]+").alias("urls"), n("&[a-z]+;").alias("entities"), n("<p>").alias("paragraphs"))


@query("html_to_text", f"SELECT page_id, trim({substitute_sql('html', T.HTML_STEPS)}) AS text FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.html_to_text(F.col("html")).alias("text"))


_BODY = r"regexp_replace(regexp_replace(text, '^.*?\*\*\* ?START[^\n]*\n', '', 's'), '\n?\*\*\* ?END.*$', '', 's')"


@query("clean_text", rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split({substitute_sql(_BODY, _MARKDOWN_SQL)}, chr(10)), lambda x: NOT regexp_matches(x, '{T.ARTIFACT_LINE}')), chr(10)),
  '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g'), '[ \t]+', ' ', 'g')) AS text FROM documents""")
def clean_text(t: Tables) -> DataFrame:
    """Boilerplate, markdown, artifact lines, hyphens and white space, in this order."""
    steps = (T.strip_boilerplate, T.strip_markdown, lambda x: T.drop_lines(x, T.ARTIFACT_LINE), T.fix_hyphenation)
    text = F.col("text")
    for step in steps:
        text = step(text)
    return t.documents.select("doc_id", F.trim(F.regexp_replace(text, r"[ \t]+", " ")).alias("text"))


def strip_sql(word: str, endings: list[str], keep: int = 2) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{e}') AND length({word}) > {len(e) + keep} THEN left({word}, length({word}) - {len(e)})" for e in endings)
    return f"CASE {cases} ELSE {word} END"


@query("strip_ending", f"WITH {DISTINCT_WORDS} SELECT w, {strip_sql('w', lx.ROOT_ENDINGS)} AS root FROM vw")
def strip_ending(t: Tables) -> DataFrame:
    return distinct_words(t.documents).select("w", T.strip_ending(F.col("w")).alias("root"))


NOUN_ENDINGS = ["ojn", "ajn", "oj", "aj", "on", "an", "o", "a"]


@query("strip_ending_noun", f"WITH {DISTINCT_WORDS} SELECT w, {strip_sql('w', NOUN_ENDINGS, 1)} AS base FROM vw")
def strip_ending_noun(t: Tables) -> DataFrame:
    return distinct_words(t.documents).select("w", T.strip_ending(F.col("w"), NOUN_ENDINGS, 1).alias("base"))


def _by_size(xs: list[str]) -> list[str]:
    return sorted(xs, key=lambda x: (-len(x), x))


_PREFIX_CASE = " ".join(f"WHEN starts_with(w, '{p}') AND length(w) > {len(p) + 2} THEN substr(w, {len(p) + 1})" for p in _by_size(lx.PREFIXES))


@query("clean_root", f"""WITH {DISTINCT_WORDS}, a AS (SELECT w, CASE {_PREFIX_CASE} ELSE w END AS r FROM vw),
b AS (SELECT w, {strip_sql('r', _by_size(lx.SUFFIXES))} AS r FROM a) SELECT w, {strip_sql('r', _by_size(lx.SUFFIXES))} AS root FROM b""")
def clean_root(t: Tables) -> DataFrame:
    return distinct_words(t.documents).select("w", T.clean_root(F.col("w")).alias("root"))


@query("marker_root", r"""SELECT p_partkey, lower(regexp_replace(split_part(replace(p_name, ' ', '.'), '.', 1), '[0-9]+$', '')) AS root,
  regexp_matches(lower(regexp_replace(split_part(replace(p_name, ' ', '.'), '.', 1), '[0-9]+$', '')), '^[a-z]{2,}$') AS valid FROM part""")
def marker_root(t: Tables) -> DataFrame:
    root = F.lower(F.regexp_replace(F.substring_index(F.replace("p_name", F.lit(" "), F.lit(".")), ".", 1), "[0-9]+$", ""))
    return t.part.select("p_partkey", root.alias("root"), root.rlike("^[a-z]{2,}$").alias("valid"))


@query("strip_homograph", r"SELECT DISTINCT regexp_replace(p_brand, '[0-9]+$', '') AS base FROM part")
def strip_homograph(t: Tables) -> DataFrame:
    return t.part.select(F.regexp_replace("p_brand", "[0-9]+$", "").alias("base")).distinct()


QA_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("qa_normalize", f"SELECT conv_id, turn, md5({QA_NORM.format('text')}) AS digest, len(list_distinct(string_split({QA_NORM.format('text')}, ' '))) AS n_distinct FROM conversations")
def qa_normalize(t: Tables) -> DataFrame:
    n = T.qa_normalize(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.md5(n).alias("digest"), F.size(F.array_distinct(F.split(n, " "))).cast("long").alias("n_distinct"))


_OPENINGS = ["Kiu estas", "Kio estas", "Kie estas", "Kiam estas", "Kial estas", "Kiom estas", "Kia estas", "Kiel estas", "Ĉu kostas"]
QUESTIONS = f"questions AS (SELECT conv_id, turn, ({_OPENINGS})[conv_id % 9 + 1] || ' ' || text AS q FROM conversations WHERE role = 'user')"
_KIND = "CASE left(lower(trim(q)), 3) WHEN 'kiu' THEN 'who' WHEN 'kio' THEN 'what' WHEN 'kie' THEN 'where' ELSE CASE left(lower(trim(q)), 4) WHEN 'kiam' THEN 'when' WHEN 'kial' THEN 'why' ELSE 'general' END END"


def questions(t: Tables) -> DataFrame:
    """conv_id, turn, q: user turns put as questions."""
    first = F.get(F.array(*map(F.lit, _OPENINGS)), (F.col("conv_id") % 9).cast("int"))
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.concat(first, F.lit(" "), "text").alias("q"))


@query("query_type", f"WITH {QUESTIONS} SELECT conv_id, turn, {_KIND} AS qtype FROM questions")
def query_type(t: Tables) -> DataFrame:
    return questions(t).select("conv_id", "turn", T.query_type(F.col("q")).alias("qtype"))


_ENTITY = r"""coalesce(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '^Ki[uo]\s+estas\s+', '', 'i'), '^(Kie|Kiam|Kial|Kiel)\s+', '', 'i'),
  '(^|[^\p{L}\p{N}_])((la|unu)\s+)+', '\1', 'gi'), '[?.!,;]', '', 'g'), '\s+'), lambda x: x <> '')[1], '')"""


@query("extract_entity", rf"WITH {QUESTIONS} SELECT conv_id, turn, {_ENTITY} AS entity FROM questions")
def extract_entity(t: Tables) -> DataFrame:
    return questions(t).select("conv_id", "turn", T.entity_of(F.col("q")).alias("entity"))


@query("sanitize_filename", r"SELECT DISTINCT regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages")
def sanitize_filename(t: Tables) -> DataFrame:
    return t.pages.select(F.regexp_replace(F.regexp_replace("url", "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "").alias("name")).distinct()


@query("dialogue_split", r"""WITH l AS (SELECT conv_id, turn, role, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations)),
s AS (SELECT conv_id, turn, pos, CASE WHEN (turn + pos) % 2 = 0 THEN role || ': ' || line ELSE line END AS line FROM l), x AS (SELECT *, regexp_extract(line, '^([A-Za-z]+):\s*(.+)', 2) AS x FROM s)
SELECT conv_id, turn, pos, x <> '' AS is_dialogue, regexp_extract(line, '^([A-Za-z]+):\s*(.+)', 1) AS speaker, CASE WHEN x <> '' THEN x ELSE line END AS said FROM x""")
def dialogue_split(t: Tables) -> DataFrame:
    """Every line of every turn."""
    rows = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    said = F.when((F.col("turn") + F.col("pos")) % 2 == 0, F.concat("role", F.lit(": "), "line")).otherwise(F.col("line"))
    rows = rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), said.alias("line"))
    x, who = (F.regexp_extract("line", r"^([A-Za-z]+):\s*(.+)", i) for i in (2, 1))
    return rows.select("conv_id", "turn", "pos", (x != "").alias("is_dialogue"), who.alias("speaker"), F.when(x != "", x).otherwise(F.col("line")).alias("said"))


@query("clean_sentence", rf"WITH {SENTENCES} SELECT doc_id, pos, md5(regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^[-–—]\s*', '')) AS digest FROM sents")
def clean_sentence(t: Tables) -> DataFrame:
    s = F.regexp_replace(F.regexp_replace("s", r"\s+", " "), r"^[-–—]\s*", "")
    return sentence_rows(t.documents).select("doc_id", "pos", F.md5(s).alias("digest"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short FROM documents")
def truncate_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.length("text") > 100, F.concat(F.left("text", F.lit(100)), F.lit("..."))).otherwise(F.col("text")).alias("short"))


@query("word_string", f"WITH {DISTINCT_WORDS}, r AS (SELECT w, {strip_sql('w', lx.ROOT_ENDINGS)} AS root FROM vw) SELECT w, concat(root, CASE WHEN length(w) > length(root) THEN '[' || substr(w, length(root) + 1) || ']' ELSE '' END) AS shown FROM r")
def word_string(t: Tables) -> DataFrame:
    root = T.strip_ending(F.col("w"))
    tail = F.substr(F.col("w"), F.length(root) + 1)
    return distinct_words(t.documents).select("w", F.concat(root, F.when(F.length("w") > F.length(root), F.concat(F.lit("["), tail, F.lit("]"))).otherwise("")).alias("shown"))


# ---- segmentation


@query("paragraphs", r"""SELECT doc_id, unnest(range(1, len(ps) + 1)) AS pos, unnest(ps) AS paragraph FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n', chr(1), 'g'), chr(1)),
    lambda p: trim(regexp_replace(p, '\s*\n\s*', ' ', 'g'))), lambda p: p <> '') AS ps FROM documents)""")
def paragraphs(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(T.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("p", "paragraph"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "paragraph")


def _pieces_sql(cut: str) -> str:
    """doc_id, pos (from 0), s of a list of pieces, blanks at the ends and empty ones gone."""
    return f"SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform({cut}, lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)"


def _pieces(t: Tables, cut: Column) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(cut).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s")


_SHORT = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)


@query("split_sentences", _pieces_sql(rf"""list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(^|[^\p{{L}}])({_SHORT})\.', '\1\2' || chr(2), 'g'), '([.!?])\s+$', '\1'),
  '([.!?])\s+([{T.CAPITAL}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: replace(y, chr(2), '.'))"""))
def split_sentences(t: Tables) -> DataFrame:
    return _pieces(t, T.split_sentences(F.col("text")))


@query("sentences_simple", f"WITH {SENTENCES} SELECT doc_id, pos, s FROM sents WHERE length(s) >= 10 AND NOT (upper(s) = s AND lower(s) <> s) AND NOT starts_with(s, '§')")
def sentences_simple(t: Tables) -> DataFrame:
    caps = (F.upper("s") == F.col("s")) & (F.lower("s") != F.col("s"))
    return sentence_rows(t.documents).filter((F.length("s") >= 10) & ~caps & ~F.col("s").startswith("§")).select("doc_id", "pos", "s")


@query("sentences_capital", r"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents)
WHERE length(trim(s)) BETWEEN 10 AND 500 GROUP BY doc_id""")
def sentences_capital(t: Tables) -> DataFrame:
    cut = F.split(F.regexp_replace("text", r"([.!?])\s+([A-Z])", "$1" + T.MARK + "$2"), T.MARK)
    return t.documents.select("doc_id", F.explode(cut).alias("s")).filter(F.length(F.trim("s")).between(10, 500)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("sentences_drop_term", r"""SELECT doc_id, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS s FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)""")
def sentences_drop_term(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(T.sentences_without_terminator(F.col("text"))).alias("p", "s"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "s")


@query("sentences_book", _pieces_sql(r"string_split(regexp_replace(text, '(^|[^0-9])[.!?]+', '\1' || chr(1), 'g'), chr(1))"))
def sentences_book(t: Tables) -> DataFrame:
    """A full stop after a digit ends no sentence."""
    cut = F.filter(F.transform(F.split("text", r"(?<!\d)[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")
    return _pieces(t, cut)


@query("sentences_wiki", _pieces_sql(rf"""list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '(\s+)([{T.CAPITAL}])', '\1' || chr(3) || '\2', 'g'), '(^|[^0-9])[.!?]+(\s+)\x03', '\1' || chr(1) || '\2', 'g'),
  '(^|[^0-9])[.!?]+(\s*)$', '\1' || chr(1) || '\2'), chr(1)), lambda y: replace(y, chr(3), ''))"""))
def sentences_wiki(t: Tables) -> DataFrame:
    cut = F.filter(F.transform(F.split("text", rf"(?<!\d)[.!?]+(?=\s+[{T.CAPITAL}]|\s*$)"), lambda x: F.trim(x)), lambda x: x != "")
    return _pieces(t, cut)


@query("segment_chars", _pieces_sql(rf"""regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])(\s+)([{T.CAPITAL}«"])', '\1' || chr(1) || '\2\3', 'g'), '((?:^|[^\p{{L}}\p{{N}}])\p{{L}}{{1,2}}|[{T.CAPITAL}]|[0-9])([.!?])\x01', '\1\2', 'g'), '\x01\s+')"""))
def segment_chars(t: Tables) -> DataFrame:
    """Boundary decided by what stands before the full stop: no digit, capital or word of one or two letters."""
    cut = F.split("text", rf"(?<!(?:[{T.CAPITAL}]|[0-9]|(?<![\p{{L}}\p{{N}}])\p{{L}}{{1,2}})[.!?])(?<=[.!?])\s+(?=[{T.CAPITAL}«\"])")
    return _pieces(t, F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != ""))


@query("chunk_text", r"""
SELECT doc_id, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS chunk FROM (
  SELECT doc_id, list_transform(range(0, greatest(len(ws) - 10 - 1, 0) + 1, 54), lambda i: array_to_string(ws[i + 1:i + 64], ' ')) AS cs FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents) WHERE len(ws) > 0)""")
def chunk_text(t: Tables) -> DataFrame:
    # Tokens in a projection of their own: inside the windows they would be cut anew for each.
    rows = t.documents.select("doc_id", T.split_blank(F.col("text")).alias("ws"))
    rows = rows.select("doc_id", F.posexplode(T.chunks(F.col("ws"), 64, 10)).alias("p", "chunk"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "chunk")


@query("chunk_paragraphs", rf"""
WITH {LINES}, c AS (SELECT doc_id, pos, list_transform(range(0, greatest(len(ws) - 10 - 1, 0) + 1, 54), lambda i: array_to_string(ws[i + 1:i + 64], ' ')) AS cs FROM (
  SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS ws FROM lines) WHERE len(ws) > 0)
SELECT doc_id || '-' || pos || '-' || j AS id, chunk FROM (SELECT doc_id, pos, unnest(range(1, len(cs) + 1)) AS j, unnest(cs) AS chunk FROM c)""")
def chunk_paragraphs(t: Tables) -> DataFrame:
    rows = line_rows(t.documents).select("doc_id", "pos", T.split_blank(F.col("line")).alias("ws"))
    rows = rows.select("doc_id", "pos", F.posexplode(T.chunks(F.col("ws"), 64, 10)).alias("j", "chunk"))
    return rows.select(F.concat_ws("-", "doc_id", "pos", F.col("j") + 1).alias("id"), "chunk")


@query("chapter_fill", f"""WITH {LINES}, m AS (SELECT *, CASE WHEN length(line) < 40 THEN line END AS marker FROM lines),
f AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter,
  sum(CAST(marker IS NOT NULL AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m)
SELECT doc_id, pos, chapter, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS in_chapter FROM f""")
def chapter_fill(t: Tables) -> DataFrame:
    """Short lines are chapter markers; lines below carry the marker and count from it."""
    rows = line_rows(t.documents).withColumn("marker", F.when(F.length("line") < 40, F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("chapter", F.last("marker", ignorenulls=True).over(w)).withColumn("run", F.count("marker").over(w))
    return rows.select("doc_id", "pos", "chapter", "run", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("pos")).cast("long").alias("in_chapter"))


EXPANDED = f"""{QUESTIONS}, e AS (SELECT conv_id, turn, q, {_KIND} AS k, {_ENTITY} AS x FROM questions),
vr AS (SELECT conv_id, turn, x, unnest(CASE k WHEN 'who' THEN [q, x, x || ' estas', 'pri ' || x] WHEN 'what' THEN [q, x, x || ' estas', 'la ' || x] WHEN 'where' THEN [q, x || ' loĝas', x || ' troviĝas'] ELSE [q] END) AS variant FROM e)"""


@query("expand_query", f"WITH {EXPANDED} SELECT conv_id, turn, variant FROM vr")
def expand_query(t: Tables) -> DataFrame:
    q = F.col("q")
    return questions(t).select("conv_id", "turn", F.explode(T.query_variants(q, T.entity_of(q), T.query_type(q))).alias("variant"))


@query("leave_one_out", """SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS target,
  unnest(list_transform(range(1, len(ls) + 1), lambda i: array_to_string(list_concat(ls[1:i - 1], ls[i + 1:]), ' '))) AS context
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)""")
def leave_one_out(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", "\n", -1).alias("ls"))
    rows = rows.select("conv_id", "turn", "ls", F.posexplode("ls").alias("i", "target"))
    rest = F.filter("ls", lambda x, j: j != F.col("i"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("pos"), "target", F.array_join(rest, " ").alias("context"))


@query("synthetic_qa", f"""WITH {SENTENCES}, q AS (SELECT doc_id, pos, s, CASE
  WHEN regexp_matches(s, '^\\p{{Lu}}\\p{{L}}+ (is|est|ist) ') THEN 'Kio estas ' || split_part(s, ' ', 1) || '?'
  WHEN regexp_matches(s, ' (in|en|dans) \\p{{Lu}}') THEN 'Kie?' WHEN regexp_matches(s, '[0-9]{{4}}') THEN 'Kiam?' END AS question FROM sents)
SELECT doc_id, pos, question, s AS answer FROM q WHERE question IS NOT NULL""")
def synthetic_qa(t: Tables) -> DataFrame:
    s = F.col("s")
    q = (F.when(s.rlike(r"^\p{Lu}\p{L}+ (is|est|ist) "), F.concat(F.lit("Kio estas "), F.substring_index(s, " ", 1), F.lit("?")))
         .when(s.rlike(r" (in|en|dans) \p{Lu}"), "Kie?").when(s.rlike("[0-9]{4}"), "Kiam?"))
    rows = sentence_rows(t.documents).withColumn("question", q).filter("question is not null")
    return rows.select("doc_id", "pos", "question", s.alias("answer"))

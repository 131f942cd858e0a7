"""Queries over analysed sentences.

The fixture texts are no Esperanto, so the words of every conversation turn are
put into the grammar of the language, five to a sentence, as stems. The lexicon
is data: the words of ``benchmark``. With whole stems (``STEMS``) the analysis
can be stated in SQL; queries on affixes and compounds use them as roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx
from textloom.functions import morphology as M
from textloom.operators import syntax as S
from textloom.plans.registry import Tables, query

OPENINGS = [None, "Ĉu", "Kiam", "Morgaŭ"]
TENSES = ["as", "is", "os", "us"]
STEM = r"replace(unnest(regexp_extract_all(lower(text), '[\p{L}]+')), 'x', 'ks')"

SENT_SQL = rf"""gr AS (SELECT conv_id, turn, unnest(range(0, CAST(ceil(len(ws) / 5) AS BIGINT))) AS k, ws FROM (
  SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text), '[\p{{L}}]+'), lambda w: replace(w, 'x', 'ks')) AS ws FROM conversations)),
es AS (SELECT conv_id || '-' || turn || '-' || k AS sent_id, concat_ws(' ', CASE (turn + k) % 4 WHEN 1 THEN 'Ĉu' WHEN 2 THEN 'Kiam' WHEN 3 THEN 'Morgaŭ' END, 'La', ws[5 * k + 1] || 'a', ws[5 * k + 2] || 'o',
  CASE WHEN k % 5 = 0 THEN 'ne' END, ws[5 * k + 3] || ['as', 'is', 'os', 'us'][k % 4 + 1], CASE WHEN k % 3 = 0 THEN 'la' END, ws[5 * k + 4] || 'ajn', ws[5 * k + 5] || 'ojn', 'kun Xyzo.') AS text FROM gr)"""


def made_sentences(t: Tables) -> DataFrame:
    """sent_id, text: all words of all turns."""
    ws = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: F.replace(w, F.lit("x"), F.lit("ks")))
    # A turn costs far more than its bytes, so turns are dealt out evenly.
    dealt = t.conversations.repartition(int(t.conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    turns = dealt.select("conv_id", "turn", ws.alias("ws")).filter("size(ws) > 0")
    groups = turns.select("conv_id", "turn", "ws", F.explode(F.sequence(F.lit(0), (F.ceil(F.size("ws") / 5) - 1).cast("int"))).alias("k"))
    k = F.col("k")
    word = lambda i, end: F.concat(F.get("ws", 5 * k + i), end if not isinstance(end, str) else F.lit(end))
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), (at % len(xs)).cast("int"))
    text = F.concat_ws(
        " ", pick(OPENINGS, F.col("turn") + k), F.lit("La"), word(0, "a"), word(1, "o"), F.when(k % 5 == 0, "ne"), word(2, pick(TENSES, k)),
        F.when(k % 3 == 0, "la"), word(3, "ajn"), word(4, "ojn"), F.lit("kun Xyzo."))
    return groups.select(F.concat_ws("-", "conv_id", "turn", "k").alias("sent_id"), text.alias("text"))


def entries(t: Tables, kind: str) -> DataFrame:
    """The words of ``benchmark`` as a dictionary."""
    ws = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    return t.benchmark.select(ws.alias("w")).select(F.replace("w", F.lit("x"), F.lit("ks")).alias("root"), F.lit(kind).alias("kind")).distinct()


def stems(t: Tables) -> M.Lexicon:
    return M.load_lexicon(entries(t, "protected"), affixes=False)


def roots(t: Tables) -> M.Lexicon:
    """The same words as roots; those of two to four letters are the founding ones."""
    return M.load_lexicon(entries(t, "root").union(entries(t, "fundamental").filter("length(root) between 2 and 4")))


def tokens(t: Tables) -> DataFrame:
    rows = made_sentences(t).select("sent_id", F.posexplode(F.split(F.replace("text", F.lit("."), F.lit("")), " ")).alias("pos", "token"))
    return rows.select("sent_id", F.col("pos").cast("long").alias("pos"), "token")


def roles(t: Tables) -> DataFrame:
    """(sent_id, ws array of words with roles)."""
    return S.with_roles(S.parsed(made_sentences(t), stems(t)))


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


CLOSED_SQL = f"CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'numero' WHEN lower(token) = 'la' THEN 'artikolo' WHEN regexp_replace(lower(token), 'n$', '') IN {_in(lx.PRONOUNS)} THEN 'pronomo' " + " ".join(
    f"WHEN lower(token) IN {_in(forms)} THEN '{pos}'" for pos, forms in M.CLOSED) + " END"
_E = lambda i: "CASE e " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in lx.ENDINGS.items() if v[i]) + " END"


def analysis_sql(src: str, n: str) -> str:
    """CTEs from sentences ``src`` (sent_id, text) to roles ``rol<n>``, for whole stems."""
    return rf"""tok{n} AS (SELECT sent_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS token FROM (SELECT sent_id, string_split(replace(text, '.', ''), ' ') AS ws FROM {src})),
fa{n} AS (SELECT DISTINCT token, lower(token) AS w FROM tok{n}), fb{n} AS (SELECT *, ends_with(w, 'n') AND length(w) > 2 AS acc, CASE WHEN ends_with(w, 'n') AND length(w) > 2 THEN left(w, -1) ELSE w END AS w1 FROM fa{n}),
fc{n} AS (SELECT *, ends_with(w1, 'j') AND length(w1) > 2 AS plu, CASE WHEN ends_with(w1, 'j') AND length(w1) > 2 THEN left(w1, -1) ELSE w1 END AS w2 FROM fb{n}),
fd{n} AS (SELECT *, CASE WHEN regexp_matches(w2, '^..+(as|is|os|us)$') THEN right(w2, 2) WHEN regexp_matches(w2, '^.+[uioae]$') THEN right(w2, 1) ELSE '' END AS e,
  CASE WHEN ends_with(w, 'n') THEN left(w, -1) ELSE w END AS bare, {CLOSED_SQL} AS closed FROM fc{n}),
lex{n} AS (SELECT DISTINCT {STEM} AS r FROM benchmark),
fe{n} AS (SELECT *, left(w2, length(w2) - length(e)) AS stem, {_E(0)} AS p, {_E(1)} AS t, {_E(2)} AS m, w IN {_in(lx.CORRELATIVES)} AS c1, bare IN {_in(lx.CORRELATIVES)} AS c2 FROM fd{n}),
ff{n} AS (SELECT *, closed IS NULL AND NOT c1 AND NOT c2 AND (r IS NOT NULL OR stem IN {_in(lx.NUMBERS + lx.PARTICLES + lx.PREPOSITIONS)}) AS known, regexp_matches(token, '^\p{{Lu}}') AND length(token) > 1 AS cap FROM fe{n} LEFT JOIN lex{n} ON r = stem),
an{n} AS (SELECT token, stem, closed IS NOT NULL OR c1 OR c2 OR known AS ok,
  CASE WHEN closed = 'pronomo' THEN bare WHEN closed IS NOT NULL OR c1 THEN w WHEN c2 THEN bare WHEN known THEN stem ELSE token END AS radiko,
  CASE WHEN closed IS NOT NULL THEN closed WHEN c1 OR c2 THEN 'korelativo' WHEN known THEN coalesce(p, 'nekonata') WHEN cap THEN 'propra_nomo' WHEN length(token) = 1 THEN 'ekzemplo' ELSE 'fremda_vorto' END AS vortspeco,
  CASE WHEN known AND acc OR (closed = 'pronomo' OR c2 AND NOT c1) AND w <> bare OR closed IS NULL AND NOT c1 AND NOT c2 AND NOT known AND cap AND regexp_matches(token, 'on$|ojn$') THEN 'akuzativo' ELSE 'nominativo' END AS kazo,
  CASE WHEN known AND plu OR closed IS NULL AND NOT c1 AND NOT c2 AND NOT known AND cap AND regexp_matches(token, 'oj$|ojn$') THEN 'pluralo' ELSE 'singularo' END AS nombro,
  CASE WHEN known THEN t END AS tempo, CASE WHEN known THEN m END AS modo, CASE WHEN (c1 OR c2) AND closed IS NULL THEN regexp_extract(w, '^(neni|ki|ti|ĉi|i)', 1) END AS kp,
  CASE WHEN cap AND regexp_matches(token, '(o|on|oj|ojn)$') THEN 'proper_name_esperantized' WHEN cap THEN 'proper_name' WHEN length(token) = 1 THEN 'single_letter' ELSE 'foreign_word' END AS category FROM ff{n}),
wd{n} AS (SELECT sent_id, pos, an{n}.* FROM tok{n} JOIN an{n} USING (token)),
pl{n} AS (SELECT *, min(CASE WHEN vortspeco = 'verbo' THEN pos END) OVER (PARTITION BY sent_id) AS v, min(CASE WHEN vortspeco IN ('substantivo', 'pronomo') AND kazo = 'akuzativo' THEN pos END) OVER (PARTITION BY sent_id) AS o,
  min(CASE WHEN vortspeco IN ('substantivo', 'pronomo') AND kazo = 'nominativo' THEN pos END) OVER (PARTITION BY sent_id) AS s, lag(radiko) OVER (PARTITION BY sent_id ORDER BY pos) AS before,
  min(CASE WHEN vortspeco <> 'adjektivo' THEN pos END) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM wd{n}),
rol{n} AS (SELECT x.*, CASE WHEN x.pos = x.v THEN 'verbo' WHEN x.pos = x.o THEN 'objekto' WHEN x.pos = x.s THEN 'subjekto' WHEN x.vortspeco = 'artikolo' THEN 'artikolo'
  WHEN x.vortspeco = 'adjektivo' AND x.kazo = ob.kazo AND x.nombro = ob.nombro THEN 'objekto_priskribo' WHEN x.vortspeco = 'adjektivo' AND x.kazo = su.kazo AND x.nombro = su.nombro THEN 'subjekto_priskribo' ELSE 'aliaj' END AS role,
  x.pos = coalesce(x.v, -1) AND coalesce(x.before = 'ne', false) AS negated, ar.nxt IS NOT NULL AND x.vortspeco IN ('substantivo', 'pronomo') AS has_article
  FROM pl{n} x LEFT JOIN wd{n} ob ON ob.sent_id = x.sent_id AND ob.pos = x.o LEFT JOIN wd{n} su ON su.sent_id = x.sent_id AND su.pos = x.s
  LEFT JOIN (SELECT DISTINCT sent_id, nxt FROM pl{n} WHERE vortspeco = 'artikolo') ar ON ar.sent_id = x.sent_id AND ar.nxt = x.pos)"""


_END = "CASE vortspeco WHEN 'verbo' THEN coalesce(CASE tempo WHEN 'prezenco' THEN 'as' WHEN 'pasinteco' THEN 'is' WHEN 'futuro' THEN 'os' END, CASE modo WHEN 'kondicionalo' THEN 'us' WHEN 'imperativo' THEN 'u' WHEN 'infinitivo' THEN 'i' END) WHEN 'substantivo' THEN 'o' WHEN 'adjektivo' THEN 'a' WHEN 'adverbo' THEN 'e' END"


def deparse_sql(n: str) -> str:
    """CTE ``dp<n>`` (sent_id, text) of roles ``rol<n>``."""
    return rf"""pc{n} AS (SELECT sent_id, CASE role WHEN 'subjekto_priskribo' THEN 1 WHEN 'subjekto' THEN 2 WHEN 'verbo' THEN 3 WHEN 'objekto_priskribo' THEN 4 WHEN 'objekto' THEN 5 ELSE 6 END AS k, pos,
  CASE WHEN vortspeco = 'propra_nomo' THEN token ELSE radiko || coalesce({_END}, '') || CASE WHEN nombro = 'pluralo' THEN 'j' ELSE '' END || CASE WHEN kazo = 'akuzativo' THEN 'n' ELSE '' END END AS s FROM rol{n} WHERE role <> 'artikolo'
  UNION ALL SELECT sent_id, CASE role WHEN 'subjekto' THEN 1 ELSE 4 END, -1, 'la' FROM rol{n} WHERE has_article AND role IN ('subjekto', 'objekto')),
dp{n} AS (SELECT sent_id, replace(upper(left(x, 1)), 'ẞ', 'SS') || substr(x, 2) || '.' AS text FROM (SELECT sent_id, string_agg(s, ' ' ORDER BY k, pos, s) AS x FROM pc{n} GROUP BY sent_id))"""


TOKENS_SQL = rf"{SENT_SQL}, tok AS (SELECT sent_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS token FROM (SELECT sent_id, string_split(replace(text, '.', ''), ' ') AS ws FROM es))"
ROLES_SQL = f"{SENT_SQL}, {analysis_sql('es', '')}"


@query("closed_class", f"WITH {TOKENS_SQL} SELECT token, {CLOSED_SQL} AS vortspeco, count(*) AS n FROM tok GROUP BY 1, 2")
def closed_class(t: Tables) -> DataFrame:
    return tokens(t).groupBy("token", M.closed_class(F.col("token")).alias("vortspeco")).agg(F.count(F.lit(1)).alias("n"))


_CORR = "(VALUES " + ", ".join(f"('{c}')" for c in lx.CORRELATIVES) + ") v(w)"


@query("correlatives", f"""SELECT w, p AS prefikso, substr(w, length(p) + 1) AS sufikso, CASE p {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.CORRELATIVE_PREFIXES.items())} END AS signifo
FROM (SELECT w, regexp_extract(w, '^(neni|ki|ti|ĉi|i)', 1) AS p FROM {_CORR})""")
def correlatives(t: Tables) -> DataFrame:
    rows = t.region.limit(1).select(F.explode(F.array(*map(F.lit, lx.CORRELATIVES))).alias("w"))
    return rows.select("w", M.correlative(F.col("w")).alias("c")).select("w", "c.prefikso", "c.sufikso", "c.signifo")


INFLECTION_SQL = f"""a AS (SELECT DISTINCT token, lower(token) AS w FROM tok), b AS (SELECT *, ends_with(w, 'n') AND length(w) > 2 AS acc, CASE WHEN ends_with(w, 'n') AND length(w) > 2 THEN left(w, -1) ELSE w END AS w1 FROM a),
c AS (SELECT *, ends_with(w1, 'j') AND length(w1) > 2 AS plu, CASE WHEN ends_with(w1, 'j') AND length(w1) > 2 THEN left(w1, -1) ELSE w1 END AS w2 FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(w2, '^..+(as|is|os|us)$') THEN right(w2, 2) WHEN regexp_matches(w2, '^.+[uioae]$') THEN right(w2, 1) ELSE '' END AS e FROM c)"""


@query("inflection", f"WITH {TOKENS_SQL}, {INFLECTION_SQL} SELECT token, left(w2, length(w2) - length(e)) AS stem, {_E(0)} AS vortspeco, {_E(1)} AS tempo, {_E(2)} AS modo, CASE WHEN plu THEN 'pluralo' ELSE 'singularo' END AS nombro, CASE WHEN acc THEN 'akuzativo' ELSE 'nominativo' END AS kazo FROM d")
def inflection(t: Tables) -> DataFrame:
    return tokens(t).select("token").distinct().select("token", M.inflection(F.col("token")).alias("i")).select("token", "i.*")


@query("categorize_unknown", r"""SELECT w, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'number_literal' WHEN regexp_matches(w, '^\p{Lu}') AND length(w) > 1 AND w IN ('The', 'And') THEN 'proper_name_known'
  WHEN regexp_matches(w, '^\p{Lu}') AND length(w) > 1 AND regexp_matches(w, '(o|on|oj|ojn)$') THEN 'proper_name_esperantized' WHEN regexp_matches(w, '^\p{Lu}') AND length(w) > 1 THEN 'proper_name'
  WHEN length(w) = 1 THEN 'single_letter' ELSE 'foreign_word' END AS category FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM documents)""")
def categorize_unknown(t: Tables) -> DataFrame:
    ws = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).distinct()
    return ws.select("w", M.unknown_category(F.col("w"), F.col("w").isin("The", "And")).alias("category"))


@query("proper_lookup", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM benchmark), b AS (SELECT w, regexp_replace(w, '(ojn|oj|on|o)$', '') AS base FROM w WHERE regexp_matches(w, '^\p{Lu}'))
SELECT w, coalesce(s.k, d.k, 'unknown') AS found FROM b LEFT JOIN (SELECT DISTINCT left(p_brand, 3) AS x, 'static' AS k FROM part) s ON s.x = base LEFT JOIN (SELECT 'The' AS x, 'dynamic' AS k) d ON d.x = base""")
def proper_lookup(t: Tables) -> DataFrame:
    """Static names before dynamic ones."""
    w = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).distinct().filter(F.col("w").rlike(r"^\p{Lu}"))
    static = t.part.select(F.left("p_brand", F.lit(3)).alias("base")).distinct().withColumn("s", F.lit("static"))
    rows = w.withColumn("base", F.regexp_replace("w", "(ojn|oj|on|o)$", "")).join(static, "base", "left")
    return rows.select("w", F.coalesce("s", F.when(F.col("base") == "The", "dynamic"), F.lit("unknown")).alias("found"))


@query("parse_words")
def parse_words(t: Tables) -> DataFrame:
    """All fields of every word of every document, failed ones included, with affixes and compounds; no SQL states those."""
    ws = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("token")).distinct()
    return ws.withColumn("w", M.word_udf(roots(t))(F.col("token"))).select("w.*")


@query("parse_sentences", f"WITH {ROLES_SQL} SELECT sent_id, pos, token AS plena_vorto, radiko, vortspeco, role, has_article, negated FROM rol")
def parse_sentences(t: Tables) -> DataFrame:
    return S.flat(roles(t)).select("sent_id", F.col("pos").cast("long").alias("pos"), "w.plena_vorto", "w.radiko", "w.vortspeco", "role", "has_article", "negated")


@query("sentence_type", f"""WITH {ROLES_SQL} SELECT sent_id, CASE WHEN cu OR ki THEN 'demando' WHEN command THEN 'ordono' ELSE 'deklaro' END AS fraztipo, CASE WHEN cu THEN 'ĉu' WHEN ki THEN 'ki' END AS demandotipo, negita FROM (
  SELECT sent_id, bool_or(radiko = 'ĉu') AS cu, bool_or(coalesce(kp = 'ki', false)) AS ki, bool_or(role = 'verbo' AND coalesce(modo = 'imperativo', false)) AS command, bool_or(radiko = 'ne' OR starts_with(radiko, 'neni')) AS negita FROM rol GROUP BY sent_id)""")
def sentence_type(t: Tables) -> DataFrame:
    return S.sentence_types(roles(t)).select("sent_id", "fraztipo", "demandotipo", "negita")


@query("parse_stats", f"WITH {ROLES_SQL} SELECT sent_id, count(*) AS total_words, count(*) FILTER (WHERE ok) AS esperanto_words, round(count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate FROM rol GROUP BY sent_id")
def parse_stats(t: Tables) -> DataFrame:
    return S.sentence_types(roles(t)).select("sent_id", "total_words", "esperanto_words", F.round("success_rate", 6).alias("success_rate"))


@query("failure_categories", f"WITH {ROLES_SQL} SELECT category, count(*) AS n FROM rol WHERE NOT ok GROUP BY category")
def failure_categories(t: Tables) -> DataFrame:
    return S.failure_categories(S.analysed_forms(made_sentences(t), stems(t)))


@query("deparse", f"WITH {ROLES_SQL}, {deparse_sql('')} SELECT sent_id, text FROM dp")
def deparse(t: Tables) -> DataFrame:
    return S.deparse(roles(t))


@query("reparse_stats", f"""WITH {ROLES_SQL}, {deparse_sql('')}, {analysis_sql('dp', '2')},
a AS (SELECT sent_id, list_sort(list(radiko)) AS r FROM rol WHERE role <> 'artikolo' GROUP BY sent_id), b AS (SELECT sent_id, list_sort(list(radiko)) AS r FROM rol2 WHERE role <> 'artikolo' GROUP BY sent_id)
SELECT count(*) AS n, count(*) FILTER (WHERE a.r = b.r) AS same FROM a JOIN b USING (sent_id)""")
def reparse_stats(t: Tables) -> DataFrame:
    """For how many sentences the analysis of the analysis' own text gives the same roots."""
    lexicon = stems(t)
    sorted_roots = F.sort_array(F.transform(F.filter("ws", lambda x: x["role"] != "artikolo"), lambda x: x["w"]["radiko"]))
    # The roots of the first analysis travel with the sentence, as part of its id.
    one = S.with_roles(S.parsed(made_sentences(t), lexicon)).select("sent_id", "ws", sorted_roots.alias("a")).filter("size(a) > 0")
    again = S.parsed(one.select(F.struct("sent_id", "a").alias("sent_id"), S.deparsed(F.col("ws")).alias("text")), lexicon)
    both = S.with_roles(again).select("sent_id.a", sorted_roots.alias("b")).filter("size(b) > 0")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("words")
def words(t: Tables) -> DataFrame:
    """With affixes and compounds; no SQL states those."""
    return S.analyse(made_sentences(t), roots(t)).select("sent_id", "pos", "w.radiko", "w.vortspeco", "w.prefiksoj", "w.sufiksoj")


@query("content_roots", f"WITH {ROLES_SQL} SELECT radiko, count(*) AS n FROM rol WHERE vortspeco IN {_in(list(S.CONTENT))} GROUP BY radiko")
def content_roots(t: Tables) -> DataFrame:
    return S.count_of(S.analysed_forms(made_sentences(t), stems(t)).filter(F.col("w.vortspeco").isin(*S.CONTENT)), F.col("w.radiko"))


@query("word_affixes")
def word_affixes(t: Tables) -> DataFrame:
    w = S.analysed_forms(made_sentences(t), roots(t))
    known = F.array(*map(F.lit, lx.PREFIXES + lx.SUFFIXES))
    return w.select("n", "w.radiko", F.explode(F.array_intersect(F.concat("w.prefiksoj", "w.sufiksoj"), known)).alias("affix")).groupBy("affix", "radiko").agg(F.sum("n").alias("n"))


def _slot_sql(role: str, name: str, mods: str) -> str:
    at = lambda c: f"max(CASE WHEN role = '{role}' THEN {c} END)"
    return (
        f"'{name.upper()}:' || concat_ws('|', 'role={name}', 'root=' || coalesce({at('radiko')}, ''), 'pos=' || coalesce({at('vortspeco')}, ''), "
        f"CASE WHEN {at('vortspeco')} <> 'verbo' THEN 'num=' || {at('nombro')} END, CASE WHEN {at('vortspeco')} <> 'verbo' THEN 'case=' || {at('kazo')} END, 'tense=' || {at('tempo')}, 'mood=' || {at('modo')}, "
        f"'mods=' || coalesce(array_to_string(list_sort(list(radiko) FILTER (WHERE role = '{mods}')), ','), ''))"
    )


SIG_SQL = f"sg AS (SELECT sent_id, {_slot_sql('subjekto', 'subj', 'subjekto_priskribo')} || ';' || {_slot_sql('verbo', 'verb', '-')} || ';' || {_slot_sql('objekto', 'obj', 'objekto_priskribo')} AS signature, " + (
    "concat_ws(',', max(CASE WHEN role = 'subjekto' THEN radiko END), max(CASE WHEN role = 'verbo' THEN radiko END), max(CASE WHEN role = 'objekto' THEN radiko END)) AS roots FROM rol GROUP BY sent_id)")
GT_SQL = f"""gt AS (SELECT sent_id, string_agg(concat_ws(' ', 'root:' || radiko, 'ending:' || {_END}, 'pos:' || vortspeco, 'num:' || nombro, 'case:' || kazo, 'tense:' || tempo, 'mood:' || modo), ' ' ORDER BY pos) AS grammar_tokens FROM rol WHERE role <> 'artikolo' GROUP BY sent_id)"""


@query("slot_signature", f"WITH {ROLES_SQL}, {SIG_SQL} SELECT sent_id, signature FROM sg")
def slot_signature(t: Tables) -> DataFrame:
    return S.signatures(roles(t)).select("sent_id", "signature")


@query("grammar_tokens", f"WITH {ROLES_SQL}, {GT_SQL} SELECT sent_id, grammar_tokens FROM gt")
def grammar_tokens(t: Tables) -> DataFrame:
    return S.signatures(roles(t)).select("sent_id", F.array_join("grammar_tokens", " ").alias("grammar_tokens"))


@query("structural_meta", f"WITH {ROLES_SQL}, {SIG_SQL}, {GT_SQL} SELECT sent_id, signature, CAST(len(string_split(grammar_tokens, ' ')) AS BIGINT) AS n_tokens, roots FROM sg JOIN gt USING (sent_id)")
def structural_meta(t: Tables) -> DataFrame:
    roots_ = F.array_join(F.map_values("slot_roots"), ",")
    return S.signatures(roles(t)).select("sent_id", "signature", F.size("grammar_tokens").cast("long").alias("n_tokens"), roots_.alias("roots"))


@query("ast_edges", f"""WITH {ROLES_SQL}, k AS (SELECT CASE role WHEN 'subjekto' THEN 'has_subject' WHEN 'verbo' THEN 'has_verb' WHEN 'objekto' THEN 'has_object' WHEN 'subjekto_priskribo' THEN 'modifies' WHEN 'objekto_priskribo' THEN 'modifies' WHEN 'aliaj' THEN 'has_modifier' END AS edge_type FROM rol
  UNION ALL SELECT 'has_article' FROM rol WHERE has_article AND role IN ('subjekto', 'objekto')) SELECT edge_type, count(*) AS n FROM k WHERE edge_type IS NOT NULL GROUP BY edge_type""")
def ast_edges(t: Tables) -> DataFrame:
    return S.graph_edges(roles(t)).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("explanations", f"WITH {ROLES_SQL} SELECT sent_id, string_agg(role || ' = ' || radiko || ' (' || vortspeco || ')', '; ' ORDER BY pos) AS text FROM rol GROUP BY sent_id")
def explanations(t: Tables) -> DataFrame:
    said = lambda x: F.concat_ws(" ", x["role"], F.lit("="), x["w"]["radiko"], F.concat(F.lit("("), x["w"]["vortspeco"], F.lit(")")))
    return roles(t).select("sent_id", F.array_join(F.transform("ws", said), "; ").alias("text"))


@query("failure_stems", f"WITH {ROLES_SQL} SELECT stem, count(*) AS n FROM rol WHERE NOT ok GROUP BY stem HAVING count(*) >= 2")
def failure_stems(t: Tables) -> DataFrame:
    w = S.analysed_forms(made_sentences(t), stems(t)).filter("w.parse_status = 'failed'")
    return S.count_of(w, F.regexp_extract("w.parse_error", "rest '(.*)'", 1).alias("stem")).filter("n >= 2")


@query("problem_log", f"WITH {ROLES_SQL} SELECT token, 'failed' AS status, count(*) AS n FROM rol WHERE NOT ok GROUP BY token")
def problem_log(t: Tables) -> DataFrame:
    """Words that failed, the analysis of each held to ten seconds."""
    return S.problems(S.analysed_forms(made_sentences(t), stems(t), seconds=10.0)).select("token", "status", "n")

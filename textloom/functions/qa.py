"""Question analysis, reranking and answer extraction as columns. No UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx
from textloom.functions import text as T

WORD = "[a-zĉĝĥĵŝŭ]+"
NAME = "[A-ZĈĜĤĴŜŬa-zĉĝĥĵŝŭ][a-zĉĝĥĵŝŭA-ZĈĜĤĴŜŬ]+"
NOT_WORD_BEFORE, NOT_WORD_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

#: Unicode classes and boundaries, any case, only the line feed ends a line.
FLAGS = "(?iUd)"

# Weighted signs of each answer type.
TYPE_PATTERNS = {
    "person": [(r"[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+(?:\s+[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+)?", 0.3), (r"\b(homo|persono|viro|virino|ulo|ano)\b", 0.2)],
    "thing": [(r"estas\s+\w+", 0.2), (r"\b(afero|objekto|ilo|aĵo)\b", 0.1)],
    "time": [
        (r"\b(1[89]\d{2}|20[0-2]\d)\b", 0.4), (r"\b(en|dum|post|antaŭ)\s+(la\s+)?(jar|monat|tag)", 0.3),
        (r"\b(januaro|februaro|marto|aprilo|majo|junio|julio|aŭgusto|septembro|oktobro|novembro|decembro)\b", 0.2),
    ],
    "location": [(r"\b(en|ĉe|sur|sub)\s+[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+", 0.3), (r"\b(urbo|lando|loko|regiono|mondo)\b", 0.1)],
    "manner": [(r"\b(per|uzante|kun|laŭ)\s+\w+", 0.2), (r"\w+e\b", 0.1)],
    "reason": [(r"\b(ĉar|pro|tial|sekve)\b", 0.3), (r"\b(kaŭzo|kialo|motivo)\b", 0.2)],
    "quantity": [(r"\b\d+\b", 0.3), (r"\b(unu|du|tri|kvar|kvin|ses|sep|ok|naŭ|dek|cent|mil)\b", 0.2), (r"\b(multe|malmulte|kelkaj|ĉiuj)\b", 0.1)],
    "quality": [(r"\w+a\b", 0.1)],
}


def question_attribute(question: Column, which: int, default: str | float) -> Column:
    """type (1), role (2) or weight (3) of the first question word that begins the question."""
    case, q = None, F.lower(F.trim(question))
    for row in lx.QUESTION_WORDS:
        hit = q.startswith(row[0])
        case = F.when(hit, row[which]) if case is None else case.when(hit, row[which])
    return case.otherwise(default)


def key_roots(question: Column) -> Column:
    ws = F.filter(F.regexp_extract_all(F.lower(question), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*lx.QUESTION_STOP))
    return F.filter(F.transform(ws, lambda w: T.strip_ending(w)), lambda r: F.length(r) > 2)


def has_word_ending(text: Column, ending: str) -> Column:
    return F.lower(text).rlike(rf"[\p{{L}}\p{{N}}_]{ending}{NOT_WORD_AFTER}")


def number_of(question: Column) -> Column:
    return F.when(has_word_ending(question, "oj"), "plural").otherwise("singular")


def tense_of(question: Column) -> Column:
    return F.when(has_word_ending(question, "is"), "past").when(has_word_ending(question, "os"), "future").otherwise("present")


def score_type(doc: Column, kind: Column) -> Column:
    """Weighted signs of the expected type, each counted three times at most; 1 at most."""
    case = None
    for name, patterns in TYPE_PATTERNS.items():
        total = F.lit(0.0)
        for pattern, weight in patterns:
            total = total + F.lit(weight) * F.least(F.regexp_count(doc, F.lit(FLAGS + pattern)), F.lit(3))
        case = F.when(kind == name, F.least(F.lit(1.0), total)) if case is None else case.when(kind == name, F.least(F.lit(1.0), total))
    return case.otherwise(0.0)


def score_grammar(doc: Column, number: Column, tense: Column) -> Column:
    ws = F.regexp_extract_all(F.lower(doc), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    n = lambda e: F.size(F.filter(ws, lambda w: F.endswith(w, F.lit(e)) & (F.length(w) > len(e))))
    by_number = F.when(number == "plural", F.when(n("oj") > 0, 0.5).otherwise(0.0)).otherwise(F.when(n("o") >= n("oj"), 0.3).otherwise(0.0))
    by_tense = F.when(tense == "past", F.when(n("is") > 0, 0.5).otherwise(0.0)).when(tense == "future", F.when(n("os") > 0, 0.5).otherwise(0.0)).otherwise(0.3)
    return F.least(F.lit(1.0), by_number + by_tense)


def score_entity(doc_roots: Column, roots: Column) -> Column:
    """Share of the key roots that a word of the text contains, common roots counted less."""
    common = F.create_map(*[F.lit(x) for kv in lx.COMMON_ROOT_WEIGHTS.items() for x in kv])
    found = F.filter(roots, lambda r: F.exists(doc_roots, lambda d: F.contains(d, r)))
    total = F.aggregate(found, F.lit(0.0), lambda s, r: s + 1.0 - F.coalesce(F.try_element_at(common, r), F.lit(0.0)))
    return F.when(F.size(roots) > 0, F.least(F.lit(1.0), total / F.size(roots))).otherwise(0.0)


def score_role(doc: Column, role: Column, kind: Column) -> Column:
    low = F.lower(doc)
    subject = F.when((kind == "person") & doc.rlike(r"^[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+"), 0.5).otherwise(0.0) + F.when(low.rlike(r"^(la\s+)?[\p{L}]+o\s+(est|far|dir|vid)"), 0.3).otherwise(0.0)
    other = F.when(low.rlike(NOT_WORD_BEFORE + r"(en|sur|sub|ĉe|per|kun|por|al)\s"), 0.3).otherwise(0.0)
    return F.when(role == "subjekto", F.least(F.lit(1.0), subject)).when(role == "objekto", F.when(has_word_ending(doc, "n"), 0.4).otherwise(0.0)).when(role == "aliaj", other).otherwise(0.0)


def combined(kind: Column, grammar: Column, entity: Column, role: Column, original: Column) -> Column:
    return 0.6 * (0.3 * kind + 0.2 * grammar + 0.3 * entity + 0.2 * role) + 0.4 * original


# Fixed values: (pattern, group, confidence) by question type, tried in order.
ANSWER_PATTERNS = {
    "thing": [(r"(\w+)\s+estas\s+(.+?)\.", 2, 0.8), (r",\s*tio\s+estas\s+(.+?)\.", 1, 0.7), (r"(\w+)\s+signifas\s+(.+?)\.", 2, 0.7), (r"(\w+)\s+nomiĝas\s+(.+?)\.", 2, 0.7)],
    "person": [(r"(\w+(?:\s+\w+)?)\s+fondis\s+", 1, 0.9), (r"(\w+(?:\s+\w+)?)\s+kreis\s+", 1, 0.9), (r"estis\s+(?:fondita|kreita)\s+de\s+(\w+(?:\s+\w+)?)", 1, 0.8), (r"^de\s+(\w+(?:\s+\w+)?)", 1, 0.6)],
    "time": [(r"en\s+(?:la\s+jaro\s+)?(\d{4})", 1, 0.9), (r"en\s+(\d{4})", 1, 0.9), (r"la\s+(\d{1,2})[—-]?an?\s+de\s+(\w+)", 0, 0.8), (r"\b(1[89]\d{2}|20[0-2]\d)\b", 1, 0.5)],
    "location": [(r"en\s+([A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+(?:\s+[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+)?)", 1, 0.8), (r"ĉe\s+([A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+)", 1, 0.7)],
    "quantity": [(r"(\d+(?:\s*\d+)*)", 1, 0.7), (r"(unu|du|tri|kvar|kvin|ses|sep|ok|naŭ|dek|cent|mil)", 1, 0.6)],
    "manner": [(r"per\s+(.+?)(?:\.|,|$)", 1, 0.7), (r"uzante?\s+(.+?)(?:\.|,|$)", 1, 0.7)],
    "reason": [(r"ĉar\s+(.+?)(?:\.|$)", 1, 0.8), (r"pro\s+(.+?)(?:\.|,|$)", 1, 0.7)],
}
UNKNOWN = "Mi ne scias."


def pattern_answer(sentence: Column, kind: Column, terms: Column) -> Column:
    """struct(answer, confidence) of the first pattern that matches; 0.1 more for each term held."""
    low = F.lower(sentence)
    held = F.size(F.filter(terms, lambda x: F.contains(low, x)))
    branches = []
    for name, patterns in ANSWER_PATTERNS.items():
        for pattern, group, conf in patterns:
            found = F.trim(F.regexp_extract(sentence, FLAGS + pattern, group))
            made = F.struct(found.alias("answer"), F.round(F.least(F.lit(1.0), conf + 0.1 * held), 6).alias("confidence"))
            branches.append(F.when((kind == name) & sentence.rlike(FLAGS + pattern), made))
    return F.coalesce(*branches)


def key_terms(question: Column) -> Column:
    """Words of three letters or more, without stop words and the first occurrence of each question word."""
    stop = ["la", "de", "en", "kaj", "al", "por", "kun", "ĉu", "estas"]
    ws = F.filter(F.regexp_extract_all(F.lower(question), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.filter(ws, lambda w, i: ~(w.isin(*[q for q, *_ in lx.QUESTION_WORDS]) & (F.array_position(ws, w) == i + 1)))


def unanswerable(question: Column) -> Column:
    """Questions about what no text of the corpus tells."""
    hits = [F.lower(question).contains(w) for w in lx.UNANSWERABLE]
    return hits[0] | hits[1] | hits[2]


def shortened(answer: Column, longest: int = 150) -> Column:
    return F.when(F.length(answer) > longest, F.concat(F.left(answer, F.lit(longest)), F.lit("..."))).otherwise(answer)


def shortened_sentence(sentence: Column, terms: Column, longest: int = 150) -> Column:
    """A long sentence gives way to its first clause that holds a term."""
    clauses = F.split(sentence, "[,;:]")
    holding = F.filter(clauses, lambda c: F.exists(terms, lambda x: F.contains(F.lower(c), x)))
    clause = F.coalesce(F.trim(F.get(holding, 0)), sentence)
    return F.when(F.length(sentence) > longest, shortened(clause, longest)).otherwise(sentence)


def sentence_score(sentence: Column, kind: Column, terms: Column) -> Column:
    low = F.lower(sentence)
    s = 0.2 * F.size(F.filter(terms, lambda x: F.contains(low, x)))
    s = s + F.when((kind == "thing") & low.contains("estas"), 0.1).otherwise(0.0)
    s = s + F.when((kind == "time") & sentence.rlike(r"(?U)\d{4}"), 0.2).otherwise(0.0)
    s = s + F.when(kind == "person", 0.1 * F.regexp_count(sentence, F.lit("[A-ZĈĜĤĴŜŬ][a-zĉĝĥĵŝŭ]+"))).otherwise(0.0)
    s = s - F.when(T.word_count(sentence) < 5, 0.1).otherwise(0.0)
    for phrase in lx.NEGATIVE_PHRASES:
        s = s - F.when(low.contains(phrase), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two sets of tokens; 1 if both are empty, 0 if they share nothing."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))

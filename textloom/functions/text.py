"""Column functions for normalising, screening and cutting text. No UDF."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx

#: X-notation of the six letters with diacritics.
X_LETTERS = {"c": "ĉ", "g": "ĝ", "h": "ĥ", "j": "ĵ", "s": "ŝ", "u": "ŭ"}
MARK = "\u0001"


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))


def split_blank(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def share(text: Column, pattern: str) -> Column:
    """Characters that match, as a share of the length; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(F.lit(0.0))


def x_to_unicode(text: Column) -> Column:
    for a, b in X_LETTERS.items():
        for x, y in ((a + "x", b), (a.upper() + "x", b.upper()), (a.upper() + "X", b.upper())):
            text = F.replace(text, F.lit(x), F.lit(y))
    return text


def preprocess(text: Column) -> Column:
    """x-notation, three kinds of dashes, curly quotes, white space."""
    text = F.translate(x_to_unicode(text), "—–-“”„‘’", "   \"\"\"''")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenize(text: Column) -> Column:
    """Words after punctuation is taken for blanks."""
    return split_blank(F.translate(preprocess(text), ASCII_PUNCTUATION, " " * len(ASCII_PUNCTUATION)))


def fix_hyphenation(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{L}])-\s*\n\s*([\p{L}])", "$1$2")


def drop_lines(text: Column, pattern: str) -> Column:
    """The text without the lines that match."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(pattern)), "\n")


#: Lines that are no prose (rules, page numbers, addresses, illustrations).
ARTIFACT_LINE = r"^\s*(\[?[Ii]llustration.*|[-=_*]{3,}|[Pp]age\s+[0-9]+|[0-9]+)\s*$|https?://|www\."
METADATA_LINE = r"^(Produced by|Title:|Author:|Release Date|Language:|Copyright|\*\*\*|Chapter [0-9]+|[IVXLC]+\.?$|[0-9]+$)"
WEB_ARTIFACTS = r"cookie|javascript|click here|sign in|log in|subscribe|all rights reserved|privacy policy|<[a-z]+|http|www\.|@"
WEB_WORDS = ["menu", "home", "search", "login", "contact", "share", "tweet", "comment", "next", "previous", "page", "site", "link", "download", "help"]


def is_header(text: Column) -> Column:
    """All capitals and fewer than ten words."""
    return (F.upper(text) == text) & (F.lower(text) != text) & (word_count(text) < 10)


def is_metadata_line(line: Column) -> Column:
    t = F.trim(line)
    return (F.length(t) < 15) | ((F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) < 100)) | t.rlike(METADATA_LINE)


def is_web_artifact(text: Column) -> Column:
    t = F.lower(text)
    hits = reduce(lambda a, b: a + b, [t.contains(w).cast("int") for w in WEB_WORDS])
    return t.rlike(WEB_ARTIFACTS) | (hits >= 3)


def mostly_proper(text: Column) -> Column:
    """At least three words, more than 0.6 of them capitalised."""
    n = word_count(text)
    caps = F.size(F.filter(split_blank(text), lambda w: w.rlike(r"^\p{Lu}")))
    return (n >= 3) & (caps / n > 0.6)


#: Signs of the language.
LANGUAGE_MARKS = r"[ĉĝĥĵŝŭĈĜĤĴŜŬ]"
LANGUAGE_WORDS = ["kaj", "la", "de", "en", "estas", "ne", "al", "por", "kun", "mi", "vi", "li", "ni", "ili"]


#: In lower case: a letter of the language, a word of three letters or more with one of its endings, or one of its words.
#: No look behind: it takes letters beyond the first plane for two characters.
LANGUAGE_SIGNS = (
    r"[ĉĝĥĵŝŭ]|\p{L}(?:\p{L}[oaei]|[aiou]s|[oa][jn])(?!\p{L})|(?:^|\P{L})(?:" + "|".join(LANGUAGE_WORDS) + r")(?!\p{L})"
)


def has_language_marks(text: Column) -> Column:
    """One search that ends at the first sign, not lists of words."""
    return F.lower(text).rlike(LANGUAGE_SIGNS)


def classify(lang: Column, confidence: Column, text: Column) -> Column:
    """Ordered decision on a sentence: keep, or why it goes."""
    return (
        F.when(is_web_artifact(text), "web_artifact")
        .when(mostly_proper(text), "proper_nouns")
        .when(confidence < 0.5, "low_confidence")
        .when(lang == "en", F.when(has_language_marks(text), "keep_marked").otherwise("english"))
        .when(lang.isin("fr", "es"), "other_language")
        .otherwise("keep")
    )


def strip_ending(word: Column, endings: Sequence[str] = tuple(lx.ROOT_ENDINGS), keep: int = 2) -> Column:
    """The word without the first ending that leaves more than ``keep`` letters."""
    case = None
    for e in endings:
        fits = F.endswith(word, F.lit(e)) & (F.length(word) > len(e) + keep)
        cut = F.left(word, F.length(word) - len(e))
        case = F.when(fits, cut) if case is None else case.when(fits, cut)
    return case.otherwise(word)


def clean_root(word: Column) -> Column:
    """One prefix, then up to two suffixes, longest first, while three letters stay."""
    by_size = lambda xs: "|".join(sorted(xs, key=lambda x: (-len(x), x)))
    out = F.regexp_replace(word, f"^(?:{by_size(lx.PREFIXES)})(.{{3,}})$", "$1")
    for _ in range(2):
        out = F.regexp_replace(out, f"^(.{{3,}}?)(?:{by_size(lx.SUFFIXES)})$", "$1")
    return out


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + MARK), MARK)
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def sentences_without_terminator(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+\s+"), lambda x: F.trim(x)), lambda x: x != "")


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["d-ro", "s-ro", "s-ino", "prof", "dr", "k.t.p", "ktp", "t.e", "ekz", "vd", "n-ro", "p"]
CAPITAL = "A-ZĈĜĤĴŜŬ"


def split_sentences(text: Column) -> Column:
    """Sentences before a capital, abbreviations protected."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    text = F.regexp_replace(text, rf"(?iu)(^|[^\p{{L}}])({short})\.", "$1$2\u0002")
    cut = F.split(text, rf"(?<=[.!?])\s+(?=[{CAPITAL}]|$)")
    return F.filter(F.transform(cut, lambda x: F.trim(F.replace(x, F.lit("\u0002"), F.lit(".")))), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, each on one line."""
    cut = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.filter(cut, lambda p: p != "")


def chunks(tokens: Column, size: int = 512, overlap: int = 50) -> Column:
    """Overlapping windows of tokens; the last one reaches the end."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


#: Mark-up, in the order of removal.
HTML_STEPS = [
    (r"(?s)<!--.*?-->", " "), (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?s)<[^>]+>", " "),
    (r"&nbsp;", " "), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", "\""), (r"&#?[a-zA-Z0-9]+;", " "),
    (r"https?://\S+", " "), (r"\{\{[^}]*\}\}", " "), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"\s+", " "),
]
MARKDOWN_STEPS = [
    (r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^#{1,6}\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"),
    (r"(?<![\p{L}\p{N}])_([^_]+)_(?![\p{L}\p{N}])", "$1"), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^>\s?", ""), (r"(?m)^[-*_]{3,}\s*$", ""),
]


def substitute(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def html_to_text(html: Column) -> Column:
    return F.trim(substitute(html, HTML_STEPS))


def strip_markdown(text: Column) -> Column:
    return substitute(text, MARKDOWN_STEPS)


def strip_boilerplate(text: Column) -> Column:
    """What stands between the *** START and *** END lines, if they exist."""
    body = F.regexp_replace(text, r"(?s)^.*?\*\*\* ?START[^\n]*\n", "")
    return F.regexp_replace(body, r"(?s)\n?\*\*\* ?END.*$", "")


def qa_normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def json_nodes(tree: Column) -> Column:
    """Objects and lists in a JSON text; brackets inside strings don't count."""
    return F.regexp_count(F.regexp_replace(tree, r'"(?:[^"\\\\]|\\\\.)*"', ""), F.lit(r"[\[{]")).cast("long")


def query_type(question: Column) -> Column:
    """who, what, where, when, why, how or general, by how the query begins."""
    case, q = None, F.lower(F.trim(question))
    for w, kind in lx.QUERY_KINDS:
        case = F.when(q.startswith(w), kind) if case is None else case.when(q.startswith(w), kind)
    return case.otherwise("general")


def entity_of(question: Column) -> Column:
    """First word after the question's opening, articles and punctuation are gone; empty if there is none."""
    out = question
    for opening in (r"Kiu\s+estas\s+", r"Kio\s+estas\s+", r"Kie\s+", r"Kiam\s+", r"Kial\s+", r"Kiel\s+"):
        out = F.regexp_replace(out, "(?iU)^" + opening, "")
    out = F.regexp_replace(out, r"(?iU)\b(la|unu)\s+", "")
    return F.coalesce(F.get(split_blank(F.regexp_replace(out, "[?.!,;]", "")), 0), F.lit(""))


def query_variants(question: Column, entity: Column, kind: Column) -> Column:
    """The query and what a search for its entity may ask besides."""
    with_ = lambda *parts: F.array(question, *parts)
    say = lambda before, after: F.concat(F.lit(before), entity, F.lit(after))
    return (
        F.when(kind == "who", with_(entity, say("", " estas"), say("pri ", ""))).when(kind == "what", with_(entity, say("", " estas"), say("la ", "")))
        .when(kind == "where", with_(say("", " loĝas"), say("", " troviĝas"))).otherwise(with_())
    )


"""Morphology: closed classes and inflection as columns, full word analysis as an Arrow UDF.

The UDF is meant for distinct words; ``textloom.operators.syntax.analyse``
joins its result back to the text.
"""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx

WORD_TYPE = (
    "plena_vorto string, radiko string, vortspeco string, nombro string, kazo string, tempo string, modo string, "
    "prefiksoj array<string>, sufiksoj array<string>, kunmetitaj_radikoj array<string>, elidita boolean, "
    "korelativo_prefikso string, korelativo_sufikso string, korelativo_signifo string, participo_vocho string, "
    "participo_tempo string, parse_status string, parse_error string, category string"
)

#: Classes of uninflected words in the order of trial.
CLOSED = [("konjunkcio", lx.CONJUNCTIONS), ("prepozicio", lx.PREPOSITIONS), ("partiklo", lx.PARTICLES), ("numero", lx.NUMBERS)]


def closed_class(word: Column) -> Column:
    """Part of speech of numerals, the article, pronouns (also accusative) and uninflected words; else null."""
    w = F.lower(word)
    case = F.when(word.rlike("^[0-9]+$"), "numero").when(w == "la", "artikolo").when(F.regexp_replace(w, "n$", "").isin(*lx.PRONOUNS), "pronomo")
    for pos, forms in CLOSED:
        case = case.when(w.isin(*forms), pos)
    return case


def correlative(word: Column) -> Column:
    """struct(radiko, prefikso, sufikso, signifo) of a correlative, also accusative; else null."""
    base = F.when(F.lower(word).isin(*lx.CORRELATIVES), F.lower(word)).otherwise(F.regexp_replace(F.lower(word), "n$", ""))
    prefix = F.regexp_extract(base, "^(neni|ki|ti|ĉi|i)", 1)
    meaning = F.create_map(*[F.lit(x) for kv in lx.CORRELATIVE_PREFIXES.items() for x in kv])
    made = F.struct(base.alias("radiko"), prefix.alias("prefikso"), F.substr(base, F.length(prefix) + 1).alias("sufikso"), F.try_element_at(meaning, prefix).alias("signifo"))
    return F.when(base.isin(*lx.CORRELATIVES), made)


def inflection(word: Column) -> Column:
    """struct(stem, vortspeco, tempo, modo, nombro, kazo) after -n, -j and the ending are cut."""
    w = F.lower(word)
    accusative = F.endswith(w, F.lit("n")) & (F.length(w) > 2)
    w1 = F.when(accusative, F.left(w, F.length(w) - 1)).otherwise(w)
    plural = F.endswith(w1, F.lit("j")) & (F.length(w1) > 2)
    w2 = F.when(plural, F.left(w1, F.length(w1) - 1)).otherwise(w1)
    ending = F.regexp_extract(w2, "^..+(as|is|os|us)$", 1)
    ending = F.when(ending != "", ending).otherwise(F.regexp_extract(w2, "^.+([uioae])$", 1))
    feature = [F.create_map(*[F.lit(x) for k, v in lx.ENDINGS.items() if v[i] for x in (k, v[i])]) for i in range(3)]
    pos, tense, mood = (F.try_element_at(m, ending) for m in feature)
    return F.struct(
        F.left(w2, F.length(w2) - F.length(ending)).alias("stem"), pos.alias("vortspeco"), tense.alias("tempo"), mood.alias("modo"),
        F.when(plural, "pluralo").otherwise("singularo").alias("nombro"), F.when(accusative, "akuzativo").otherwise("nominativo").alias("kazo"))


def unknown_category(word: Column, known_name: Column) -> Column:
    """Category of a word that is not of the language; ``known_name`` tells dictionary names."""
    capital = word.rlike(r"^\p{Lu}") & (F.length(word) > 1)
    return (
        F.when(word.rlike("^[0-9]+$"), "number_literal").when(capital & known_name, "proper_name_known")
        .when(capital & word.rlike("(o|on|oj|ojn)$"), "proper_name_esperantized").when(capital, "proper_name")
        .when(F.length(word) == 1, "single_letter").otherwise("foreign_word")
    )


@dataclass
class Lexicon:
    """Root sets: all known ones, those of the founding vocabulary, those that look affixed but are not.

    ``affixes`` False makes it a list of whole stems: nothing is taken off but endings.
    """

    roots: frozenset[str] = frozenset()
    fundamental: frozenset[str] = frozenset()
    protected: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    affixes: bool = True
    _prefixes: list[str] = field(init=False)
    _suffixes: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self._prefixes = sorted(lx.PREFIXES if self.affixes else [], key=lambda p: (-len(p), p))
        self._suffixes = sorted(lx.SUFFIXES if self.affixes else [], key=lambda s: (-len(s), s))

    def atomic(self, s: str) -> bool:
        return s in self.fundamental or s in self.protected

    def known(self, s: str) -> bool:
        return s in self.roots or self.atomic(s) or s in lx.NUMBERS

    def cuts(self, stem: str) -> Iterator[tuple[str, str]]:
        """(rest, suffix) for every suffix that leaves two letters, longest first."""
        return ((stem[: -len(s)], s) for s in self._suffixes if stem.endswith(s) and len(stem) > len(s) + 1)

    def founded(self, stem: str, depth: int = 3) -> str | None:
        """The founding root under at most three suffixes whose steps are known roots."""
        if self.atomic(stem):
            return stem
        if not depth:
            return None
        for rest, _ in self.cuts(stem):
            if self.atomic(rest):
                return rest
            if rest in self.roots:
                return self.founded(rest, depth - 1)
        return None

    def by_suffix(self, stem: str) -> tuple[str, list[str]] | None:
        """Longest suffixes off, up to three, until a founding root is met."""
        taken: list[str] = []
        for _ in range(3):
            options = list(self.cuts(stem))
            hit = next(((r, s) for r, s in options if r in self.fundamental and s == options[0][1]), None)
            if hit:
                return hit[0], [*taken, hit[1]]
            if not options:
                return None
            stem, suffix = options[0]
            taken.append(suffix)
        return None

    def by_prefix(self, stem: str) -> str | None:
        """The first prefix that leads to a founding root."""
        return next((p for p in self._prefixes if stem.startswith(p) and len(stem) > len(p) and self.founded(stem[len(p) :])), None)

    def take_prefixes(self, stem: str) -> tuple[list[str], str]:
        out: list[str] = []
        while len(out) < 3 and not self.atomic(stem):
            p = next((p for p in self._prefixes if stem.startswith(p) and len(stem) > len(p) and (self.founded(stem[len(p) :]) or self.known(stem[len(p) :]))), None)
            if p is None:
                break
            out.append(p)
            stem = stem[len(p) :]
        return out, stem

    def take_suffixes(self, stem: str) -> tuple[list[str], str]:
        """Suffixes in the order they are cut, right to left."""
        out: list[str] = []
        while len(out) < 3 and not self.atomic(stem):
            hit = next(((r, s) for r, s in self.cuts(stem) if self.known(r) or r in lx.PARTICLES or r in lx.PREPOSITIONS), None)
            if hit is None:
                break
            stem, suffix = hit
            out.append(suffix)
        return out, stem

    def compound(self, stem: str) -> tuple[list[str], list[str]] | None:
        """(prefixes, roots): two roots with or without o between, else preposition and root."""
        for i in range(2, len(stem) - 2):
            a, b = stem[:i], stem[i:]
            if a in self.roots:
                for second in ([b[1:]] if b[0] == "o" and len(b) > 2 else []) + [b]:
                    if second in self.roots:
                        return [], [a, second]
        for p in lx.PREPOSITIONS:
            if stem.startswith(p) and stem[len(p) :] in self.roots:
                return [p], [stem[len(p) :]]
        return None

    def decompose(self, stem: str) -> tuple[list[str], str, list[str], list[str] | None] | None:
        """(prefixes, root, suffixes, compound roots) of a stem, or None if it has no known root."""
        if stem in self.protected:
            return [], stem, [], None
        prefix, suffix = self.by_prefix(stem), self.by_suffix(stem)
        if stem in self.fundamental and prefix is None and suffix is None:
            return [], stem, [], None
        # Where both readings exist, only productive prefixes win over suffixes.
        front = not (suffix and (prefix is None or prefix not in lx.PRODUCTIVE_PREFIXES))
        prefixes, rest = self.take_prefixes(stem) if front else ([], stem)
        if suffix and not prefixes:
            rest, suffixes = suffix
        else:
            suffixes, rest = self.take_suffixes(rest)
        if self.known(rest) or rest in lx.PARTICLES or rest in lx.PREPOSITIONS:
            return prefixes, rest, suffixes, None
        parts = self.compound(rest) if self.affixes and len(rest) >= 4 else None
        if parts is None:
            return None
        return parts[0] + prefixes, parts[1][-1], suffixes, parts[1] if len(parts[1]) > 1 else None


def _features(word: str) -> tuple[str, dict]:
    """Stem and features after the inflection is cut."""
    out = {"nombro": "singularo", "kazo": "nominativo"}
    if word.endswith("n") and len(word) > 2:
        out["kazo"], word = "akuzativo", word[:-1]
    if word.endswith("j") and len(word) > 2:
        out["nombro"], word = "pluralo", word[:-1]
    two, one = word[-2:], word[-1:]
    ending = two if two in ("as", "is", "os", "us") and len(word) > 3 else one if one in ("u", "i", "o", "a", "e") and len(word) > 1 else ""
    if ending:
        word = word[: -len(ending)]
        pos, tense, mood = lx.ENDINGS[ending]
        out |= {"vortspeco": pos, "tempo": tense, "modo": mood}
    return word, out


def analyse_word(word: str, lexicon: Lexicon) -> dict:
    """All fields of a word; words without a known root get a category instead."""
    low = word.lower()
    out: dict = {"plena_vorto": word, "vortspeco": "nekonata", "nombro": "singularo", "kazo": "nominativo", "prefiksoj": [], "sufiksoj": [], "parse_status": "success"}
    bare = low[:-1] if low.endswith("n") else low
    accusative = {"kazo": "akuzativo"} if low.endswith("n") else {}
    if word.isdigit():
        return out | {"radiko": word, "vortspeco": "numero"}
    if low == "la" or low in ("l'", "l’"):
        return out | {"radiko": "la", "vortspeco": "artikolo", "elidita": True if low != "la" else None}
    if bare in lx.PRONOUNS:
        return out | {"radiko": bare, "vortspeco": "pronomo"} | accusative
    for pos, forms in CLOSED:
        if low in forms:
            return out | {"radiko": low, "vortspeco": pos}
    for form, extra in ((low, {}), (bare, accusative)):
        if form in lx.CORRELATIVES:
            prefix = next(p for p in sorted(lx.CORRELATIVE_PREFIXES, key=len, reverse=True) if form.startswith(p))
            return out | {"radiko": form, "vortspeco": "korelativo", "korelativo_prefikso": prefix, "korelativo_sufikso": form[len(prefix) :], "korelativo_signifo": lx.CORRELATIVE_PREFIXES[prefix]} | extra
    elided = low.endswith(("'", "’"))
    stem, features = _features(low.rstrip("'’"))
    if elided:
        features |= {"elidita": True} | ({} if "vortspeco" in features else {"vortspeco": "substantivo"})
    parts = lexicon.decompose(stem)
    if parts is None:
        return out | {"radiko": word, "parse_status": "failed", "parse_error": f"no known root in '{word}', rest '{stem}'"} | _category(word, lexicon)
    prefixes, root, suffixes, compound = parts
    participle = next((lx.PARTICIPLES[s] for s in suffixes if s in lx.PARTICIPLES), (None, None))
    return out | features | {
        "radiko": root, "prefiksoj": prefixes, "sufiksoj": suffixes, "kunmetitaj_radikoj": compound, "participo_vocho": participle[0], "participo_tempo": participle[1]}


def _category(word: str, lexicon: Lexicon) -> dict:
    if len(word) > 1 and word[0].isupper():
        inflected = word.endswith(("o", "on", "oj", "ojn"))
        case = ({"kazo": "akuzativo"} if word.endswith("n") else {}) | ({"nombro": "pluralo"} if word.endswith(("j", "jn")) else {})
        if word in lexicon.names or word.rstrip("n").rstrip("j").rstrip("o") in lexicon.names:
            return {"category": "proper_name_known", "vortspeco": "propra_nomo", "parse_status": "success", "parse_error": None} | (case if inflected else {})
        return {"category": "proper_name_esperantized" if inflected else "proper_name", "vortspeco": "propra_nomo"} | (case if inflected else {})
    if len(word) == 1:
        return {"category": "single_letter", "vortspeco": "ekzemplo"}
    return {"category": "foreign_word", "vortspeco": "fremda_vorto"}


#: Largest dictionary that is shipped to the word analysis.
LARGEST_LEXICON = 2_000_000


def load_lexicon(entries: DataFrame, affixes: bool = True) -> Lexicon:
    """A lexicon of rows (root, kind) with kind ``root``, ``fundamental``, ``protected`` or ``name``; other kinds and nulls are ignored.

    A dictionary is small, and its size is checked: above ``LARGEST_LEXICON`` entries this raises ValueError.
    """
    rows = entries.select("root", "kind").filter("root is not null").distinct().limit(LARGEST_LEXICON + 1).collect()
    if len(rows) > LARGEST_LEXICON:
        raise ValueError(f"more than {LARGEST_LEXICON} entries are no dictionary")
    of = lambda kind: frozenset(r["root"] for r in rows if r["kind"] == kind)
    return Lexicon(of("root"), of("fundamental"), of("protected"), of("name"), affixes)


class _TooLong(Exception):
    pass


def within(seconds: float, analyse: Callable[[str], dict], word: str) -> dict:
    """The analysis of a word, or status ``timeout`` if it takes longer. The alarm needs the main thread, where Python workers run."""
    def stop(*_: object) -> None:
        raise _TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return analyse(word)
    except _TooLong:
        return {"plena_vorto": word, "radiko": word, "vortspeco": "nekonata", "prefiksoj": [], "sufiksoj": [], "parse_status": "timeout", "parse_error": f"no analysis within {seconds:g} s"}
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def word_udf(lexicon: Lexicon, seconds: float | None = None) -> Callable[[Column], Column]:
    """Analysis of words; with ``seconds``, a word that takes longer fails with status ``timeout``."""
    names = [f.split()[0] for f in WORD_TYPE.split(", ")]

    @F.pandas_udf(WORD_TYPE)
    def analyse(words: pd.Series) -> pd.DataFrame:
        one = lambda w: analyse_word(w, lexicon)
        rows = [one(w) if seconds is None else within(seconds, one, w) for w in words]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return analyse


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Types of the fields of a word, and its struct inside of another type.
WORD_FIELDS = dict(f.split() for f in WORD_TYPE.split(", "))
WORD_STRUCT = "struct<" + ", ".join(f"{k}: {v}" for k, v in WORD_FIELDS.items()) + ">"
_WORD = pa.struct([(k, _ARROW[v]) for k, v in WORD_FIELDS.items()])
#: Analysed words after which a worker begins anew to keep them.
KEPT_WORDS = 100_000


class Analyser:
    """Struct arrays of Arrow arrays of words; a word is analysed once while it is kept."""

    def __init__(self, lexicon: Lexicon, seconds: float | None = None):
        one = lambda w: analyse_word(w, lexicon)
        self._one = one if seconds is None else lambda w: within(seconds, one, w)
        self._at: dict[str, int] = {}
        self._rows = pa.array([], _WORD)

    def __call__(self, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._at) > KEPT_WORDS:
            self._at, self._rows = {}, pa.array([], _WORD)
        new = [w for w in distinct if w not in self._at]
        if new:
            self._rows = pa.concat_arrays([self._rows, pa.array([self._one(w) for w in new], _WORD)])
            self._at |= {w: len(self._at) + i for i, w in enumerate(new)}
        return self._rows.take(pa.array([self._at[w] for w in distinct], pa.int32())).take(coded.indices)

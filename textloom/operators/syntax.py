"""Sentences as flat word tables: roles, signatures, graphs, text again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.morphology import WORD_FIELDS, WORD_STRUCT, Analyser, Lexicon

CONTENT = ("substantivo", "verbo", "adjektivo", "adverbo")
NOUN = ("substantivo", "pronomo")
#: Words of sentences that leave a worker together.
WORDS_AT_ONCE = 20_000


def _tokens(text: Column) -> Column:
    return T.split_blank(F.translate(T.preprocess(text), T.ASCII_PUNCTUATION.replace("'", ""), " " * (len(T.ASCII_PUNCTUATION) - 1)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parsed(sentences: DataFrame, lexicon: Lexicon, seconds: float | None = None, fields: list[str] | None = None) -> DataFrame:
    """(sent_id, ws array of (pos, w struct)) for sentences (sent_id, text), one row each; sentences without words are left out.

    Sentences stay where they are: nothing is shuffled or broadcast. Each worker
    analyses a word once while it keeps it, for ``seconds`` at most. With
    ``fields`` the structs have these alone.
    """
    word = WORD_STRUCT if fields is None else "struct<" + ", ".join(f"{f}: {WORD_FIELDS[f]}" for f in fields) + ">"
    kind = sentences.schema["sent_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(lexicon, seconds)
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            ends, lo = lists.offsets.to_numpy(), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS_AT_ONCE, "right")) - 1)
                starts = ends[lo : hi + 1] - ends[lo]
                w = analyser(lists.slice(lo, hi - lo).flatten())
                if fields is not None:
                    w = pa.StructArray.from_arrays([w.field(f) for f in fields], names=fields)
                pos = np.arange(len(w), dtype=np.int32) - np.repeat(starts[:-1], np.diff(starts)).astype(np.int32)
                ws = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), w], names=["pos", "w"])
                yield pa.record_batch({"sent_id": ids.slice(lo, hi - lo), "ws": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), ws)})
                lo = hi

    rows = sentences.select("sent_id", _tokens(F.col("text")).alias("tokens")).filter("size(tokens) > 0")
    return rows.mapInArrow(run, f"sent_id {kind}, ws array<struct<pos: int, w: {word}>>")


def flat(sentences: DataFrame) -> DataFrame:
    """A row for each word of sentences (sent_id, ws)."""
    return sentences.select("sent_id", F.inline("ws"))


def _gathered(rows: DataFrame) -> DataFrame:
    """(sent_id, ws) of rows for each word; sentences that are so already stay as they are."""
    if "ws" in rows.columns:
        return rows
    return rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rows.columns if c not in ("sent_id", "pos")]))).alias("ws"))


def analyse(sentences: DataFrame, lexicon: Lexicon, seconds: float | None = None) -> DataFrame:
    """(sent_id, pos, w struct) for sentences (sent_id, text)."""
    return flat(parsed(sentences, lexicon, seconds))


def analysed_forms(sentences: DataFrame, lexicon: Lexicon, seconds: float | None = None) -> DataFrame:
    """(n, w struct) of each distinct word of sentences (sent_id, text), with the times it stands there.

    Words are counted before they are analysed, so each is analysed once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(lexicon, seconds)
        for b in batches:
            yield pa.record_batch({"n": b.column(1), "w": analyser(b.column(0))})

    counted = sentences.select(F.explode(_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(run, f"n long, w {WORD_STRUCT}")


def _times(words: DataFrame) -> Column:
    """Number of words: rows, or what the rows of ``analysed_forms`` stand for."""
    return F.sum("n") if "n" in words.columns else F.count(F.lit(1))


def _kind(x: Column) -> Column:
    return x["w"]["vortspeco"]


def with_roles(words: DataFrame) -> DataFrame:
    """Adds role, article and negation: first verb, first accusative noun, first nominative noun.

    Adjectives go with the object, else the subject, if case and number agree.
    An article marks the noun that follows it after adjectives only. ``words``
    has a row for each word, and so has the result, or one for each sentence.
    """
    ws = F.col("ws")
    first = lambda cond: F.get(F.filter(ws, cond), F.lit(0))
    noun = lambda case: lambda x: _kind(x).isin(*NOUN) & (x["w"]["kazo"] == case)
    # Of the words that are no adjectives, the nouns right after an article.
    after = lambda stops: F.transform(F.filter(stops, lambda x, i: (i > 0) & _kind(x).isin(*NOUN) & (_kind(F.get(stops, i - 1)) == "artikolo")), lambda x: x["pos"])
    marks = F.struct(
        first(lambda x: _kind(x) == "verbo").alias("v"), first(noun("akuzativo")).alias("o"), first(noun("nominativo")).alias("s"),
        _let(F.filter(ws, lambda x: _kind(x) != "adjektivo"), after).alias("marked"))

    def word(m: Column, x: Column, i: Column) -> Column:
        no = lambda c: F.coalesce(c, F.lit(False))
        is_at = lambda n: no(x["pos"] == m[n]["pos"])
        agrees = lambda n: no((m[n]["w"]["kazo"] == x["w"]["kazo"]) & (m[n]["w"]["nombro"] == x["w"]["nombro"]))
        adjective = _kind(x) == "adjektivo"
        role = (
            F.when(is_at("v"), "verbo").when(is_at("o"), "objekto").when(is_at("s"), "subjekto").when(_kind(x) == "artikolo", "artikolo")
            .when(adjective & agrees("o"), "objekto_priskribo").when(adjective & agrees("s"), "subjekto_priskribo").otherwise("aliaj")
        )
        negated = is_at("v") & no(F.get(ws, i - 1)["w"]["radiko"] == "ne")
        return F.struct(x["pos"].alias("pos"), x["w"].alias("w"), role.alias("role"), F.array_contains(m["marked"], x["pos"]).alias("has_article"), negated.alias("negated"))

    out = _gathered(words).select("sent_id", _let(marks, lambda m: F.transform(ws, lambda x, i: word(m, x, i))).alias("ws"))
    return out if "ws" in words.columns else flat(out)


def sentence_types(roles: DataFrame) -> DataFrame:
    """sent_id, fraztipo, demandotipo, negita and word statistics."""
    some = lambda cond: F.coalesce(F.exists("ws", cond), F.lit(False))
    root = lambda x: x["w"]["radiko"]
    cu, ki = some(lambda x: root(x) == "ĉu"), some(lambda x: x["w"]["korelativo_prefikso"] == "ki")
    command = some(lambda x: (x["role"] == "verbo") & (x["w"]["modo"] == "imperativo"))
    ok = F.size(F.filter("ws", lambda x: x["w"]["parse_status"] == "success")).cast("long")
    g = _gathered(roles).select(
        "sent_id", cu.alias("cu"), ki.alias("ki"), command.alias("command"), some(lambda x: (root(x) == "ne") | root(x).startswith("neni")).alias("negita"),
        F.size("ws").cast("long").alias("total_words"), ok.alias("esperanto_words"))
    question = F.col("cu") | F.col("ki")
    return g.select(
        "sent_id", F.when(question, "demando").when(F.col("command"), "ordono").otherwise("deklaro").alias("fraztipo"),
        F.when(F.col("cu"), "ĉu").when(F.col("ki"), "ki").alias("demandotipo"), "negita", "total_words", "esperanto_words",
        (F.col("total_words") - F.col("esperanto_words")).alias("non_esperanto_words"), (F.col("esperanto_words") / F.col("total_words")).alias("success_rate"))


def problems(words: DataFrame) -> DataFrame:
    """token, status, error, n of the words that failed or took too long: the problem log."""
    bad = words.filter("w.parse_status <> 'success'")
    return bad.groupBy(F.col("w.plena_vorto").alias("token"), F.col("w.parse_status").alias("status"), F.col("w.parse_error").alias("error")).agg(_times(words).alias("n"))


def failure_categories(words: DataFrame) -> DataFrame:
    return words.filter("w.parse_status = 'failed'").groupBy("w.category").agg(_times(words).alias("n"))


def count_of(words: DataFrame, key: Column) -> DataFrame:
    """Words by key, with their number n."""
    return words.groupBy(key).agg(_times(words).alias("n"))


def ending(w: Column) -> Column:
    """Ending that the features call for."""
    tense = F.when(w["tempo"] == "prezenco", "as").when(w["tempo"] == "pasinteco", "is").when(w["tempo"] == "futuro", "os")
    mood = F.when(w["modo"] == "kondicionalo", "us").when(w["modo"] == "imperativo", "u").when(w["modo"] == "infinitivo", "i")
    return F.when(w["vortspeco"] == "verbo", F.coalesce(tense, mood)).when(w["vortspeco"] == "substantivo", "o").when(w["vortspeco"] == "adjektivo", "a").when(w["vortspeco"] == "adverbo", "e")


def surface(w: Column) -> Column:
    """The word put together again; suffixes are stored right to left."""
    stem = F.concat(F.array_join(w["prefiksoj"], ""), F.when(w["kunmetitaj_radikoj"].isNotNull(), F.array_join(w["kunmetitaj_radikoj"], "")).otherwise(w["radiko"]), F.array_join(F.reverse(w["sufiksoj"]), ""))
    plural = F.when(w["nombro"] == "pluralo", "j").otherwise("")
    accusative = F.when(w["kazo"] == "akuzativo", "n").otherwise("")
    return F.when(w["vortspeco"] == "propra_nomo", w["plena_vorto"]).otherwise(F.concat(stem, F.coalesce(ending(w), F.lit("")), plural, accusative))


def deparsed(ws: Column) -> Column:
    """Text of a sentence's words with roles: subject, verb, object, rest; the article before the adjectives of its noun."""
    def order(x: Column) -> Column:
        at = {"subjekto_priskribo": 1, "subjekto": 2, "verbo": 3, "objekto_priskribo": 4, "objekto": 5}
        out = F
        for role, k in at.items():
            out = out.when(x["role"] == role, k)
        return out.otherwise(6)

    words = F.transform(F.filter(ws, lambda x: x["role"] != "artikolo"), lambda x: F.struct(order(x).alias("k"), x["pos"].alias("pos"), surface(x["w"]).alias("s")))
    article = lambda n, at: F.when(F.exists(ws, lambda x: (x["role"] == n) & x["has_article"]), F.array(F.struct(F.lit(at).alias("k"), F.lit(-1).alias("pos"), F.lit("la").alias("s")))).otherwise(F.array().cast("array<struct<k:int,pos:int,s:string>>"))
    text = F.array_join(F.transform(F.array_sort(F.concat(words, article("subjekto", 1), article("objekto", 4))), lambda x: x["s"]), " ")
    return _let(text, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)), F.lit(".")))


def deparse(roles: DataFrame) -> DataFrame:
    """sent_id, text."""
    some = F.exists("ws", lambda x: x["role"] != "artikolo")
    return _gathered(roles).filter(some).select("sent_id", deparsed(F.col("ws")).alias("text"))


def grammar_tokens(w: Column) -> Column:
    tag = lambda name, x: F.array(F.when(x.isNotNull(), F.concat(F.lit(name + ":"), x)))
    many = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name + ":"), x))
    return F.array_compact(F.concat(
        many("pref", w["prefiksoj"]), tag("root", w["radiko"]), many("suf", w["sufiksoj"]), tag("ending", ending(w)), tag("pos", w["vortspeco"]),
        tag("num", w["nombro"]), tag("case", w["kazo"]), tag("tense", w["tempo"]), tag("mood", w["modo"])))


def slot(role: str, name: str, w: Column, modifiers: Column) -> Column:
    """Signature of one slot: role, root, part of speech, features, sorted modifiers."""
    verb = w["vortspeco"] == "verbo"
    opt = lambda n, x: F.when(x.isNotNull(), F.concat(F.lit(f"{n}="), x))
    text = F.concat_ws(
        "|", F.lit(f"role={name}"), F.concat(F.lit("root="), F.coalesce(w["radiko"], F.lit(""))), F.concat(F.lit("pos="), F.coalesce(w["vortspeco"], F.lit(""))),
        F.when(~verb, opt("num", w["nombro"])), F.when(~verb, opt("case", w["kazo"])), opt("tense", w["tempo"]), opt("mood", w["modo"]),
        F.concat(F.lit("mods="), F.array_join(F.sort_array(modifiers), ",")))
    return F.concat(F.lit(name.upper() + ":"), text)


def signatures(roles: DataFrame) -> DataFrame:
    """sent_id, signature, grammar_tokens, slot_roots: the structural index."""
    ws = F.col("ws")
    at = lambda r: F.get(F.filter(ws, lambda x: x["role"] == r), F.lit(0))["w"]
    mods = lambda r: F.transform(F.filter(ws, lambda x: x["role"] == r), lambda x: F.concat(F.array_join(x["w"]["prefiksoj"], ""), x["w"]["radiko"]))
    toks = F.flatten(F.transform(F.filter(ws, lambda x: x["role"] != "artikolo"), lambda x: grammar_tokens(x["w"])))
    none = F.array().cast("array<string>")
    parts = F.struct(at("subjekto").alias("s"), at("verbo").alias("v"), at("objekto").alias("o"), mods("subjekto_priskribo").alias("sm"), mods("objekto_priskribo").alias("om"))

    def index(g: Column) -> Column:
        sig = F.concat_ws(";", slot("subjekto", "subj", g["s"], g["sm"]), slot("verbo", "verb", g["v"], none), slot("objekto", "obj", g["o"], g["om"]))
        slots = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), g[c]["radiko"].alias("v")) for n, c in (("subjekto", "s"), ("verbo", "v"), ("objekto", "o"))]), lambda e: e["v"].isNotNull()))
        return F.struct(sig.alias("signature"), slots.alias("slot_roots"))

    rows = _gathered(roles).select("sent_id", _let(parts, index).alias("g"), toks.alias("grammar_tokens"))
    return rows.select("sent_id", "g.signature", "grammar_tokens", "g.slot_roots")


def graph_edges(roles: DataFrame) -> DataFrame:
    """sent_id, src, dst, edge_type; node 0 is the sentence, a word is pos + 1, an article is -(pos + 1)."""
    node = lambda x: x["pos"] + 1
    e = lambda a, b, t: F.struct(a.cast("int").alias("src"), b.cast("int").alias("dst"), F.lit(t).alias("edge_type"))
    head = lambda r: node(F.get(F.filter("ws", lambda x: x["role"] == r), F.lit(0))).alias(r)
    zero = F.lit(0)

    def edges(m: Column, x: Column) -> Column:
        role = x["role"]
        edge = (
            F.when(role == "subjekto", e(zero, node(x), "has_subject")).when(role == "verbo", e(zero, node(x), "has_verb"))
            .when(role == "objekto", e(zero, node(x), "has_object")).when(role == "subjekto_priskribo", e(node(x), m["subjekto"], "modifies"))
            .when(role == "objekto_priskribo", e(node(x), m["objekto"], "modifies")).when(role == "aliaj", e(zero, node(x), "has_modifier"))
        )
        return F.array(edge, F.when(x["has_article"] & role.isin("subjekto", "objekto"), e(node(x), -node(x), "has_article")))

    found = _let(F.struct(head("subjekto"), head("objekto")), lambda m: F.array_compact(F.flatten(F.transform("ws", lambda x: edges(m, x)))))
    return _gathered(roles).select("sent_id", F.inline(found))

"""The word and sentence analysis against constructed rows."""

import pytest

from textloom.functions.morphology import Lexicon, analyse_word, closed_class, correlative, inflection, load_lexicon, within
from textloom.operators import syntax as S

ENTRIES = [(r, "root") for r in "hund kat bon vid leg bel skrib vapor ŝip grand manĝ pom kur ven reĝ skribil libr ej".split()]
ENTRIES += [(r, "fundamental") for r in "hund bon vid leg bel skrib".split()] + [("region", "protected"), ("libret", "protected"), ("Frodo", "name")]
LEXICON = Lexicon(*(frozenset(r for r, k in ENTRIES if k == kind) for kind in ("root", "fundamental", "protected")))


@pytest.mark.parametrize(
    "word, expected",
    [
        ("hundo", {"radiko": "hund", "vortspeco": "substantivo", "nombro": "singularo", "kazo": "nominativo"}),
        ("hundojn", {"radiko": "hund", "nombro": "pluralo", "kazo": "akuzativo"}),
        ("malbona", {"radiko": "bon", "prefiksoj": ["mal"], "vortspeco": "adjektivo"}),
        ("vidis", {"radiko": "vid", "vortspeco": "verbo", "tempo": "pasinteco"}),
        ("vidus", {"radiko": "vid", "modo": "kondicionalo", "tempo": None}),
        ("vidu", {"radiko": "vid", "modo": "imperativo"}),
        ("relegas", {"radiko": "leg", "prefiksoj": ["re"], "tempo": "prezenco"}),
        ("belulino", {"radiko": "bel", "sufiksoj": ["in", "ul"]}),
        ("skribanta", {"radiko": "skrib", "sufiksoj": ["ant"], "participo_vocho": "aktiva", "participo_tempo": "prezenco"}),
        ("vaporŝipo", {"radiko": "ŝip", "kunmetitaj_radikoj": ["vapor", "ŝip"]}),
        ("regiono", {"radiko": "region", "prefiksoj": []}),
        ("libreton", {"radiko": "libret", "sufiksoj": [], "kazo": "akuzativo"}),
        ("katido", {"radiko": "kat", "sufiksoj": ["id"]}),
        ("skribileto", {"radiko": "skrib", "sufiksoj": ["et", "il"]}),
        ("librovendejo", {"parse_status": "failed", "category": "foreign_word"}),
        ("min", {"radiko": "mi", "vortspeco": "pronomo", "kazo": "akuzativo"}),
        ("kiun", {"radiko": "kiu", "vortspeco": "korelativo", "korelativo_prefikso": "ki", "kazo": "akuzativo"}),
        ("neniam", {"korelativo_prefikso": "neni", "korelativo_sufikso": "am"}),
        ("nek", {"vortspeco": "konjunkcio"}),
        ("l'", {"radiko": "la", "vortspeco": "artikolo", "elidita": True}),
        ("hund'", {"radiko": "hund", "vortspeco": "substantivo", "elidita": True}),
        ("1905", {"vortspeco": "numero", "radiko": "1905"}),
        ("Xyzo", {"parse_status": "failed", "category": "proper_name_esperantized"}),
        ("qwx", {"parse_status": "failed", "category": "foreign_word"}),
        ("q", {"parse_status": "failed", "category": "single_letter"}),
    ],
)
def test_words(word, expected):
    got = analyse_word(word, LEXICON)
    assert {k: got.get(k) for k in expected} == expected


def test_known_names_count_as_success():
    got = analyse_word("Frodo", Lexicon(names=frozenset({"Frodo"})))
    assert (got["parse_status"], got["category"]) == ("success", "proper_name_known")


def test_lexicon_is_loaded_from_rows(spark):
    df = spark.createDataFrame([*ENTRIES, *ENTRIES, (None, "root"), ("x", "other")], "root string, kind string")
    got = load_lexicon(df)
    assert (got.roots, got.fundamental, got.protected, got.names) == (LEXICON.roots, LEXICON.fundamental, LEXICON.protected, frozenset({"Frodo"}))
    whole = load_lexicon(df, affixes=False)
    assert analyse_word("malbona", whole)["parse_status"] == "failed" and analyse_word("bona", whole)["radiko"] == "bon"
    empty = load_lexicon(df.limit(0))
    assert analyse_word("bona", empty)["parse_status"] == "failed" and analyse_word("kaj", empty)["vortspeco"] == "konjunkcio"


def test_a_word_that_takes_too_long():
    def slow(word):
        while word == "slow":
            pass
        return {"plena_vorto": word, "parse_status": "success"}

    assert within(0.05, slow, "slow")["parse_status"] == "timeout" and within(0.05, slow, "fast")["parse_status"] == "success"


def test_problem_log(spark):
    words = S.analyse(spark.createDataFrame([(1, "La hundo vidas qwx kaj qwx.")], "sent_id long, text string"), LEXICON, seconds=5.0)
    assert [(r.token, r.status, r.n) for r in S.problems(words).collect()] == [("qwx", "failed", 2)]


def test_native_columns(spark):
    df = spark.createDataFrame([("hundojn",), ("la",), ("min",), ("kiujn",), ("vidos",)], "w string")
    rows = {r.w: r for r in df.select("w", closed_class(df.w).alias("c"), correlative(df.w).alias("k"), inflection(df.w).alias("i")).collect()}
    assert rows["la"].c == "artikolo" and rows["min"].c == "pronomo" and rows["hundojn"].c is None
    assert rows["hundojn"].i.stem == "hund" and rows["hundojn"].i.kazo == "akuzativo" and rows["vidos"].i.tempo == "futuro"


SENTENCES = [(1, "La bona hundo vidas la grandan katon."), (2, "Ĉu mi ne manĝis pomojn?"), (3, "Kuru!"), (4, "Kiam venos la reĝo?")]


@pytest.fixture(scope="module")
def roles(spark):
    return S.with_roles(S.analyse(spark.createDataFrame(SENTENCES, "sent_id long, text string"), LEXICON)).cache()


def test_roles(roles):
    got = {(r.sent_id, r.role): r for r in roles.collect()}
    assert got[1, "subjekto"].w.radiko == "hund" and got[1, "subjekto"].has_article
    assert got[1, "objekto"].w.radiko == "kat" and got[1, "objekto"].has_article
    assert got[1, "objekto_priskribo"].w.radiko == "grand" and got[1, "subjekto_priskribo"].w.radiko == "bon"
    assert got[2, "verbo"].negated and not got[1, "verbo"].negated


def test_sentence_types(roles):
    got = {r.sent_id: r for r in S.sentence_types(roles).collect()}
    assert [got[i].fraztipo for i in (1, 2, 3, 4)] == ["deklaro", "demando", "ordono", "demando"]
    assert got[2].demandotipo == "ĉu" and got[4].demandotipo == "ki" and got[2].negita
    assert got[1].success_rate == 1.0


def test_deparse_round_trip(roles):
    text = {r.sent_id: r.text for r in S.deparse(roles).collect()}
    assert text[1] == "La bona hundo vidas la grandan katon."
    assert text[3] == "Kuru."


def test_signature(roles):
    got = {r.sent_id: r for r in S.signatures(roles).collect()}
    assert got[1].signature == (
        "SUBJ:role=subj|root=hund|pos=substantivo|num=singularo|case=nominativo|mods=bon;VERB:role=verb|root=vid|pos=verbo|tense=prezenco|mods=;"
        "OBJ:role=obj|root=kat|pos=substantivo|num=singularo|case=akuzativo|mods=grand")
    assert got[1].slot_roots == {"subjekto": "hund", "verbo": "vid", "objekto": "kat"}
    assert "root:hund" in got[1].grammar_tokens and "tense:prezenco" in got[1].grammar_tokens


def test_graph(roles):
    kinds = sorted(r.edge_type for r in S.graph_edges(roles).filter("sent_id = 1").collect())
    assert kinds == ["has_article", "has_article", "has_object", "has_subject", "has_verb", "modifies", "modifies"]


def test_analysis_is_neither_joined_nor_repeated(spark):
    """Filters on the analysis must not reach the single words, nor make the words look few enough to be broadcast."""
    df = spark.createDataFrame([(i, "La hundo vidas qwx kaj qwx.") for i in range(50)], "sent_id long, text string")
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    forms = S.analysed_forms(df, LEXICON)
    assert [(r.category, r.n) for r in S.failure_categories(forms).collect()] == [("foreign_word", 100)]
    assert [(r.token, r.n) for r in S.problems(forms).collect()] == [("qwx", 100)]
    for out in (S.failure_categories(forms), S.problems(forms)):
        assert "Join" not in plan(out) and plan(out).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan(out)
    roles = S.with_roles(S.parsed(df, LEXICON))
    for out in (roles, S.deparse(roles), S.signatures(roles), S.graph_edges(roles), S.sentence_types(roles)):
        assert "Exchange" not in plan(out) and plan(out).count("MapInArrow") == 1


def test_sentences_and_their_words_agree(spark):
    """Roles by sentence and by word are the same, also where a worker hands on its words in pieces or forgets them."""
    from textloom.functions import morphology as M

    text = "La bona hundo la la granda reĝo ne vidas la grandan bonan katon qwx Kuru mi ĉu min"
    df = spark.createDataFrame([(i, " ".join([text] * (i % 4 * 300))) for i in range(12)], "sent_id long, text string").coalesce(1)
    key = lambda df: sorted(df.collect(), key=str)
    a, b = S.with_roles(S.parsed(df, LEXICON)), S.with_roles(S.analyse(df, LEXICON))
    assert a.count() == 9 and key(S.flat(a)) == key(b) and key(S.deparse(a)) == key(S.deparse(b)) and key(S.signatures(a)) == key(S.signatures(b))
    n = M.Analyser(LEXICON)
    words = [f"w{i}" for i in range(M.KEPT_WORDS + 10)]
    import pyarrow as pa

    for ws in (words, words[:3] + ["hundo", "hundo"], ["hundo"]):
        assert n(pa.array(ws)).field("plena_vorto").to_pylist() == ws

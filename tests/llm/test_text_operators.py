"""Near duplicates, line dedup, repeated strings, decontamination against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import EDGE, SCHEMA, rows_of, words
from textloom.llm import near_dedup as N
from textloom.llm.components import components
from textloom.llm.decontaminate import align, contaminated, drop_contaminated
from textloom.llm.line_dedup import LineRuns, drop_frequent_lines
from textloom.llm.suffix_dedup import SPAN, drop_repeats, least_ids
from textloom.llm._util import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(base, n, seed):
    r, out = random.Random(seed), list(base)
    for i in r.sample(range(len(out)), n):
        out[i] = f"e{seed}_{i}"
    return " ".join(out)


def near_copies():
    base = words(120, 5, 10**6)
    pairs = [(i, edited(base, i % 9, i), "a") for i in range(60)]
    return pairs + [(100 + i, " ".join(words(80, 50 + i, 10**6)), "b") for i in range(20)] + [(200 + i, " ".join(base), "c") for i in range(5)]


@pytest.mark.parametrize("pairs", [near_copies(), EDGE], ids=["copies", "edge"])
def test_near_duplicates(spark, pairs):
    got = N.near_duplicates(spark.createDataFrame(rows_of(pairs), SCHEMA), block_rows=8).collect()
    assert len(got) == len(pairs)
    want = brute_components({i: t for i, t, _ in pairs})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_texts_under_one_doc_id_have_links_of_their_own(spark):
    a, b, c = (" ".join(words(60, 700 + i, 10**6)) for i in range(3))
    pairs = [(1, a, "x"), (1, b, "x"), (2, a + " more", "x"), (3, b + " more", "x"), (4, c, "x"), (None, c, "x"), (None, a, "x"), (5, c, "x")]
    got = N.near_duplicates(spark.createDataFrame(rows_of(pairs), SCHEMA), carry=["text"]).collect()
    assert Counter((r.doc_id, r.text, r.component_id, r.kept) for r in got) == Counter(
        [(1, a, 1, True), (1, b, 1, True), (2, a + " more", 1, False), (3, b + " more", 1, False), (4, c, 4, True), (None, c, None, True), (None, a, None, True), (5, c, 4, False)])
    node = {r.text: r.node for r in got if r.doc_id is not None}
    assert node[a] == node[a + " more"] != node[b] == node[b + " more"] and all(r.node is None for r in got if r.doc_id is None)


def test_near_duplicates_of_nothing(none):
    assert N.near_duplicates(none).count() == 0


def test_estimate_is_near_the_truth():
    sketch, r = N.Sketch(), np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.r_[a[:900], r.integers(0, 2**63, 100, dtype=np.uint64)]
    mul = sketch.multipliers()
    x, y = sketch.registers(a, mul), sketch.registers(b, mul)
    est = sketch.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(est - 900 / 1100) < 0.1
    union = sketch.registers(np.union1d(a, b), mul)
    assert (union == np.maximum(x, y)).all()  # registers merge


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links, Workspace(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_lines(pairs, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter(k for _, t, _ in pairs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, _ in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    pairs = EDGE + [(100 + i, f"Same line \nown {i}\n{'twice' if i < 9 else 'other'}\n\tSAME LINE", "a") for i in range(12)]
    got = drop_frequent_lines(spark.createDataFrame(rows_of(pairs), SCHEMA), fanout=2)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(pairs)


def test_line_dedup_of_a_text_of_many_lines(spark):
    many = "\n".join(f"line {i}" for i in range(80_000))
    pairs = [(i, many, "a") for i in range(10)] + [(20, many + "\nown", "a"), (21, "line 7\nx\nLINE 79999", "b")] + [(30, many, "a")] * 3
    begin = time.perf_counter()
    got = drop_frequent_lines(spark.createDataFrame(rows_of(pairs), SCHEMA)).collect()
    assert time.perf_counter() - begin < 60
    want = {21: (3, 2, "x"), 20: (80_001, 80_000, "own")}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == Counter((i, *want.get(i, (80_000, 80_000, ""))) for i, _, _ in pairs)


def test_later_batches_lose_settled_keys(spark, monkeypatch):
    """The query itself anti-joins batches with runs that hold keys."""
    seen = []
    add = LineRuns.add

    def watched(self, counts):
        settled = sum(s.count() for s in self.settled)
        before = counts.count()
        add(self, counts)
        seen.append((settled, before))

    monkeypatch.setattr(LineRuns, "add", watched)
    written = []
    run = LineRuns._run
    monkeypatch.setattr(LineRuns, "_run", lambda self, c: written.append(run(self, c)) or written[-1])
    pairs = [(i, f"same\nown {i}", "a") for i in range(200)]
    got = drop_frequent_lines(spark.createDataFrame(rows_of(pairs), SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(pairs)
    assert [s for s, _ in seen] == [0, 0, 0, 1, 1, 1]


def test_line_dedup_of_nothing(none):
    assert drop_frequent_lines(none).count() == 0


def test_first_seen_lines_over_batches(spark):
    runs = LineRuns(Workspace(spark, "test"), threshold=100, fanout=2)
    for batch, new in (([1, 2, 3], [1, 2, 3]), ([2, 3, 4], [4]), ([1, 4, 5], [5]), ([5, 6], [6])):
        keys = spark.createDataFrame([(k, k, 1) for k in batch], "k1 long, k2 long, n long")
        assert sorted(r.k1 for r in runs.first_seen(keys).collect()) == new
        runs.add(keys)
    assert len(runs.levels) > 1


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest), for small tests."""
    least: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(data):
        for p in range(len(data[i]) - SPAN + 1):
            least.setdefault(data[i][p : p + SPAN], i)
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - SPAN + 1):
            if least[b[p : p + SPAN]] < i:
                gone[p : p + SPAN] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("case", ["edge", "passages", "bytes"])
def test_repeated_strings(spark, case):
    r = random.Random(3)
    shared = [" ".join(words(25, 900 + i, 10**6)) for i in range(4)]
    pairs = {
        "edge": [p for n, p in enumerate(EDGE) if n != 7],
        "passages": [(i, " ".join([*words(20, i, 10**6), *r.sample(shared, 2), *words(9, 500 + i, 10**6)]), "a") for i in range(40)] + [(60 + i, shared[0], "b") for i in range(3)],
        "bytes": [(i, "ab" * (20 + i) + "ä" * i + "ab" * 30, "a") for i in range(12)],
    }[case]
    got = drop_repeats(spark.createDataFrame(rows_of(pairs), SCHEMA), hot=5 if case == "passages" else 20_000).collect()
    want = brute_force({i: t for i, t, _ in pairs})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_repeated_rows_keep_each_other(spark):
    pairs = [(5, "z" * 100, "a"), (5, "z" * 100, "a"), (6, "z" * 100, "a")]
    got = drop_repeats(spark.createDataFrame(rows_of(pairs), SCHEMA)).collect()
    # Within a text of one letter nothing repeats from a smaller doc_id; document 6 goes.
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(5, 0), (5, 0), (6, 100)]


def test_repeats_of_nothing(none):
    assert drop_repeats(none).count() == 0


def test_merged_transforms_find_the_least_ids():
    r = random.Random(4)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(50, 81))) for _ in range(60)]
    texts += [t[3:] + b"a" * 5 for t in texts[:20] if len(t) > 55]
    ids = np.array(r.sample(range(1000), len(texts)))
    starts = np.array([len(t) - 49 for t in texts])
    for shards in (1, 2, 3):
        got = least_ids([np.frombuffer(t, np.uint8) for t in texts], starts, ids, shards)
        grams = [(t[p : p + 50], int(i)) for t, i in zip(texts, ids) for p in range(len(t) - 49)]
        least = {}
        for g, i in grams:
            least[g] = min(i, least.get(g, i))
        assert got.tolist() == [least[g] for g, _ in grams]


def smith_waterman(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(5)
    for _ in range(30):
        a, b = r.integers(0, 4, r.integers(1, 30)), r.integers(0, 4, r.integers(1, 20))
        assert align(a, b)[0] == smith_waterman(b, a)


def test_decontamination(spark):
    items = [(1, " ".join(words(40, 1001, 10**6))), (2, " ".join(words(30, 1002, 10**6))), (3, None), (4, ""), (5, "tiny item")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    one, two = items[0][1].split(), items[1][1].split()
    edit = [w if n % 9 else "changed" for n, w in enumerate(one)]
    gap = two[:12] + ["put", "in"] + two[12:20] + two[21:]
    around = lambda ws, s: " ".join(words(200, s, 10**6) + ws + words(50, s + 1, 10**6))
    pairs = EDGE + [(100, around(one, 1), "a"), (101, around(edit, 3), "a"), (102, around(gap, 5), "a"), (103, around(one[:10], 7), "a"), (104, around([], 9), "a"), (105, "A TINY, item.", "a")]
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    for block in (20_000, 2):
        got = contaminated(docs, bench, block_items=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(100, 1), (101, 1), (102, 2), (105, 5)]
    left = drop_contaminated(docs, bench, block_items=2)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == sorted([i for i, _, _ in EDGE] + [103, 104])


def test_decontamination_of_edits_in_every_part(spark):
    """Copies by the rule of acceptance alone, whatever runs of words they keep."""
    template = words(20, 2000, 10**6)
    items = {1: words(30, 2001, 10**6), 2: words(16, 2002, 10**6)} | {10 + i: template + words(10, 2010 + i, 10**6) for i in range(12)}
    put = lambda ws, n: [x for i, w in enumerate(ws) for x in ((w, f"put{i}") if i % n == n - 1 else (w,))]
    swap = lambda ws, n: [f"new{i}" if i % n == n - 1 else w for i, w in enumerate(ws)]
    bodies = [swap(items[1], 5), put(items[1], 3), swap(items[2], 5), template + ["all", "new"], template, swap(items[1], 3), put(items[2], 2)]
    r = random.Random(5)
    for _ in range(60):
        ws = list(items[r.choice([1, 2])])
        for _ in range(r.randrange(2, 9)):
            i = r.randrange(len(ws))
            ws[i : i + r.randrange(2)] = ["x%d" % r.randrange(10**6)] * r.randrange(2)
        bodies.append(ws)
    docs = {100 + i: words(9, 3000 + i, 10**6) + b + words(9, 4000 + i, 10**6) for i, b in enumerate(bodies)}
    want = {(d, k) for d, t in docs.items() for k, w in items.items() if smith_waterman(t, w) >= 0.6 * len(w)}
    assert {(100, 1), (101, 1), (102, 2), (103, 10)} <= want and (105, 1) not in want
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    frame = spark.createDataFrame(rows_of([(d, " ".join(t), "a") for d, t in docs.items()]), SCHEMA)
    for block in (20_000, 3):
        assert {(r.doc_id, r.item_id) for r in contaminated(frame, bench, block_items=block).collect()} == want
    assert {r.doc_id for r in drop_contaminated(frame, bench).collect()} == set(docs) - {d for d, _ in want}


def test_decontamination_of_repeated_words(spark):
    """Work stays in proportion to the text, not to its product with the item."""
    bench = spark.createDataFrame([(1, "again " * 400), (2, "a b " * 100)], "item_id long, text string")
    docs = spark.createDataFrame(rows_of([(1, "again " * 20_000, "a"), (2, "again " * 200, "a"), (3, "x a b a b y " * 4000, "a")]), SCHEMA)
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2)} - ({(3, 2)} if smith_waterman(["x", "a", "b", "a", "b", "y"] * 60, ["a", "b"] * 100) < 120 else set())
    assert all(r.seeds <= 2 * 24_000 for r in got)


def test_decontamination_of_nothing(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(none, bench).count() == 0

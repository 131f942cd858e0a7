"""Benchmark decontamination: n-gram seeds that no copy can lack, then local alignment.

An alignment of m matches and e errors has at most e + 1 unbroken runs, so an
item of L words that scores T keeps an unbroken run of L / (L - T + 1) words:
shingles of that length (three words at a score of 0.6 and over ten words) are
its seeds. As a copy keeps a known number of them, that number less one may be
missing from the index: the shingles that most items share. A training text
that holds a seed and enough of the item's word pairs is aligned with the item,
word by word, around the place where the item would lie (Smith-Waterman with
linear gaps): the best local score, as a share of the item's length, tells
copies, also edited ones, from chance. The corpus is scanned once per block of items
and its texts are never shuffled; a block has a fixed largest size and blocks
follow one another, so what the driver and executors hold is bounded however
many items there are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm._bytes import U, Block, as_bytes, blocks, mix, range_hash
from textloom.llm._util import Workspace, with_place
from textloom.llm.toxicity import _FOLD as FOLD

_FILTER_BITS = 20


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    n = max(0, len(h) - words + 1)
    out = np.zeros(n, U)
    for i in range(words):
        out += h[i : n + i] * U(pow(0xD6E8FEB86659FD93, 2 * i + 1, 2**64))
    return mix(out)


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (and at the end)."""
    a, b = block.words()
    return range_hash(block.sums(), a, b), block.words_in(a)


def align(passage: np.ndarray, item: np.ndarray, gap: int = 1, mismatch: int = 1) -> tuple[int, int]:
    """Best local alignment score (a match is worth 1) and the passage word it ends at."""
    steps = gap * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, 1, -mismatch), row[1:] - gap)
        np.maximum(new, 0, out=new)
        # A gap in the item carries a score to the right, less its length.
        row = np.maximum.accumulate(new + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at - 1
    return best, end


def seed_size(length: int, score: int, most: int) -> tuple[int, int]:
    """Words of a seed, and the least number of them in any copy.

    A copy has m <= ``length`` matches and at most m - ``score`` errors. Of its
    runs, at most one more than errors, each has one shingle less than words for
    every further word of a shingle; the count is linear in m, so its least
    value lies at an end. Errors cost 1 each (see ``align``).
    """
    size = max(1, min(most, -(-length // (length - score + 1))))
    least = min(score - (size - 1), length - (length - score + 1) * (size - 1))
    return size, max(1, least)


@dataclass
class Seeds:
    """Places of seeds of one size: those of seed ``keys[i]`` are first[i] .. first[i + 1] - 1 of ``item`` and ``at``."""

    size: int
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray

    def bits(self) -> np.ndarray:
        out = np.zeros(1 << _FILTER_BITS, bool)
        out[(self.keys >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        return out


@dataclass
class Items:
    """A block of test items and the index of their seeds by number of words, in packed arrays."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: list[Seeds]

    @classmethod
    def build(cls, rows: list[tuple[int, str]], size: int, threshold: float) -> Items:
        ids = [i for i, _ in rows]
        texts = [(t or "").encode().translate(FOLD) for _, t in rows]
        words: list[np.ndarray] = []
        for block in blocks(texts):
            h, bounds = word_hashes(block)
            words += [h[bounds[k] : bounds[k + 1]].copy() for k in range(block.hi - block.lo)]
        # Items shorter than ``size`` words must occur whole.
        kept = [seed_size(len(w), math.ceil(threshold * len(w)), size) if len(w) >= size else (len(w), 1) for w in words]
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, (n, _) in enumerate(kept):
            if n:
                by_size[n].append(k)
        return cls(ids, words, [cls._index(n, [(k, _shingles(words[k], n), kept[k][1]) for k in held]) for n, held in sorted(by_size.items())])

    @staticmethod
    def _index(size: int, grams: list[tuple[int, np.ndarray, int]]) -> Seeds:
        distinct, shared = np.unique(np.concatenate([np.unique(x) for _, x, _ in grams]), return_counts=True)
        key, item, at = [], [], []
        for k, x, least in grams:
            # Rarest first; any copy holds ``least`` of the shingles, so one of these.
            rare = np.argsort(shared[np.searchsorted(distinct, x)], kind="stable")[: len(x) - least + 1]
            rare.sort()
            g, first = np.unique(x[rare], return_index=True)
            last = len(rare) - 1 - np.unique(x[rare][::-1], return_index=True)[1]
            # The first and last place of a repeated seed: places between them would only lie within the same run (see ``_runs``).
            again = last > first
            key += [g, g[again]]
            at += [rare[first], rare[last[again]]]
            item.append(np.full(len(g) + int(again.sum()), k, np.int32))
        keys, places, items = np.concatenate(key), np.concatenate(at).astype(np.int32), np.concatenate(item)
        order = np.argsort(keys, kind="stable")
        unique, first = np.unique(keys[order], return_index=True)
        return Seeds(size, unique, np.r_[first, len(keys)], items[order], places[order])

    def matcher(self, threshold: float) -> Callable[[list[bytes]], Iterator[tuple[int, int, float, int, int]]]:
        """Function from texts to (text number, item id, score, seeds, end word)."""
        indexes = [(s, s.bits()) for s in self.seeds]

        def run(texts: list[bytes]) -> Iterator[tuple[int, int, float, int, int]]:
            for block in blocks([t.translate(FOLD) for t in texts]):
                h, bounds = word_hashes(block)
                found: dict[tuple[int, int], list[int]] = defaultdict(list)
                for s, bits in indexes:
                    g = _shingles(h, s.size)
                    at = np.flatnonzero(bits[(g >> U(64 - _FILTER_BITS)).astype(np.int64)])
                    near = np.searchsorted(s.keys, g[at])
                    near[near == len(s.keys)] = 0
                    same = s.keys[near] == g[at]
                    at, near = at[same], near[same]
                    text = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + s.size <= bounds[text + 1]
                    for p, t, i in zip(at[inside].tolist(), text[inside].tolist(), near[inside].tolist()):
                        a, b = s.first[i], s.first[i + 1]
                        for k, q in zip(s.item[a:b].tolist(), s.at[a:b].tolist()):
                            found[t, k].append(p - q)
                two = _shingles(h, 2) if found else h
                for (t, k), starts in sorted(found.items()):
                    item, best, end = self.words[k], 0, 0
                    lo, hi = int(bounds[t]), int(bounds[t + 1])
                    # An accepted alignment has no more errors than this, so it lies within the reach of its seed.
                    pad = max(4, len(item) - math.ceil(threshold * len(item)))
                    for a, b in _runs(sorted(starts), len(item) + pad):
                        first, last = max(lo, a - pad), min(hi, b + len(item) + pad)
                        # Each error breaks one word pair at most: a copy keeps all but one of its score.
                        if np.isin(_shingles(item, 2), two[first : last - 1]).sum() + 1 < threshold * len(item):
                            continue
                        s, e = align(h[first:last], item)
                        if s > best:
                            best, end = s, first + e - lo
                    if best >= threshold * len(item):
                        yield block.lo + t, self.ids[k], best / len(item), len(starts), end

        return run


def _runs(starts: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """First and last of the places that lie within ``reach`` of the one before."""
    a = b = starts[0]
    for s in starts[1:]:
        if s - b > reach:
            yield a, b
            a = s
        b = s
    yield a, b


def item_blocks(benchmark: DataFrame, words: int, threshold: float, block_items: int) -> Iterator[Items]:
    """Indexes of at most ``block_items`` items each, one at a time; items without words are left out."""
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    batch: list[tuple[int, str]] = []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        batch.append((r["item_id"], r["text"]))
        if len(batch) == block_items:
            yield Items.build(batch, words, threshold)
            batch = []
    if batch:
        yield Items.build(batch, words, threshold)


def _hits(docs: DataFrame, items: Items, given: list[str], threshold: float) -> DataFrame:
    """Columns ``given`` of each match, with item_id, score, seeds, end_word."""
    shipped = docs.sparkSession.sparkContext.broadcast(items)  # at most one block of items
    added = (("item_id", pa.int64()), ("score", pa.float64()), ("seeds", pa.int64()), ("end_word", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shipped.value.matcher(threshold)
        for b in batches:
            found = list(match(as_bytes(b.column("text"))))
            row = pa.array([x[0] for x in found], pa.int64())
            yield pa.record_batch({c: b.column(c).take(row) for c in given} | {n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate(added, 1)})

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in given)
    return docs.select(*given, "text").mapInArrow(run, f"{schema}, item_id long, score double, seeds long, end_word long")


def _all_hits(docs: DataFrame, benchmark: DataFrame, given: list[str], words: int, threshold: float, block_items: int) -> DataFrame:
    """Hits of all blocks. Each block but the last is searched and its hits written before the next one is built, so one index is held at a time."""
    ws, parts, last = Workspace(docs.sparkSession, "leaks"), [], None
    for items in item_blocks(benchmark, words, threshold, block_items):
        if last is not None:
            parts.append(ws.put(_hits(docs, last, given, threshold)))
        last = items
    return reduce(DataFrame.unionByName, parts, _hits(docs, last or Items([], [], []), given, threshold))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.6, block_items: int = 200_000
) -> DataFrame:
    """doc_id, item_id, score, seeds, end_word for every text that holds an item.

    ``seeds`` counts the places of the text at which a seed of the item begins,
    a seed that the item repeats by its first and last place in it.
    Words are runs of letters and digits, A-Z in lower case. ``score`` is the
    best alignment score as a share of the item's words, at least
    ``threshold``. Whole texts are searched. Items without words match
    nothing; items shorter than ``words`` words must occur whole; null and empty
    texts hold nothing; repeated rows match each; other columns are ignored.
    """
    return _all_hits(docs, benchmark, ["doc_id"], words, threshold, block_items)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.6, block_items: int = 200_000
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item.

    A benchmark of one block is looked for while the rows pass by. Of more
    blocks, the hits of each are written and the rows that have any are left
    out by a join on their places.
    """
    spark = docs.sparkSession
    blocks_ = item_blocks(benchmark, words, threshold, block_items)
    items, more = next(blocks_, None), next(blocks_, None)
    if items is None:
        return docs
    if more is None:
        shipped = spark.sparkContext.broadcast(items)  # one block of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = shipped.value.matcher(threshold)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in match(as_bytes(b.column("text")))]] = False
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    ws = Workspace(spark, "leaks")
    rows, at = with_place(docs, ws)
    parts = [ws.put(_hits(rows, x, at, threshold).select(*at).distinct()) for x in chain([items, more], blocks_)]
    return rows.join(reduce(DataFrame.union, parts).distinct(), at, "left_anti").select(*docs.columns)

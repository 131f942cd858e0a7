"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of hashed features: its words, the
character n-grams of its words (word edges included), and whether a word
repeats the one before it. A softmax layer gives the probability. Training is
plain numpy stochastic gradient descent on a bounded sample. For two classes
the softmax of a mean is the sigmoid of a mean of scalars, one per bucket, so
scoring needs only that scalar table: a gather and a sum per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm._bytes import _IS_BLANK, TABLE as TABLE_CASED, Block, U, as_bytes, blocks, powers, range_hash, segment_sums
from textloom.llm._labelled import training_sample

BITS = 16
BUCKETS = 1 << BITS
NGRAMS = (3, 4, 5)
REPEAT = 0  # bucket of "the same word again"
FRESH = 1  # bucket of "another word"


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h * U(2 * salt + 0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64)


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds by text) for each kind of feature of a block."""
    sums = block.sums(TABLE_CASED)
    a, b = block.words()
    h = range_hash(sums, a, b)
    by_word = block.words_in(a)
    yield np.maximum(_bucket(h, 1), 2), by_word
    same = np.where(np.r_[False, h[1:] == h[:-1]], REPEAT, FRESH)
    first = by_word[:-1][by_word[:-1] < len(a)]
    same[first] = FRESH
    yield same, by_word
    blank = np.r_[0, np.cumsum(_IS_BLANK[block.data])]
    inverse = powers(len(sums))[1]
    for n in NGRAMS:
        at = np.arange(len(block.data) - n + 1)
        # No blank but at the edges: an n-gram of one word.
        at = at[(blank[n - 1 : len(blank) - 1][: len(at)] == blank[1 : len(at) + 1])]
        g = (sums[at + n] - sums[at]) * inverse[at]
        g ^= g >> U(31)
        yield np.maximum(_bucket(g, n), 2), np.searchsorted(at, np.r_[block.starts - 1, len(block.data)])


@dataclass
class Model:
    """Weight of each bucket and the offset of the log-odds."""

    weights: np.ndarray
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for block in blocks(texts):
            total, count = np.zeros(block.hi - block.lo), np.zeros(block.hi - block.lo)
            for buckets, bounds in features(block):
                total += segment_sums(self.weights[buckets], bounds)
                count += np.diff(bounds)
            out[block.lo : block.hi] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.offset, -60, 60)))


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 1
) -> Model:
    """SGD over (buckets, counts, label); vectors of ``dim`` numbers, two softmax outputs."""
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    W, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    y = np.array([r[2] for r in rows])
    if len(rows):
        p = np.clip(np.bincount(y, minlength=2) / len(y), 1e-3, 1)
        bias = np.log(p).astype(np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, counts, label = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            v = share @ E[ids]
            z = v @ W + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[label] -= 1
            back = W @ g
            W -= lr * 0.25 * np.outer(v, g)
            bias -= 0.01 * lr * g
            E[ids] -= (lr * len(ids) ** 0.5 * share)[:, None] * back
    return Model((E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sample_features(sample: DataFrame) -> DataFrame:
    """ids and counts of the features of each labelled text, packed as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text"))
            ids: list[bytes] = []
            counts: list[bytes] = []
            for block in blocks(texts):
                parts = list(features(block))
                for k in range(block.hi - block.lo):
                    all_ = np.concatenate([x[bounds[k] : bounds[k + 1]] for x, bounds in parts])
                    i, c = np.unique(all_, return_counts=True)
                    ids.append(i.astype(np.uint16).tobytes())
                    counts.append(c.astype(np.float32).tobytes())
            yield pa.record_batch(
                {"ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary()), "label": b.column("label").cast(pa.int32())}
            )

    return sample.mapInArrow(run, "ids binary, counts binary, label int")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 3_000, **how) -> Model:
    """Learn from at most ``limit`` labelled rows, the first by hash of doc_id."""
    got = sample_features(training_sample(docs, labels, label, limit)).collect()  # at most ``limit`` rows
    rows = [(np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.float32), r["label"]) for r in got]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))  # the order of collecting must not matter
    return train(rows, **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row: the probability of label 1.

    Whole texts are read. Null and empty texts have no feature and score by
    the offset alone; repeated rows are scored each; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(shipped.value.scores(as_bytes(b.column("text"))), pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")

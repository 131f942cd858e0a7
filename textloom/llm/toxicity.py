"""Toxicity by maximum-scoring segments of token log-odds.

Learning: log-odds of tokens between toxic and other labelled documents, with
a Dirichlet prior; a token scores only if its log-odds are significant, minus
one standard error. Rare forms back off to the log-odds of their first five or
four bytes. All other tokens score a small negative amount, so the
expected score of clean text is negative and toxic passages are the maximal
scoring segments, all of which one linear scan finds. Segment scores follow an
extreme-value law: in n clean tokens, K * n * exp(-lambda * s) segments of
score s are expected. A document's evidence is the sum of lambda * s - ln(K n)
over its significant segments, and a logistic fit turns it into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._bytes import as_bytes
from textloom.llm._labelled import fit_logistic, training_sample

#: Letters and digits in lower case, bytes of other scripts as they are, blanks for the rest.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def keys(token: bytes) -> list[bytes]:
    """What stands for a token, most specific first: itself, then its beginnings."""
    return [token, *(token[:k] + b"*" for k in (5, 4) if len(token) > k)]


@dataclass
class Model:
    """Token scores and the constants of the extreme-value law."""

    scores: dict[bytes, float] = field(default_factory=dict)
    heads: frozenset[bytes] = frozenset()
    drop: float = 0.1
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum of normalised scores of the significant segments."""
        at = self.log_k + math.log(max(n, 1))
        return sum(max(0.0, self.lam * s - at) for _, _, s in segments)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def maximal_segments(hits: Iterable[tuple[int, float]], drop: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score).

    ``hits`` are (position, positive score); every other token scores -drop.
    A stack holds candidate segments with the running total before and after
    each; a new one is merged with the latest candidate that starts lower, as
    long as it ends higher than that candidate. Each candidate keeps the place
    of the latest one before it that starts lower: what lies between starts no
    lower than it, so a search follows these links and all of them take time
    linear in the number of hits.
    """
    out: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for at, score in hits:
        total -= drop * (at - last - 1)
        first, low = at, total
        total += score
        k = len(out) - 1
        while True:
            while k >= 0 and out[k][2] >= low:
                k = out[k][4]
            if k < 0 or out[k][3] >= total:
                break
            first, _, low, _, lower = out[k]
            del out[k:]
            k = lower
        out.append((first, at, low, total, k))
        last = at
    return [(a, b, high - low) for a, b, low, high, _ in out]


def segments_of(text: bytes, model: Model) -> tuple[list[tuple[int, int, float]], int]:
    words = tokens(text)
    heads, hits = model.heads, []
    for i, w in enumerate(words):
        if w[:4] in heads:
            score = next((model.scores[k] for k in keys(w) if k in model.scores), 0.0)
            if score:
                hits.append((i, score))
    return maximal_segments(hits, model.drop), len(words)


def count_tokens(sample: DataFrame) -> DataFrame:
    """token, toxic, other: documents of each kind that hold the key; the empty one counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (Counter(), Counter())
        for b in batches:
            for text, y in zip(as_bytes(b.column("text")), b.column("label").to_pylist()):
                kinds[y].update({k for w in set(tokens(text)) for k in keys(w)})
                kinds[y][b""] += 1
        seen = list({**kinds[0], **kinds[1]})
        if seen:
            yield pa.record_batch(
                {"token": pa.array(seen, pa.binary()), "toxic": pa.array([kinds[1][w] for w in seen], pa.int64()), "other": pa.array([kinds[0][w] for w in seen], pa.int64())}
            )

    return (
        sample.mapInArrow(count, "token binary, toxic long, other long")
        .groupBy("token")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = 12_000,
    prior: float = 0.5, z: float = 2.7, least_odds: float = 3.0, drop: float = 0.1,
) -> Model:
    """Learn from at most ``limit`` labelled rows; every token of theirs that is significant scores.

    A token needs log-odds of ``z`` standard errors and, less one standard
    error, of ``least_odds``: mere topic words add up in long texts.
    """
    sample = training_sample(docs, labels, label, limit)
    counts = count_tokens(sample)
    kinds = counts.filter(F.col("token") == F.lit(b"")).collect()
    model = Model(drop=drop)
    if not kinds or not kinds[0]["toxic"] or not kinds[0]["other"]:
        y = (kinds[0]["toxic"] + 0.5) / (kinds[0]["toxic"] + kinds[0]["other"] + 1) if kinds else 0.5
        model.offset = math.log(y / (1 - y))
        return model
    n1, n0 = float(kinds[0]["toxic"]), float(kinds[0]["other"])
    a1, a0 = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(a1 / (n1 + 2 * prior - a1)) - F.log(a0 / (n0 + 2 * prior - a0))
    error = F.sqrt(1 / a1 + 1 / a0)
    scored = (
        counts.filter((F.col("token") != F.lit(b"")) & (F.col("toxic") >= 3) & (F.col("toxic") < n1))
        .select("token", "other", odds.alias("odds"), error.alias("error"), F.sqrt(1 / a1).alias("one"))
        .filter((F.col("odds") / F.col("error") >= z) & (F.col("odds") - F.col("one") >= least_odds))
        .orderBy("token")
        .collect()  # tokens of at most ``limit`` texts
    )
    model.scores = {bytes(r["token"]): r["odds"] - r["one"] for r in scored}
    model.heads = frozenset(k.rstrip(b"*")[:4] for k in model.scores)
    # lambda: the root of E[exp(lambda * score)] = 1 over the tokens of clean text.
    clean = {bytes(r["token"]): (r["other"] + prior) / n0 for r in scored}
    shipped = model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segments_of(t, shipped) for t in as_bytes(b.column("text"))]
            yield pa.record_batch(
                {
                    "label": b.column("label").cast(pa.int32()), "n": pa.array([n for _, n in found], pa.int64()),
                    "segments": pa.array([[s for _, _, s in seg] for seg, _ in found], pa.list_(pa.float64())),
                }
            )

    seen = sample.mapInArrow(measure, "label int, n long, segments array<double>").collect()  # at most ``limit`` short rows
    per_doc = sum(r["n"] for r in seen if not r["label"]) / max(1.0, n0)
    p = np.array([clean[w] / max(per_doc, 1.0) for w in model.scores])
    s = np.array(list(model.scores.values()))
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        grown = float((p * np.exp(mid * s)).sum() + (1 - p.sum()) * math.exp(-mid * drop))
        lo, hi = (mid, hi) if grown < 1 else (lo, mid)
    model.lam = lo
    # K: segments seen in clean documents against those the law expects, at the lowest score.
    least = float(s.min()) if len(s) else 1.0
    many = sum(len(r["segments"]) for r in seen if not r["label"]) + 0.5
    words = sum(r["n"] for r in seen if not r["label"]) + 1
    model.log_k = math.log(many / words) + model.lam * least
    x = np.array([model.evidence([(0, 0, v) for v in r["segments"]], r["n"]) for r in seen])
    y = np.array([r["label"] for r in seen])
    model.slope, model.offset = fit_logistic(x, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence, n_tokens, segments for every row.

    Every token of a text is read. A null or empty text has no segment and the
    score of no evidence; repeated rows are scored each; other columns are
    ignored. ``segments`` holds first token, last token (from 0) and score.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # tokens of at most ``limit`` labelled texts
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            found = [segments_of(t, m) for t in as_bytes(b.column("text"))]
            x = [m.evidence(seg, n) for seg, n in found]
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"), "score": pa.array([m.probability(v) for v in x], pa.float64()),
                    "evidence": pa.array(x, pa.float64()), "n_tokens": pa.array([n for _, n in found], pa.int64()),
                    "segments": pa.array([[dict(zip(("first", "last", "score"), s)) for s in seg] for seg, _ in found], kind),
                }
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, score double, evidence double, n_tokens long, segments array<struct<first:int,last:int,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            found = (segments_of(t, m) for t in as_bytes(b.column("text")))
            yield b.filter(pa.array([m.probability(m.evidence(seg, n)) < threshold for seg, n in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

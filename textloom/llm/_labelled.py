"""Bounded samples of labelled rows, for the operators that learn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import Workspace


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of doc_id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, n_text: str = "text") -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents, the first by hash of doc_id.

    Labels of one doc_id that contradict each other are left out, as are null
    labels and labels other than 0 and 1. Of several rows with one doc_id the
    text of the least hash is taken, so the bound holds for repeated rows too.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
        .select("doc_id", "label")
    )
    # At most ``limit`` narrow rows, so the text side meets them without a shuffle. Written, as it is read several times.
    found = docs.select("doc_id", n_text).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label")
    return Workspace(docs.sparkSession, "sample").put(found.agg(F.min_by(n_text, F.xxhash64(n_text)).alias(n_text)).select(n_text, "label"))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1) = sigmoid(slope * x + offset), by Newton's method."""
    X = np.column_stack([x, np.ones_like(x)]).astype(float)
    w, ridge = np.zeros(2), np.diag([l2, 1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + ridge @ w
        h = (X * (p * (1 - p))[:, None]).T @ X + ridge
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])

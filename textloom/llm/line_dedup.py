"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps counts of line keys the way a log-structured store does.
Each batch of documents is counted, merge-anti-joined against the settled keys
(those known to be frequent, which need no further counting) and, for
``first_seen``, against every run; what is left is written as a sorted run of
level 0. Each time a level holds ``fanout`` runs they are merged into one
sorted run of the next level, and keys that have reached the threshold move to
the settled runs. Runs hold 128-bit hashes and counts, never text. All of it
is DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import BLANKS, Workspace, ascii_lower

KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7919), key).alias("k2"))


class LineRuns:
    """Document counts of line keys in levelled sorted runs."""

    def __init__(self, ws: Workspace, threshold: int, fanout: int = 4):
        self.ws, self.threshold, self.fanout = ws, threshold, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _run(self, counts: DataFrame) -> DataFrame:
        return self.ws.put(counts.select(*KEY, "n").sortWithinPartitions(*KEY))

    def known(self) -> DataFrame | None:
        """Keys of every run, settled ones included."""
        runs = [r.select(*KEY) for level in self.levels for r in level] + [s.select(*KEY) for s in self.settled]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def first_seen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key no earlier batch had."""
        known = self.known()
        return keys if known is None else keys.join(known, KEY, "left_anti")

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (k1, k2, n): documents of the batch that hold the key."""
        for done in self.settled:
            counts = counts.join(done, KEY, "left_anti")
        self.levels[0].append(self._run(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def _merge(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        merged = self.ws.put(reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n").alias("n")))
        for r in runs:
            self.ws.drop(r)
        self.settled.append(self._run(merged.filter(F.col("n") >= self.threshold)))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._run(merged.filter(F.col("n") < self.threshold)))
        self.ws.drop(merged)

    def frequent(self) -> DataFrame:
        """Keys in at least ``threshold`` documents of all batches so far."""
        open_ = [r for level in self.levels for r in level]
        parts = [s.select(*KEY) for s in self.settled]
        if open_:
            total = reduce(DataFrame.unionByName, open_).groupBy(*KEY).agg(F.sum("n").alias("n"))
            parts.append(total.filter(F.col("n") >= self.threshold).select(*KEY))
        return reduce(DataFrame.unionByName, parts).distinct()


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 6, fanout: int = 3
) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row.

    Lines whose key has at least ``min_chars`` code points and stands in at
    least ``min_docs`` documents are dropped everywhere. ``docs`` needs doc_id
    and text; other columns are ignored. A null or empty text is one empty
    line and stays; lines of blanks have the empty key and stay; rows with
    equal doc_id are separate documents; an empty table gives an empty result.
    Work is linear in the lines of a text.

    Batches are hash ranges of the documents. With more batches than
    ``fanout``, keys that reach the threshold early are settled by a merge, and
    later batches lose them by an anti-join before they make runs.
    """
    ws = Workspace(docs.sparkSession, "lines")
    runs = LineRuns(ws, min_docs, fanout)
    # Rows with equal doc_id and text lose the same lines, so two hashes may stand for a row.
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(7919), "doc_id", "text").alias("r2"))
    keys = F.transform(lines_of(F.col("text")), line_key)
    long_enough = (lambda a: F.filter(a, lambda k: F.length(k) >= min_chars)) if min_chars > 0 else (lambda a: a)
    # Strings are told apart by a hash set, which structs are not.
    hashed = F.transform(F.array_distinct(long_enough(keys)), key_hash)
    batch = F.pmod(F.shiftright("r1", 17), F.lit(batches)).cast("int")
    # One scan counts every batch; each is then a part of the written table.
    counted = ws.put(
        rows.select(batch.alias("batch"), F.explode(hashed).alias("k"))
        .groupBy("batch", "k.k1", "k.k2")
        .agg(F.count(F.lit(1)).alias("n")),
        "batch",
    )
    for b in range(batches):
        runs.add(counted.filter(F.col("batch") == b).select(*KEY, "n"))
    frequent = ws.put(runs.frequent())
    ws.keep(frequent)
    # The places of the lines that each row loses, in their order.
    at = rows.select("r1", "r2", F.posexplode(keys).alias("at", "key")).filter(F.length("key") >= min_chars)
    lost = (
        at.select("r1", "r2", "at", key_hash(F.col("key")).alias("k")).select("r1", "r2", "at", "k.k1", "k.k2")
        .join(frequent, KEY, "left_semi")
        .groupBy("r1", "r2")
        # A set, as repeated rows name each place as often as they stand.
        .agg(F.sort_array(F.collect_set("at")).alias("lost"))
    )
    split = rows.select("doc_id", "r1", "r2", lines_of(F.col("text")).alias("lines"))
    joined = split.join(lost, ["r1", "r2"], "left").select("doc_id", "lines", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    # What lies between two lost lines stays: one slice each, so no line is looked up.
    before = F.concat(F.array(F.lit(-1)), F.col("lost"))
    after = F.concat(F.col("lost"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice("lines", a + 2, b - a - 1)))
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )

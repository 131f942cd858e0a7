"""Near-duplicate documents by SetSketch registers, banding and verification.

A document is the set of its distinct five-word shingles. Equal documents are
collapsed first. The sketch of a set has registers with exponentially spaced
truncated minima, ``floor(1 - log_b(min hash))``: the register of a union is
the larger of the two, and registers of similar sets agree. Bands of registers
give buckets. In each bucket every document is compared with the bucket's
smallest one: a likelihood estimate of the similarity from the registers that
agree, are larger or smaller (joint estimation with known set sizes) screens
pairs far below the threshold, and the full sets decide.

That finds nearly all components but not all links, so buckets whose members
still differ in component are taken up again. A member that has too many
shingles nobody else has cannot reach the threshold with anybody and leaves;
what is left is compared in blocks, each pair once, in the first band it
shares. No pair that shares a band is given up, no group is held by one task,
and pairs of one component are never listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._bytes import U, Block, as_bytes, blocks, mix, range_hash
from textloom.llm._util import Workspace
from textloom.llm.components import components
from textloom.operators.sized import sized_broadcast


@dataclass(frozen=True)
class Sketch:
    """Registers, bands and the base of the truncation.

    42 bands of 6 registers miss a pair of similarity 0.85 with probability
    2e-9.
    """

    bands: int = 42
    rows: int = 6
    base: float = 1.001
    words: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        c = np.random.default_rng(77).integers(0, 2**31, (2, self.size, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        return c[0], c[1]

    def registers(self, shingles: np.ndarray, mul: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Registers (uint16) of one set of 64-bit shingle hashes."""
        low = np.full(self.size, 2**32 - 1, np.uint32)
        for i in range(0, len(shingles), 4096):
            part = shingles[i : i + 4096]
            a, b = (part & U(0xFFFFFFFF)).astype(np.uint32), (part >> U(32)).astype(np.uint32)
            h = a[None] * mul[0]
            h += b[None] * mul[1]
            np.minimum(low, h.min(axis=1), out=low)
        least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32)
        return np.clip(np.floor(1 - np.log(least) / math.log(self.base)), 0, 2**16 - 1).astype(np.uint16)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        c = np.random.default_rng(78).integers(1, 2**63, (1, self.rows), dtype=np.uint64)
        h = (registers.astype(U).reshape(self.bands, self.rows) + U(1)) * c
        return mix(mix(h).sum(axis=1) + np.arange(self.bands, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)

    def similarity(self, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Most likely Jaccard similarity, given how many registers are larger and smaller."""
        equal = self.size - more - less
        u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
        grid = np.linspace(0, 1, 101)[:, None]
        b = self.base

        def p(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / math.log(b)

        up, down = p(u - v * grid), p(v - u * grid)
        top = np.minimum(u / v, v / u)
        like = more * np.log(up + 1e-12) + less * np.log(down + 1e-12) + equal * np.log(np.maximum(1 - up - down, 1e-12))
        like = np.where(grid <= top + 0.01, like, -np.inf)
        return grid[like.argmax(axis=0), 0]


def shingle_sets(block: Block, words: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(sorted distinct shingle hashes, digest of the word sequence) of each text."""
    sums = block.sums()
    a, b = block.words()
    h = range_hash(sums, a, b)
    bounds = block.words_in(a)
    mult = [U(pow(0x9E3779B97F4A7C15, 3 * i + 1, 2**64)) for i in range(words)]
    n = max(0, len(h) - words + 1)
    long = np.zeros(n, U)
    for i in range(words):
        long += h[i : n + i] * mult[i]
    long = mix(long)
    for k in range(block.hi - block.lo):
        lo, hi = bounds[k], bounds[k + 1]
        digest = hashlib.md5(h[lo:hi].tobytes()).digest()
        if hi - lo >= words:
            yield np.unique(long[lo : hi - words + 1]), digest
        elif hi > lo:
            yield np.frombuffer(hashlib.md5(b"short" + h[lo:hi].tobytes()).digest()[:8], U), digest
        else:
            yield np.zeros(0, U), digest


def signatures(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """The columns but the text, with n, k1, k2 (identity of the word sequence), bands (null for empty sets)."""
    given = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul = sketch.multipliers()
        for batch in batches:
            n: list[int] = []
            keys: list[np.ndarray] = []
            bands: list[np.ndarray | None] = []
            for block in blocks(as_bytes(batch.column("text"))):
                for s, digest in shingle_sets(block, sketch.words):
                    n.append(len(s))
                    keys.append(np.frombuffer(digest, np.int64))
                    bands.append(sketch.band_keys(sketch.registers(s, mul)) if len(s) else None)
            yield pa.record_batch(
                {c: batch.column(c) for c in given}
                | {
                    "n": pa.array(n, pa.int64()),
                    "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in given)
    return docs.select(*given, "text").mapInArrow(run, f"{schema}, n long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """k1, k2, n, registers, shingles (both packed) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul = sketch.multipliers()
        for batch in batches:
            found = [x for block in blocks(as_bytes(batch.column("text"))) for x in shingle_sets(block, sketch.words)]
            sets, keys = [s for s, _ in found], [np.frombuffer(d, np.int64) for _, d in found]
            yield pa.record_batch(
                {
                    "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "registers": pa.array([sketch.registers(s, mul).tobytes() for s in sets], pa.binary()),
                    "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                }
            )

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, n long, registers binary, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _registers(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, size)


def verify(pairs: DataFrame, sketch: Sketch, percent: int, screen: float) -> DataFrame:
    """a, b of the pairs (a, b, a_*, b_*) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (_registers(batch.column(f"{x}_registers"), sketch.size) for x in "ab")
            na, nb = (batch.column(f"{x}_n").to_numpy().astype(float) for x in "ab")
            near = sketch.similarity((ra > rb).sum(1), (ra < rb).sum(1), na, nb) >= screen
            sa, sb = batch.column("a_shingles"), batch.column("b_shingles")
            keep = [
                i for i in np.flatnonzero(near).tolist()
                if linked(np.frombuffer(sa[i].as_py(), U), np.frombuffer(sb[i].as_py(), U), percent)
            ]
            yield pa.record_batch({"a": batch.column("a").take(pa.array(keep, pa.int64())), "b": batch.column("b").take(pa.array(keep, pa.int64()))})

    return pairs.mapInArrow(run, "a long, b long")


def compare_blocks(members: DataFrame, sketch: Sketch, percent: int, screen: float) -> DataFrame:
    """Links between members of different labels in blocks (band, lo, hi).

    ``members`` has band, lo, hi, block, at (number of the band), doc_id,
    label, n, registers, shingles. A pair is compared in the first band that
    both share, once per pair of blocks; pairs already joined there are passed.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, label = table.column("doc_id").to_numpy(), table.column("label").to_numpy()
        block, n = table.column("block").to_numpy(), table.column("n").to_numpy().astype(float)
        lo, hi, at = (table.column(c)[0].as_py() for c in ("lo", "hi", "at"))
        regs = _registers(table.column("registers").combine_chunks(), sketch.size)
        sets = [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        out: list[tuple[int, int]] = []
        bands = regs.reshape(len(ids), sketch.bands, sketch.rows)
        right = np.flatnonzero(block == hi)
        for i in np.flatnonzero(block == lo):
            j = right[(label[right] != label[i]) & ((right > i) | (lo != hi))]
            big, small = np.maximum(n[j], n[i]), np.minimum(n[j], n[i])
            j = j[100 * small >= percent * big]
            if not len(j):
                continue
            agree = (bands[j] == bands[i]).all(axis=2)
            j = j[agree.argmax(axis=1) == at]
            if not len(j):
                continue
            est = sketch.similarity((regs[j] > regs[i]).sum(1), (regs[j] < regs[i]).sum(1), n[j], np.full(len(j), n[i]))
            for k in j[np.argsort(-est, kind="stable")][: int((est >= screen).sum())]:
                x, y = find(int(label[i])), find(int(label[k]))
                if x != y and linked(sets[i], sets[k], percent):
                    root[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), int(ids[k])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return members.groupBy("band", "lo", "hi").applyInArrow(run, "a long, b long")


def remaining_links(
    buckets: DataFrame, feats: DataFrame, roots: DataFrame, ws: Workspace, sketch: Sketch, percent: int, screen: float, block_rows: int
) -> DataFrame:
    """Links that the comparison with each bucket's smallest member did not see."""
    named = buckets.join(roots, buckets.doc_id == roots.node, "left").select(
        "band", "at", "doc_id", "hub", F.coalesce("root", "doc_id").alias("label")
    )
    named = ws.put(named)
    other = F.when(F.col("doc_id") != F.col("hub"), F.col("label"))
    mixed = named.groupBy("band").agg(F.min(other).alias("x"), F.max(other).alias("y")).filter("x <> y").select("band")
    open_ = ws.put(named.join(mixed, "band", "left_semi"))
    ids = open_.select("doc_id").distinct()
    # Shingles that only one open document has; no pair shares them.
    held = ws.put(feats.join(ids, "doc_id", "left_semi"))
    unique = (
        unpack(held).groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("doc_id"))
        .filter("docs = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique"))
    )
    reach = ws.put(
        held.select("doc_id", "n").join(unique, "doc_id", "left").select("doc_id", "n", (F.col("n") - F.coalesce("unique", F.lit(0))).alias("common"))
    )
    sized = open_.join(reach, "doc_id")
    least = sized.groupBy("band").agg(F.min("n").alias("least"))
    # At best a document shares all its common shingles with the smallest member.
    best = F.col("common") * 100 >= percent * (F.col("n") + F.greatest("least", "common") - F.col("common"))
    able = ws.put(sized.join(least, "band").filter(best).select("band", "at", "doc_id", "label"))
    size = able.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    # Few bands stay mixed; shipped to the members, they leave no task with all of one band.
    size = ws.put(size.select("band", "m"))
    placed = able.join(sized_broadcast(size, size.count()), "band").withColumn("blocks", F.ceil(F.col("m") / block_rows).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # A block meets every other block and itself.
    spread = placed.select(
        "band", "at", "doc_id", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mate")
    ).withColumn("lo", F.least("block", "mate")).withColumn("hi", F.greatest("block", "mate"))
    return compare_blocks(spread.drop("mate").join(held, "doc_id"), sketch, percent, screen)


def unpack(feats: DataFrame) -> DataFrame:
    """doc_id, shingle: one row for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for i, packed in enumerate(batch.column("shingles").to_pylist()):
                s = np.frombuffer(packed, np.int64)
                yield pa.record_batch({"doc_id": pa.array(np.full(len(s), ids[i])), "shingle": pa.array(s)})

    return feats.select("doc_id", "shingles").mapInArrow(run, "doc_id long, shingle long")


def near_duplicates(
    docs: DataFrame, percent: int = 85, sketch: Sketch = Sketch(), slack: float = 0.15, block_rows: int = 256, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node for every row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets. Words part at blanks and A-Z are lower-cased; a text with
    fewer than five words is one shingle; a text without words (null, empty,
    blank) has none and is linked with nothing, as is a row without doc_id.
    ``component_id`` is the smallest doc_id reachable, ``node`` a number of the
    component (null where nothing can be linked). Texts are what is linked:
    repeated rows agree, and of several texts under one doc_id each has links
    of its own. Other columns are ignored, but for those named in ``carry``,
    which come back with their row; an empty table gives an empty result.
    Estimates more than ``slack`` under the threshold (over six standard
    errors) are not verified.
    """
    ws = Workspace(docs.sparkSession, "near")
    held = [f"carry{i}" for i in range(len(carry))]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(h) for c, h in zip(carry, held)])
    screen = percent / 100 - slack
    sig = ws.put(signatures(docs, sketch))
    # One node for each distinct word sequence, numbered in the written table.
    texts = sig.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    texts = ws.put(texts.withColumn("node", F.monotonically_increasing_id()))
    own = sig.join(texts.withColumnRenamed("rep", "doc_id"), ["doc_id", "k1", "k2"]).select(F.col("node").alias("doc_id"), "bands").dropDuplicates(["doc_id"])
    banded = ws.put(own.select("doc_id", F.posexplode("bands").alias("at", "band")))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    buckets = ws.put(banded.join(hubs, "band"))
    ws.drop(banded)
    pairs = ws.put(buckets.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = ws.put(texts.join(ids, "node", "left_semi"))
    # A merge join at every size: a broadcast of few ids would only hide what many cost.
    near = docs.join(needed.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    found = full_sets(near, sketch).dropDuplicates(["k1", "k2"]).join(needed.drop("rep").hint("merge"), ["k1", "k2"])
    feats = ws.put(found.select(F.col("node").alias("doc_id"), "n", "registers", "shingles"))
    side = lambda x: feats.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "registers", "shingles")])
    links = ws.put(verify(pairs.join(side("a"), "a").join(side("b"), "b"), sketch, percent, screen))
    roots = ws.put(components(links, ws))
    more = ws.put(remaining_links(buckets, feats, roots, ws, sketch, percent, screen, block_rows))
    roots = ws.put(components(links.unionByName(more), ws))
    # The smallest doc_id of each component of several texts.
    named = texts.join(roots, "node").groupBy("root").agg(F.min("rep").alias("least"))
    named = ws.put(roots.join(named, "root").select("node", "root", "least"))
    ws.keep(sig, texts, named)
    of_text = texts.join(named, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("node"), F.coalesce("least", "rep").alias("component"))
    out = sig.drop("bands").join(of_text, ["k1", "k2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.when(~alone, F.col("node")).alias("node"), *[F.col(h).alias(c) for c, h in zip(carry, held)],
    )

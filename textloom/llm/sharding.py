"""Sharding by balanced label propagation.

Documents that share a link key (equal texts, by default) should meet in one
shard while shards hold the same number of rows, at most one apart. Every
document starts in a shard given by its digest. In each round, Spark joins
tell every document in which shard most of its linked documents are; documents
that want from shard s to t and from t to s are swapped in equal numbers, so
sizes stay even (the capacity quota). Groups larger than a shard are dealt
first: each fills whole shards, its rest the room that fits it, and unlinked
documents give way. A last step moves the few surplus
documents, unlinked ones first, to bring counts within one, and numbers the
slots. All of it is DataFrame code over narrow rows; groups of any size are
only ever counted, and ranks come from bucketed running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import Workspace, rows_per_bucket, running_total, spread
from textloom.operators.sized import sized_broadcast


def _share_of(salt: str, *cols: str) -> Column:
    """A number in [0, 1) from a hash of columns and a salt."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(2**31)) / F.lit(float(2**31))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def propagate_once(rows: DataFrame, n_shards: int, salt: str, n_groups: int) -> DataFrame:
    """One round: rows (.., h, link1, link2, shard, linked) with new shards.

    A group's preferred shard is the one that holds most of it, ties broken by a
    new hash in each round so that wishes balance. A group larger than a shard's capacity
    has been dealt out (``deal_large``) and stays.
    Of the d(s, t) documents that want from s to t, min(d(s, t), d(t, s)) move
    in expectation, chosen by digest. There are ``n_groups`` groups: few are
    shipped to the rows, so no task holds a large one.
    """
    held = rows.filter("linked").groupBy("link1", "link2", "shard").agg(F.count(F.lit(1)).alias("n"))
    best = held.groupBy("link1", "link2").agg(
        F.max(F.struct("n", F.xxhash64(F.lit(salt), "link1", "shard").alias("tie"), "shard")).alias("best"), F.sum("n").alias("all")
    )
    best = best.select("link1", "link2", F.col("best.shard").alias("goal"), "all")
    aim = rows.join(sized_broadcast(best, n_groups), ["link1", "link2"], "left")
    fits = F.col("all") <= F.col("capacity")
    aim = aim.withColumn("goal", F.when(F.col("linked") & fits, F.coalesce("goal", "shard")).otherwise(F.col("shard")))
    wish = aim.filter("goal <> shard").groupBy("shard", "goal").agg(F.count(F.lit(1)).alias("d"))
    back = wish.select(F.col("shard").alias("goal"), F.col("goal").alias("shard"), F.col("d").alias("r"))
    # At most n_shards * (n_shards - 1) rows.
    quota = wish.join(back, ["shard", "goal"], "left").select(
        "shard", "goal", (F.least("d", F.coalesce("r", F.lit(0))) / F.col("d")).alias("share")
    )
    moved = aim.join(F.broadcast(quota), ["shard", "goal"], "left")
    go = F.coalesce(_share_of(salt, "h") < F.col("share"), F.lit(False))
    return moved.withColumn("shard", F.when(go, F.col("goal")).otherwise(F.col("shard"))).drop("goal", "all", "share")


def _goals(n: int, n_shards: int) -> dict[int, int]:
    return {s: n // n_shards + (s < n % n_shards) for s in range(n_shards)}


def places(sizes: list[int], n: int, n_shards: int) -> list[list[tuple[int, int]]]:
    """(shard, rows) for groups of these sizes: whole shards, then each rest, largest first, in the tightest room or, if none
    holds it, in the roomiest ones."""
    room, out = _goals(n, n_shards), [[] for _ in sizes]
    left = list(sizes)

    def put(g: int, s: int) -> None:
        take = min(left[g], room[s])
        out[g].append((s, take))
        left[g] -= take
        room[s] -= take

    for whole in (True, False):
        for g in sorted(range(len(sizes)), key=lambda g: -left[g]):
            while left[g]:
                empty = [s for s, r in room.items() if left[g] >= r == n // n_shards + (s < n % n_shards)]
                fits = [s for s, r in room.items() if r >= left[g]]
                if whole and not empty:
                    break
                put(g, empty[0] if whole else min(fits, key=lambda s: (room[s], s)) if fits else max(room, key=lambda s: (room[s], -s)))
    return out


def deal_large(rows: DataFrame, large: list, n_shards: int, n: int) -> DataFrame:
    """Rows of the groups ``large`` (link1, link2, n), which shards cannot hold, by hash to the shards of ``places``."""
    to, u = F.col("shard"), _share_of("large", "h", "doc_id")
    for group, parts in zip(large, places([g["n"] for g in large], n, n_shards)):
        home, upto = F.lit(parts[-1][0]), group["n"] - parts[-1][1]
        for s, k in reversed(parts[:-1]):
            home = F.when(u < upto / group["n"], F.lit(s)).otherwise(home)
            upto -= k
        to = F.when((F.col("link1") == group["link1"]) & (F.col("link2") == group["link2"]), home).otherwise(to)
    return rows.withColumn("shard", to.cast("int"))


def even_out(rows: DataFrame, ws: Workspace, n_shards: int, n: int) -> DataFrame:
    """Move surplus rows so that counts differ by one at most.

    Surplus rows are ranked within their shard, unlinked rows first and those of
    groups larger than a shard last, and given to the shards that lack rows in the order of that rank.
    """
    sizes = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # n_shards rows
    goal = _goals(n, n_shards)
    surplus = {s: max(0, sizes.get(s, 0) - goal[s]) for s in goal}
    lacking = [(s, goal[s] - sizes.get(s, 0)) for s in goal if goal[s] > sizes.get(s, 0)]
    if not lacking:
        return rows
    over = F.element_at(F.array(*[F.lit(surplus[s]) for s in range(n_shards)]), F.col("shard") + 1)
    buckets = rows_per_bucket(n)
    late = F.when(F.col("large"), 2 * buckets).when(F.col("linked"), buckets).otherwise(0)
    keyed = rows.withColumn("bucket", spread(F.col("h"), buckets) + late)
    ranked = running_total(keyed.withColumn("one", F.lit(1)), ["shard"], "bucket", [F.col("h"), F.col("doc_id")], "one", "rank")
    before, offset = {}, 0
    for s in range(n_shards):
        before[s], offset = offset, offset + surplus[s]
    start = F.element_at(F.array(*[F.lit(before[s]) for s in range(n_shards)]), F.col("shard") + 1)
    place, to, upto = F.col("rank") - 1 + start, F.col("shard"), 0
    new = to
    for s, room in lacking:
        new = F.when((place >= upto) & (place < upto + room), F.lit(s)).otherwise(new)
        upto += room
    return ranked.withColumn("shard", F.when(F.col("rank") <= over, new).otherwise(to).cast("int")).drop("bucket", "one", "rank")


def shard(
    docs: DataFrame, n_shards: int = 8, rounds: int = 5, seed: str = "shard", link: Column | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked for every row.

    ``docs`` needs doc_id and text; other columns are ignored, but for those
    named in ``carry``, which come back with their row. Law ``rows``: shard
    counts differ by one at most. Null texts have size 1 and are linked with
    nothing, unless ``link`` gives another key; repeated rows are rows of their
    own; an empty table gives an empty result. Rows without doc_id are told
    apart by their place in the input, so their shards may differ between reruns.
    """
    ws = Workspace(docs.sparkSession, "shard")
    by = F.col("text") if link is None else link
    kept = [f"carry{i}" for i in range(len(carry))]
    # Without doc_id all rows would have one digest, so one bucket of every order.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string")))
    base = docs.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        *[F.col(c).alias(k) for c, k in zip(carry, kept)],
        F.md5(F.concat_ws(":", F.lit(seed), name)).alias("h"),
        F.when(by.isNotNull(), F.xxhash64(by)).alias("link1"),
        F.when(by.isNotNull(), F.xxhash64(F.lit(7919), by)).alias("link2"),
    ).withColumn("shard", spread(F.col("h"), n_shards).cast("int"))
    base = ws.put(base)
    n = base.count()
    groups = base.filter("link1 is not null").groupBy("link1", "link2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select("link1", "link2", F.lit(True).alias("linked"), (F.col("n") > -(-n // n_shards)).alias("large"), "n")
    groups = ws.put(groups)
    n_groups = groups.count()
    rows = base.join(sized_broadcast(groups.drop("n"), n_groups), ["link1", "link2"], "left")
    rows = rows.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("large", F.coalesce("large", F.lit(False)))
    rows = ws.put(rows.withColumn("capacity", F.lit(-(-n // n_shards) if n else 0)))
    large = groups.filter("large").orderBy(F.desc("n"), "link1", "link2").collect()  # fewer than n_shards rows
    if large:
        columns = rows.columns
        rows = ws.put(even_out(ws.put(deal_large(rows, large, n_shards, n)), ws, n_shards, n).select(*columns))
    # Unlinked rows need no join in the rounds.
    alone, linked = rows.filter("not linked"), rows.filter("linked")
    for i in range(rounds):
        linked = ws.put(propagate_once(linked, n_shards, f"{seed}:{i}", n_groups).select(*rows.columns))
    even = ws.put(even_out(alone.unionByName(linked), ws, n_shards, n))
    ws.keep(even)
    buckets = rows_per_bucket(n)
    slots = running_total(
        even.withColumn("bucket", spread(F.col("h"), buckets)).withColumn("one", F.lit(1)),
        ["shard"], "bucket", [F.col("h"), F.col("doc_id")], "one", "slot",
    )
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked",
        *[F.col(k).alias(c) for c, k in zip(carry, kept)],
    )

"""Mixing sources to target weights by weighted fair queueing.

Each (document, pass) joins its source's queue in a fixed random order. Its
virtual finish time is the source's cumulative words divided by the source's
weight. A global range sort by finish time, cut at the total budget, is the
mix: at any virtual time every source has received words in proportion to its
weight, and a source that has run out (after ``max_repeats`` passes) leaves its
share to the others. Everything is DataFrame code; no group, however large, is
held by one task: queues are summed by buckets of digests (``running_total``),
the global order by ranges whose bounds are sampled quantiles (``in_order``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._util import WORD, Workspace, rows_per_bucket, running_total, spread
from textloom.operators.corpus import in_order


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], budget_share: float, max_repeats: int
) -> DataFrame:
    """(source, src, weight, source_size, target) of frame (source, source_size).

    Sources in code point order, null last, take the weights in turn. The
    budget is ``budget_share`` of all sizes; targets are water-filled by weight
    under the caps ``max_repeats * source_size``. One row per source, so the
    window over all of them is small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    out = sizes.withColumn("src", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") - 1) % len(weights) + 1)
    out = out.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeats)
    everything = Window.partitionBy().orderBy("fill", "src")
    done = everything.rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("fill", F.col("cap") / F.col("weight"))
    out = out.withColumn("budget", F.sum("source_size").over(whole) * F.lit(budget_share))
    # Virtual time at which the budget is spent if all sources before this one
    # in filling order are exhausted and none from it on is.
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(done), F.lit(0))) / F.sum("weight").over(rest)
    out = out.withColumn("level", level)
    out = out.withColumn(
        "time", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "src", "level"))).over(whole)["level"]
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("time") * F.col("weight"), F.col("cap").cast("double")))
    return out.select("source", "src", "weight", "source_size", target.alias("target"), "budget")


def fair_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget_share: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
    size: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repeats for every row.

    ``docs`` needs doc_id, text and source; other columns are ignored, but for
    those named in ``carry``, which come back with their row. Null texts and
    texts without words have size 0 and are taken 0 words; a null source is a
    source of its own, ordered last; repeated rows are separate documents; an
    empty table gives an empty result. The order is a digest of doc_id (of the
    text, where doc_id is null), so reruns agree.
    """
    ws = Workspace(docs.sparkSession, "mix")
    if size is None:
        size = word_count(F.col("text"))
    kept = [f"carry{i}" for i in range(len(carry))]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    base = ws.put(
        docs.select(
            "doc_id", "source", size.cast("long").alias("size"), F.md5(F.concat(F.lit(seed + ":"), name)).alias("h"),
            F.xxhash64("text").alias("t"), *[F.col(c).alias(k) for c, k in zip(carry, kept)],
        )
    )
    n = base.count()
    buckets = rows_per_bucket(n)
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = ws.put(source_targets(totals, weights, budget_share, max_repeats))
    keyed = base.join(targets, base.source.eqNullSafe(targets.source)).select(
        "doc_id", base.source, "size", "h", "t", "src", "weight", "source_size", "target", "budget", *kept
    )
    keyed = keyed.withColumn("bucket", spread(F.col("h"), buckets))
    order = [F.col("h"), F.col("doc_id"), F.col("size"), F.col("t")]
    queued = ws.put(running_total(keyed, ["src"], "bucket", order, "size", "cum").drop("bucket", "t"))
    ws.keep(queued)
    passes = queued.filter("size > 0").select(
        "doc_id", "src", "h", "size", "cum", "budget", "weight", "source_size",
        F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn"),
    ).withColumn("finish", (F.col("cum") + F.col("turn") * F.col("source_size")) / F.col("weight"))
    order = [F.col("finish"), F.col("src"), F.col("h"), F.col("doc_id"), F.col("turn"), F.col("cum")]
    ordered = in_order(passes.select(*order, "size", "budget"), order, {"spent": F.col("size")})
    # Rows with words differ in (src, cum), so repeated rows stay apart.
    taken = ordered.filter(F.col("spent") <= F.col("budget")).groupBy("src", "cum").agg(F.count(F.lit(1)).alias("turns"))
    out = queued.join(taken, ["src", "cum"], "left")
    repeats = F.when(F.col("size") > 0, F.coalesce("turns", F.lit(0))).otherwise(F.lit(0))
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * repeats).cast("long").alias("taken"), repeats.cast("int").alias("repeats"),
        *[F.col(k).alias(c) for c, k in zip(carry, kept)],
    )

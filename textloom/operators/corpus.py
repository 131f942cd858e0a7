"""Corpus operators: annotation, merging, ranking, coverage, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.shared import written


def annotate(docs: DataFrame, tiers: DataFrame, paragraph: Column, line: Column, default: int = 6) -> DataFrame:
    """Join tiers by source; add verified (tier 5 or better) and a citation by paragraph, else by line."""
    tier = F.coalesce("tier", F.lit(default))
    cite = F.when(paragraph.isNotNull(), F.concat("source", F.lit(":p"), paragraph)).otherwise(F.concat("source", F.lit(":L"), line))
    joined = docs.join(tiers, "source", "left")
    return joined.withColumns({"tier": tier, "verified": tier <= 5, "citation": cite})


def category(tier: Column) -> Column:
    return F.when(tier.isin(1, 2, 3), "authoritative").when(tier == 5, "literature").otherwise("general")


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rk", rank).filter("_rk = 1").drop("_rk")


def merge(parts: Sequence[DataFrame], text: str, order: Sequence[str], keep: Column) -> DataFrame:
    """Union of phases, first copy of each text wins, then the quality rule.

    The copy is chosen before the rule is applied: a poor first copy hides
    later good ones.
    """
    out = None
    for phase, df in enumerate(parts):
        df = df.withColumn("phase", F.lit(phase))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    # The digest stands for the text, so texts are moved only if the result has them.
    return first_of(out.withColumn("_key", F.md5(text)), ["_key"], ["phase", *order]).drop("_key").filter(keep)


def merge_with_precedence(a: DataFrame, b: DataFrame, key: str, name_a: str, name_b: str) -> DataFrame:
    """Full outer merge that tells where each key comes from."""
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    source = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), name_a).otherwise(name_b)
    return a.join(b, key, "full_outer").withColumn("source", source).drop("_a", "_b")


def in_order(rows: DataFrame, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Adds the running sum of each value in global order, without a single-partition sort.

    Rows are range-partitioned; the sums of the partitions (one row each) give
    every partition its start. The ranged rows are written first: their bounds
    come from a sample, and rows and sums must agree on them.
    """
    ranged = rows.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]).repartitionByRange(*order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "order")
    sums = ranged.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(starts, "_part").withColumns({n: F.sum(f"_v_{n}").over(inside) + F.col(f"_s_{n}") for n in values})
    return out.drop("_part", *[f"_{k}_{n}" for n in values for k in "vs"])


def with_rank(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Global rank from 1."""
    return in_order(rows, order, {out: F.lit(1)})


def coverage(words: DataFrame, word: str, top: int | None, digits: int | None = 9) -> DataFrame:
    """word, n, rk, share, coverage of the ``top`` most frequent words (all if None).

    Counting comes first, so only distinct words are put in order.
    """
    counts = words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    if top is not None:
        order = Window.orderBy(F.desc("n"), word)  # over ``top`` rows
        ranked = counts.orderBy(F.desc("n"), word).limit(top)
        ranked = ranked.withColumns({"rk": F.row_number().over(order).cast("long"), "cum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    else:
        ranked = in_order(counts, [F.desc("n"), F.col(word)], {"rk": F.lit(1), "cum": F.col("n")})
    ranked = ranked.join(F.broadcast(total), F.lit(True))  # one row
    return ranked.select(word, "n", "rk", r(F.col("n") / F.col("total")).alias("share"), r(F.col("cum") / F.col("total")).alias("coverage"))


def noun_dictionary(nouns: DataFrame, least: int, contexts: int) -> DataFrame:
    """base, n, first_docs, category of bases seen ``least`` times.

    Only the first contexts of a base are gathered, however frequent it is.
    """
    counts = nouns.groupBy("base").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("base").orderBy("doc_id", "pos"))
    first = nouns.withColumn("rk", rank).filter(F.col("rk") <= contexts).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("rk", "doc_id"))).alias("c"))
    kind = F.when(F.endswith("base", F.lit("land")), "place").when(F.endswith("base", F.lit("er")), "person").otherwise("other")
    return counts.join(first, "base").select("base", "n", F.transform("c", lambda x: x["doc_id"]).alias("first_docs"), kind.alias("category"))


def sample_per_group(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """At most ``size`` rows of each group, the first by digest of the key."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("rk", rank).filter(F.col("rk") <= size)


def latency(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, extremes, deviation and the 95th percentile (an element of the data).

    Elements are found by their global rank, so no task holds a key's rows.
    """
    v = F.col(value)
    ranked = written(with_rank(rows.select(*keys, v.alias("v")).filter("v is not null"), [*[F.col(k) for k in keys], F.col("v")], "_rk"), "ranked")
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("sd"), F.min("_rk").alias("_first"))
    at = {"p95": F.floor(F.col("n") * 0.95), "_low": F.floor((F.col("n") - 1) / 2), "_high": F.ceil((F.col("n") - 1) / 2)}
    places = sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("_place"), (F.col("_first") + x).alias("_rk")) for k, x in at.items()])).alias("p"))
    # Ranks are global, so places need no key; three rows for each key.
    found = places.select(*keys, "p.*").join(ranked.select("_rk", "v"), "_rk").groupBy(*keys).agg(*[F.max(F.when(F.col("_place") == k, F.col("v"))).alias(k) for k in at])
    both = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    out = sums.alias("a").join(found.alias("b"), both)
    median = F.round((F.col("_low") + F.col("_high")) / 2, 6)
    return out.select(*[f"a.{k}" for k in keys], "n", "mean", median.alias("median"), "lo", "hi", "sd", "p95")

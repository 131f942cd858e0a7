"""Incremental counterparts of the batch operators, on Structured Streaming.

Files that arrive in a folder are read exactly once; counters, seen texts and
ids live in the checkpoint. ``run_available`` processes what is there and
stops, which is how a resumable batch is written here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append what is new to a Parquet table, then stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_counts(df: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Running counts by key; each trigger replaces the table of counts."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    query = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_copies(df: DataFrame, text: str = "text") -> DataFrame:
    """The first row of each text. The state grows with the distinct texts: there is no time column to end it."""
    return df.dropDuplicates([text])


def first_copies_within(df: DataFrame, text: str, time: str, delay: str) -> DataFrame:
    """The first row of each text within a delay, with bounded state."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([text])


def unknown_roots(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Words of the stream that the lexicon lacks: count, first time seen, an example."""
    new = words.join(lexicon, word, "left_anti")
    return new.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.min("context").alias("context"))


def with_hooks(df: DataFrame, hooks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for hook in hooks:
        df = df.transform(hook)
    return df


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; later events than ``late`` are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("window.start", "event_type", "n", "value")

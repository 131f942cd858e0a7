"""Sinks: JSON lines, category folders, success and failure, counts beside the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.corpus import category


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; an existing output is an error unless another mode is asked for."""
    df.write.mode(mode).json(path)


def write_routed(df: DataFrame, path: str, tier: Column, mode: str = "errorifexists") -> None:
    """One folder for each category; the folder above them is the whole corpus."""
    df.withColumn("category", category(tier)).write.mode(mode).partitionBy("category").parquet(path)


def write_split(df: DataFrame, path: str, ok: Column, mode: str = "errorifexists") -> None:
    """Rows that are ok and rows that failed, in folders of one table."""
    df.withColumn("status", F.when(ok, "ok").otherwise("failed")).write.mode(mode).partitionBy("status").parquet(path)


def write_with_counts(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """The table, and beside it its counts by key, taken from what was written."""
    df.write.mode(mode).parquet(path)
    written = df.sparkSession.read.parquet(path)
    written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode(mode).json(f"{path}.meta")


def write_by_source(df: DataFrame, path: str, source: str = "source") -> None:
    """One folder for each source; only the sources in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def _exists(df_or_spark: DataFrame | SparkSession, path: str) -> bool:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def write_missing_sources(df: DataFrame, path: str, source: str = "source") -> None:
    """One folder for each source; sources that have one already are passed over."""
    if _exists(df, path):
        there = df.sparkSession.read.parquet(path).select(source).distinct()
        df = df.join(there, source, "left_anti")
    df.write.mode("append").partitionBy(source).parquet(path)


MEMORY_SCHEMA = "entry_id string, timestamp timestamp, text string, ast string, metadata string, memory_type string"


def create_memory(spark: SparkSession, path: str) -> None:
    """An empty memory table. Folders by type and order by time inside files stand for its two indexes."""
    spark.createDataFrame([], MEMORY_SCHEMA).write.mode("errorifexists").partitionBy("memory_type").parquet(path)


def insert_memory(rows: DataFrame, path: str) -> None:
    """Append entries; columns that ``rows`` lacks are null."""
    empty = rows.sparkSession.createDataFrame([], MEMORY_SCHEMA)
    whole = empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)
    whole.repartitionByRange("memory_type", "timestamp").sortWithinPartitions("memory_type", "timestamp").write.mode("append").partitionBy("memory_type").parquet(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMORY_SCHEMA).parquet(path)


def delete_memory(spark: SparkSession, path: str) -> None:
    """All entries go, the table stays."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    create_memory(spark, path)


def write_words(df: DataFrame, path: str, word: str, mode: str = "errorifexists") -> None:
    df.select(word).orderBy(word).write.mode(mode).text(path)


def append_with_ids(df: DataFrame, path: str, order: list[Column], prefix: str = "LTM-") -> None:
    """Append rows with ids that go on from the number of rows there."""
    from textloom.operators.corpus import with_rank

    spark = df.sparkSession
    there = _exists(spark, path)
    n = spark.read.parquet(path).count() if there else 0
    ranked = with_rank(df, order, "_n")
    ranked.withColumn("entry_id", F.concat(F.lit(prefix), F.lpad((F.col("_n") + n).cast("string"), 6, "0"))).drop("_n").write.mode("append").parquet(path)

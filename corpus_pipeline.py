"""Corpus pipeline: documents without toxic, copied and leaked ones, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import toxicity as tox
from textloom.llm._util import Workspace, with_place
from textloom.llm.decontaminate import drop_contaminated
from textloom.llm.mixing import fair_mix
from textloom.llm.near_dedup import near_duplicates
from textloom.llm.sharding import shard

#: The learned stages and the graph stages have no SQL; tests/llm compares them with plain Python.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more go.

    Every row is judged by its text alone: rows without doc_id, repeated rows
    and columns of any name pass through; a null or empty text has no evidence
    and gets the score that stands for none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return tox.drop_toxic(docs, tox.fit(docs, labels), 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the smallest doc_id (null last), then the first row of the input.

    Rows are compared by their texts, whatever their doc_ids: copies under one
    doc_id or without one are one group; different texts under one doc_id are
    not. Rows without words (null, empty or blank text) are linked with nothing
    and all stay.
    """
    rows, at = with_place(docs, Workspace(spark, "dedup"))
    given = f"{at[0]}id"
    named = rows.withColumn(given, F.col("doc_id")).withColumn("doc_id", F.xxhash64(*at))
    groups = near_duplicates(named, percent=85, carry=[given, *at])
    least = F.min(F.struct(F.col(given).isNull(), given, *at))
    kept = groups.filter("node is not null").groupBy("node").agg(least.alias("least")).select("least.*")
    kept = kept.select(*at).union(groups.filter("node is null").select(*at))
    return rows.join(kept, at, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage go.

    Every row is judged by its text alone: rows without doc_id, repeated rows
    and columns of any name pass through; null and empty texts hold nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as the mix takes it, 0 to 2 times.

    Rows are counted one by one, also without doc_id or with a repeated one;
    rows without words are taken 0 times; a null source is a source.
    """
    rows, at = with_place(docs, Workspace(spark, "mixing"))
    taken = fair_mix(rows, carry=at).filter("repeats > 0").select(*at, F.explode(F.sequence(F.lit(1), "repeats")).alias(f"{at[0]}turn"))
    return rows.join(taken, at).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of documents with size, text_crc32, shard and slot; columns of ``docs`` that have these names give way.

    Every row has a slot of its own, also without doc_id or with a repeated one; a null text has size 1.
    """
    rows, at = with_place(docs, Workspace(spark, "sharding"))
    made = ["size", "text_crc32", "shard", "slot"]
    placed = shard(rows, carry=at).select(*at, *made)
    return rows.drop(*made).join(placed, at).select(*[c for c in docs.columns if c not in made], *made)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = ws.put(stage(spark, docs, sf_dir))
    return docs

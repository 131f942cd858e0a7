"""Shared helpers of the training-data operators: shared-folder tables,
distributed prefix sums, packed hashes of text columns."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.shared import shared_root

#: Code points that separate words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


class Workspace:
    """Written intermediate tables of one operator run.

    ``put`` writes a frame as Parquet below the shared folder and returns it
    reread, so a lost executor never recomputes what came before; ``drop``
    frees a table that nothing reads any more, ``keep`` all but those named.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/textloom/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.tables: list[DataFrame] = []

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``by`` names a column of few values; readers that filter on it read only their part."""
        path = self.path()
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._textloom_path = path
        self.tables.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._textloom_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = [t for t in self.tables if t is not df]

    def keep(self, *held: DataFrame) -> None:
        for t in list(self.tables):
            if not any(t is h for h in held):
                self.drop(t)


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether the frame is a scan, filtered or projected at most, so that each row is one of a file's."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def with_place(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, list[str]]:
    """The rows with two numbers that tell each row from all others, and the names of these columns, which ``docs`` does not have.

    Rows of files are known by a hash of the file's path and their place in it;
    both stay the same however files are split and whatever executors are lost.
    Rows of other frames are written first, with a number of their own.
    """
    at = ["_file", "_place"]
    while set(at) & set(docs.columns):
        at = [f"{c}_" for c in at]
    try:
        if _rows_of_files(docs):
            return docs.withColumns({at[0]: F.xxhash64(F.col("_metadata.file_path")), at[1]: F.col("_metadata.row_index")}), at
    except AnalysisException:  # a source that does not tell
        pass
    return ws.put(docs.withColumns({at[0]: F.lit(0).cast("long"), at[1]: F.monotonically_increasing_id()})), at


def rows_per_bucket(n_rows: int, per_bucket: int = 500, least: int = 8) -> int:
    """Number of order buckets so that each holds about ``per_bucket`` rows."""
    return max(least, -(-n_rows // per_bucket))


def running_total(
    df: DataFrame, key: list[str], bucket: str, order: list[Column], value: str, out: str, before: bool = False
) -> DataFrame:
    """Running sum of ``value`` in the order of (bucket, order) for each key.

    ``bucket`` is an integer column that rises with the order. Sums of buckets
    are taken first and their running sums joined back, so no task holds more
    than one bucket of one key, however large the key is; the running sums of
    buckets go by groups of 1,024 in the same way. The frame must be a
    written table or otherwise cheap and repeatable: it is read twice.
    ``before`` leaves the row's own value out.
    """
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*key, bucket).agg(F.sum(value).alias("_sum")).withColumn("_group", F.shiftright(F.col(bucket).cast("long"), 10))
    groups = sums.groupBy(*key, "_group").agg(F.sum("_sum").alias("_all"))
    groups = groups.select(*key, "_group", F.coalesce(F.sum("_all").over(earlier(key, "_group")), F.lit(0)).alias("_first"))
    inside = F.coalesce(F.sum("_sum").over(earlier([*key, "_group"], bucket)), F.lit(0))
    starts = sums.withColumn("_start", inside).join(groups, [*key, "_group"]).select(*key, bucket, (F.col("_start") + F.col("_first")).alias("_start"))
    inner = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(value).over(inner) + F.col("_start")
    if before:
        total = total - F.col(value)
    return df.join(starts, [*key, bucket]).withColumn(out, total).drop("_start")


def spread(col: Column, buckets: int) -> Column:
    """Bucket 0 .. buckets-1 of a hexadecimal digest, rising with the digest."""
    return F.floor(F.conv(F.substring(col, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def key128(col: Column, name: str) -> list[Column]:
    """Two independent 64-bit hashes: a 128-bit identity that joins natively."""
    return [F.xxhash64(col).alias(f"{name}1"), F.xxhash64(F.lit(7919), col).alias(f"{name}2")]

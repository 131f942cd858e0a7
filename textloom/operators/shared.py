"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session whose executors are the driver itself may go without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is not None:
        return root
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="textloom-")
    return _own[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and reread, for what is used several times."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/textloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

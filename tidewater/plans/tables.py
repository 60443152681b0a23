"""The folder that driver and executors share, and cutting lineage between steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a temporary folder, which only a session on one machine may use."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='tidewater-')}")
    return (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

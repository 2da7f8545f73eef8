"""Tables in the folder that driver and executors share, for work that takes rounds."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Unset, a local session uses /tmp; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return f"{folder}/{name}-{uuid4().hex}"


def written(frame: DataFrame, name: str) -> str:
    """The frame written as Parquet: its path."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet and read back: computed once, and whole after the loss of an executor."""
    path = written(frame, name)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)

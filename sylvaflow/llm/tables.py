"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the narrow side of a join is broadcast.
FEW = 100_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset a local session may do with /tmp;
    on a cluster, whose machines don't share it, it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not chosen.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = chosen.get() if chosen.isDefined() else "/tmp/checkpoints"
    return f"{folder}/{name}-{uuid4().hex}"


def stored(frame: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The frame written as Parquet and read back: computed once, and whole after the loss of an executor."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, most: int = FEW) -> DataFrame:
    """A frame of narrow rows, marked for broadcast if it has `most` of them or fewer; counting stops there."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame

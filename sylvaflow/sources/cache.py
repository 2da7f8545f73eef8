"""A table of computed rows by key that only ever computes what it doesn't have.

The rows lie in folders of Parquet files; the newest version lists those that count. A run asks for keys, computes
the missing ones into a new folder and publishes it in the next version, so readers see all of it or nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow.sources.stores import opened, write_bytes


def _versions(path: str) -> list[int]:
    store, name = opened(path)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return []
    found = [i.base_name for i in store.get_file_info(fs.FileSelector(name))]
    return sorted(int(n[8:-5]) for n in found if n.startswith("version-") and n.endswith(".json"))


def _parts(path: str, version: int) -> list[str]:
    store, name = opened(path)
    with store.open_input_file(f"{name.rstrip('/')}/version-{version:09d}.json") as f:
        return json.loads(f.read())["parts"]


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the newest version, None before the first."""
    versions = _versions(path)
    parts = _parts(path, versions[-1]) if versions else []
    return spark.read.parquet(*(f"{path.rstrip('/')}/{p}" for p in parts)) if parts else None


def ensured(asked: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Makes the cache hold every asked key; returns the number of keys that were computed.

    `compute` gets the missing keys, one row each, and returns rows with the key; a key for which it returns none
    is stored with nulls, so it isn't asked for again. Null keys are left out. Versions are taken up again before the
    new one is written: keys that another run has computed meanwhile are there twice, and `cached` takes one. Of two
    runs that publish in the same moment one may be left out; its keys are then computed again when asked for.
    """
    spark = asked.sparkSession
    have = stored_rows(spark, path)
    missing = asked.select(key).filter(F.col(key).isNotNull()).distinct()
    if have is not None:
        missing = missing.join(have.select(key), key, "left_anti")
    if missing.isEmpty():
        return 0
    part = f"part-{uuid4().hex}"
    computed = missing.join(compute(missing), key, "left")
    computed.write.parquet(f"{path.rstrip('/')}/{part}")
    count = spark.read.parquet(f"{path.rstrip('/')}/{part}").select(key).distinct().count()
    versions = _versions(path)
    parts = (_parts(path, versions[-1]) if versions else []) + [part]
    write_bytes(f"{path.rstrip('/')}/version-{(versions[-1] if versions else 0) + 1:09d}.json", json.dumps({"parts": parts, "key": key}).encode())
    return count


def cached(asked: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], fallback: Callable | None = None) -> DataFrame:
    """asked(key, ...) with the columns of the cache. With `fallback`, a key that the cache lacks under its full name
    is first looked up under `fallback(key column)`, such as a field of it, and computed under that name."""
    spark = asked.sparkSession
    if fallback is None:
        named = asked.withColumn("_k", F.col(key))
    else:
        have = stored_rows(spark, path)
        short = F.coalesce(fallback(F.col(key)), F.col(key))
        named = asked.withColumn("_k", short)
        if have is not None:
            full = have.select(F.col(key).alias("_full")).distinct()
            named = asked.join(full, F.col(key) == F.col("_full"), "left").withColumn("_k", F.coalesce("_full", short)).drop("_full")
    ensured(named.select(F.col("_k").alias(key)), path, key, compute)
    rows = stored_rows(spark, path)
    if rows is None:
        return named.drop("_k")
    rest = [c for c in rows.columns if c != key]
    once = rows.dropDuplicates([key]).select(F.col(key).alias("_k"), *rest)
    return named.join(once, "_k", "left").select(*asked.columns, *(c for c in rest if c not in asked.columns))

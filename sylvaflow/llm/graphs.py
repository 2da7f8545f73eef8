"""Connected components by alternating large and small stars, in joins and partial minima."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.tables import FEW, stored


def _to_minimum(edges: DataFrame) -> DataFrame:
    """edges(u, v) with the least of u and its v as m. Minima are combined before the shuffle; a hub's
    edges meet its minimum in a join, which can be split, not in one group."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around the least node that they reach among themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(u, v), root being the least node reachable.

    Loops and repeated edges do no harm; without edges the result is empty. Chains are first shortened
    within each partition, so few rounds remain; none if FEW edges are left at most, which one task contracts.
    """
    now = stored(edges.filter("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long").distinct(), "stars")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if now.limit(FEW + 1).count() <= FEW:
        now = stored(now.coalesce(1).mapInArrow(_contract, "u long, v long"), "stars")
        return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = _to_minimum(large)
        small = met.select("u", F.col("m").alias("v")).union(met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "stars")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state

"""Connected components in rounds that contract the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.operators.stages import stored


def jumped(pointers: DataFrame) -> DataFrame:
    """pointers(a, up, ...) with `up` at the end of each chain: a chain's length halves in each round."""
    rest = [c for c in pointers.columns if c not in ("a", "up")]
    while True:
        ahead = pointers.select(F.col("a").alias("up"), F.col("up").alias("over"))
        there = F.coalesce("over", "up")
        moved = stored(pointers.join(ahead, "up", "left").select("a", there.alias("new"), (there != F.col("up")).alias("moved"), *rest), "pointers")
        pointers = moved.select("a", F.col("new").alias("up"), *rest)
        if moved.filter("moved").isEmpty():
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b), root being the least node reachable.

    Each round hooks a node to its least neighbour if that is less, and joins what is hooked together; a node
    with many edges is reduced by partial minima, never gathered. Loops and repeated edges do no harm.
    """
    kind = edges.schema["a"].dataType
    edges = stored(edges.select("a", "b"), "edges")
    both = lambda e: e.union(e.select("b", "a"))
    nodes = stored(both(edges).select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root")), "nodes")
    edges = edges.filter("a <> b")
    while not edges.isEmpty():
        hooked = both(edges).groupBy("a").agg(F.min("b").alias("up")).select("a", F.least("a", "up").cast(kind).alias("up"))
        top = jumped(stored(hooked, "pointers"))
        nodes = stored(nodes.join(top.select(F.col("a").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "nodes")
        end = lambda c: top.select(F.col("a").alias(c), F.col("up").alias(f"{c}2"))
        moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = stored(moved.filter("a <> b").distinct(), "edges")
    return nodes

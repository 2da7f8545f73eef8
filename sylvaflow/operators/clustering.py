"""Agglomerative clustering of class profiles by complete linkage, for the rows of a heatmap.

Up to MOST classes are merged on the driver. More are merged in rounds over tables: at a reach, all pairs of clusters
whose farthest members lie within it are known, so each cluster's nearest one is; pairs that are each other's nearest
merge at once, and the distance of a merged cluster is the greater of its parts', if both are within the reach. When no
pair is left the reach grows, and the pairs are found again from the points, by cells of the clusters' least points; it
grows as far as these points don't crowd the cells, twofold at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaflow.operators.stages import stored

#: Classes whose distances the driver holds.
MOST = 2_000
#: Clusters in the cell of a cluster, on average, up to which a reach grows; coordinates that make a cell.
CROWD, AXES = 8, 3


def merges(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) of each merge by rising height; points are 0 .. n - 1, the k-th merge is n + k. A chain
    walks to nearest neighbours until two are each other's, which complete linkage allows to be merged at once."""
    n = len(points)
    distance = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2)) if n else np.zeros((0, 0))
    np.fill_diagonal(distance, np.inf)
    alive, chain, found = np.ones(n, bool), [], []
    while len(found) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        row = np.where(alive, distance[a], np.inf)
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
            chain = chain[:-2]
            keep, gone = min(a, b), max(a, b)
            found.append((keep, gone, float(distance[a, b])))
            far = np.maximum(distance[keep], distance[gone])
            distance[keep], distance[:, keep] = far, far
            distance[keep, keep] = np.inf
            alive[gone] = False
        else:
            chain.append(b)
    name, size, out = list(range(n)), [1] * n, []
    for keep, gone, height in sorted(found, key=lambda m: m[2]):
        size[keep] += size[gone]
        out.append((name[keep], name[gone], height, size[keep]))
        name[keep] = n + len(out) - 1
    return out


def leaf_order(n: int, joined: list[tuple[int, int, float, int]]) -> list[int]:
    """The points as a dendrogram's leaves: at each merge the lower branch first, then the one of the least point."""
    if not n:
        return []
    least, height = [*range(n)], [0.0] * n
    for a, b, h, _ in joined:
        least.append(min(least[a], least[b]))
        height.append(h)
    out, todo = [], [n + len(joined) - 1 if joined else 0]
    while todo:
        k = todo.pop()
        if k < n:
            out.append(k)
        else:
            first, second = sorted(joined[k - n][:2], key=lambda c: (height[c], least[c]))
            todo += [second, first]
    return out


def _standard(z: np.ndarray) -> np.ndarray:
    """Each row less its mean over its deviation; NaN counts in neither, and what is undefined is 0."""
    if len(z):
        with np.errstate(invalid="ignore", divide="ignore"):
            z = (z - np.nanmean(z, 1, keepdims=True)) / np.nanstd(z, 1, ddof=1, keepdims=True)
    return np.where(np.isfinite(z), z, 0.0)


def farthest(x: np.ndarray, y: np.ndarray) -> float:
    """The greatest distance between a row of x and one of y. Rows that can't reach the distance of a first guess, by
    the centre and radius of the other side, are left out; the rest meet in pieces."""
    away = lambda rows, point: np.sqrt(((rows - point) ** 2).sum(1))
    a = x[away(x, y[0]).argmax()]
    b = y[away(y, a).argmax()]
    best = float(away(x, b).max())
    centres = x.mean(0), y.mean(0)
    radii = away(x, centres[0]).max(), away(y, centres[1]).max()
    slack = best * (1 - 1e-9)
    x, y = x[away(x, centres[1]) + radii[1] >= slack], y[away(y, centres[0]) + radii[0] >= slack]
    step = max(1, 1_000_000 // max(len(y), 1))
    for k in range(0, len(x), step):
        best = max(best, float(np.sqrt(((x[k : k + step, None, :] - y[None, :, :]) ** 2).sum(2)).max(initial=0.0)))
    return best


def _near(points: DataFrame, reach: float, width: int) -> DataFrame:
    """(a, b, d) of all clusters of points(k, z, w, c, h) whose farthest members are at most `reach` apart; a and b are
    structs of a cluster's id, size and height, a.id < b.id."""
    least, most = (F.array(*(f(F.col("z")[i]) for i in range(width))) for f in (F.min, F.max))
    own = F.struct(F.col("c").alias("id"), F.sum("w").alias("n"), F.max("h").alias("h"))
    clusters = points.groupBy("c").agg(own.alias("a"), F.count("*").alias("m"), least.alias("low"), most.alias("high"), F.max(F.when(F.col("k") == F.col("c"), F.col("z"))).alias("z")).drop("c")
    axes = range(min(width, AXES))
    place = [F.floor(F.col("z")[i] / reach).cast("long") for i in axes]
    here = clusters.withColumn("cell", F.array(*place))
    around = F.array(*(F.array(*(place[i] + s for i, s in zip(axes, shift))) for shift in product((-1, 0, 1), repeat=len(axes))))
    there = clusters.select(*(F.col(c).alias({"a": "b"}.get(c, f"{c}_b")) for c in clusters.columns), F.explode(around).alias("cell"))
    limit = reach * (1 + 1e-9)  # bounds round otherwise than distances; these decide
    apart = F.expr("sqrt(aggregate(zip_with(z, z_b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))")
    span = F.expr("greatest(array_max(zip_with(high, low_b, (x, y) -> x - y)), array_max(zip_with(high_b, low, (x, y) -> x - y)))")
    met = here.join(there, "cell").filter("a.id < b.id").filter((span <= limit) & (apart <= limit)).select("a", "b", "m", "m_b", apart.alias("d"))
    met = stored(met, "met")
    rows = points.groupBy("c").agg(F.flatten(F.collect_list("z")).alias("x"))
    large = met.filter("m > 1 or m_b > 1").select("a", "b", F.col("a.id").alias("ka"), F.col("b.id").alias("kb"))
    large = large.join(rows.withColumnRenamed("c", "ka"), "ka").join(rows.select(F.col("c").alias("kb"), F.col("x").alias("y")), "kb").select("a", "b", "x", "y")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("x", "y"))
            side = lambda v, k: v[k].values.to_numpy().reshape(-1, width)
            d = [farthest(side(x, k), side(y, k)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d, pa.float64())], ["a", "b", "d"])

    kind = met.select("a", "b", "d").schema
    return met.filter("m = 1 and m_b = 1").select("a", "b", "d").unionByName(large.mapInArrow(distances, kind)).filter(F.col("d") <= reach)


def _moved(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """pairs after merged(a, b, d): a pair stays if all pairs of its parts were known, with the greatest distance."""
    to = F.struct(F.col("a.id").alias("id"), (F.col("a.n") + F.col("b.n")).alias("n"), F.col("d").alias("h"))
    new = merged.select(F.explode(F.array("a.id", "b.id")).alias("k"), to.alias("to"))
    out = pairs.withColumns({"ka": F.col("a.id"), "kb": F.col("b.id")})
    for side in ("a", "b"):
        out = out.join(new.select(F.col("k").alias(f"k{side}"), F.col("to").alias(f"to_{side}")), f"k{side}", "left")
    x, y = F.coalesce("to_a", "a"), F.coalesce("to_b", "b")
    parts = (1 + F.col("to_a").isNotNull().cast("int")) * (1 + F.col("to_b").isNotNull().cast("int"))
    out = out.filter(x["id"] != y["id"]).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "d", parts.alias("parts"))
    return out.groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("parts").alias("parts")).filter("n = parts").select("a", "b", "d")


def _reach(least: DataFrame, left: int, low: float, top: float, width: int) -> float:
    """The greatest of low, 2 low, 4 low .. top at which the cells don't crowd, or low."""
    sizes = [low * 2.0**k for k in range(60) if low * 2.0**k <= top] or [low]
    cells = least.select(F.explode(F.array(*map(F.lit, sizes))).alias("r"), "z").groupBy("r", *(F.floor(F.col("z")[i] / F.col("r")).alias(f"c{i}") for i in range(min(width, AXES)))).count()
    crowd = cells.groupBy("r").agg(F.sum(F.col("count") * F.col("count")).alias("n")).collect()  # a row a size
    return max([r.r for r in crowd if r.n <= CROWD * left], default=low)


def linked(points: DataFrame, width: int) -> DataFrame:
    """merged(step, a, b, d) of points(k, z, w), no two alike; k is the id, w the rows that a point stands for."""
    left, top = points.count(), 4 * sqrt(width)
    reach = top / 2.0**54
    points = stored(points.select("k", "z", "w", F.col("k").alias("c"), F.lit(0.0).alias("h")), "points")
    found, step = [], 0
    while left > 1:
        reach = _reach(points.filter("k = c"), left, 2 * reach, top, width)
        pairs = stored(_near(points, reach, width), "pairs")
        now = points
        while True:
            ends = pairs.select(F.explode(F.array("a.id", "b.id")).alias("c"), F.struct("d", F.xxhash64("a.id", "b.id").alias("any"), "a", "b").alias("s"))
            nearest = ends.groupBy("c").agg(F.min("s").alias("s")).groupBy("s").count().filter("count = 2")
            merged = stored(nearest.select(F.lit(step).alias("step"), "s.a", "s.b", "s.d"), "merged")
            number = merged.count()
            if not number:
                break
            found.append(merged)
            left, step = left - number, step + 1
            new = merged.select(F.explode(F.array("a.id", "b.id")).alias("c"), F.col("a.id").alias("to"), F.col("d").alias("top"))
            now = now.join(new, "c", "left").select("k", "z", "w", F.coalesce("to", "c").alias("c"), F.coalesce("top", "h").alias("h"))
            pairs = stored(_moved(pairs, merged), "pairs")
        points = stored(now, "points")
    return stored(reduce(DataFrame.unionByName, found), "merged")


def _places(merged: DataFrame) -> DataFrame:
    """(k, leaf, height) of each point: on the way to the root it stands behind the branches that come first."""
    keep = F.expr("struct(a.h, a.id) < struct(b.h, b.id)")
    rows = merged.select("step", "d", F.col("a.id").alias("up"), F.col("b.id").alias("k"), F.when(keep, 0).otherwise(F.col("b.n")).alias("kept"), F.when(keep, F.col("a.n")).otherwise(0).alias("gone"))
    later = Window.partitionBy("up").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    way = stored(rows.select("k", "up", (F.col("gone") + F.coalesce(F.sum("kept").over(later), F.lit(0))).alias("s")), "way")
    root = rows.agg(F.min("up")).first()[0]
    while not way.filter(F.col("up") != root).isEmpty():  # as many rounds as the logarithm of the depth
        above = way.select(F.col("k").alias("up"), F.col("up").alias("top"), F.col("s").alias("more"))
        way = stored(way.join(above, "up", "left").select("k", F.coalesce("top", "up").alias("up"), (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")), "way")
    ends = rows.select(F.col("up").alias("k"), "kept", "d").unionByName(rows.select("k", F.lit(0).alias("kept"), "d"))
    own = ends.groupBy("k").agg(F.sum("kept").alias("kept"), F.min("d").alias("height"))
    return own.join(way, "k", "left").select("k", (F.col("kept") + F.coalesce("s", F.lit(0))).alias("leaf"), "height")


def _wide_profiles(means: DataFrame, label: str, values: list[str]) -> DataFrame:
    """clustered_profiles of any number of classes, from their means, by tables alone."""
    width, names = len(values), [f"v{i}" for i in range(len(values))]

    def standard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("name"), pa.array(list(_standard(raw) + 0.0), pa.list_(pa.float64()))], ["k", "name", "z"])

    order = means.repartitionByRange(F.col(label).asc_nulls_first()).sortWithinPartitions(F.col(label).asc_nulls_first())
    order = order.select(F.monotonically_increasing_id().alias("k"), F.col(label).alias("name"), *(F.col(c).alias(n) for c, n in zip(values, names)))
    rows = stored(order.mapInArrow(standard, f"k long, name {dict(means.dtypes)[label]}, z array<double>"), "profiles")
    points = stored(rows.groupBy("z").agg(F.min("k").alias("k"), F.count("*").alias("w")), "points")
    if points.count() == 1:
        placed = points.select("k", F.lit(0).alias("leaf"), F.lit(None).cast("double").alias("height"))
    else:
        placed = _places(linked(points.select("k", "z", "w"), width))
    known = points.join(placed, "k").select("z", "w", "leaf", "height")
    rank = F.row_number().over(Window.partitionBy("z").orderBy("k")) - 1  # equal profiles meet at 0 and stand by label
    out = rows.withColumn("rank", rank).join(known, "z")
    leaf, height = (F.col("leaf") + F.col("rank")).cast("int"), F.when(F.col("w") > 1, 0.0).otherwise(F.col("height"))
    return out.select(F.col("name").alias(label), *(F.col("z")[i].alias(c) for i, c in enumerate(values)), leaf.alias("leaf"), height.alias("height"))


def clustered_profiles(frame: DataFrame, label: str, values: list[str]) -> DataFrame:
    """(label, values, leaf, height): each class's mean values less their row's mean over its deviation, its place
    from 0 in the order of the clustering, and the height at which it first meets another class.

    Means are taken over all rows; a null counts in no mean, and a class without one for a column has 0 there, as
    has a class whose means are all equal. A null label is a class. No rows give none; over MOST classes meet in tables.
    """
    kind = f"`{label}` {dict(frame.dtypes)[label]}, " + ", ".join(f"`{c}` double" for c in values) + ", leaf int, height double"
    means = stored(frame.groupBy(label).agg(*(F.avg(c).alias(c) for c in values)), "means")
    if means.count() > MOST:
        return _wide_profiles(means, label, values)
    rows = sorted(means.collect(), key=lambda r: (r[label] is not None, r[label] if r[label] is not None else 0))
    z = np.array([[np.nan if r[c] is None else r[c] for c in values] for r in rows], float).reshape(len(rows), len(values))
    z = _standard(z)
    joined = merges(z)
    place = {k: p for p, k in enumerate(leaf_order(len(rows), joined))}
    meets = {k: h for a, b, h, _ in reversed(joined) for k in (a, b)}
    return frame.sparkSession.createDataFrame([(r[label], *map(float, z[k]), place[k], meets.get(k)) for k, r in enumerate(rows)], kind)

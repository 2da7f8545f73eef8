"""Grids on other grids: resampling by tiles, values at points, mosaics, crops and extensions.

A grid's cell (row, col) has its centre at (x_min + (col + 0.5) * resolution, y_max - (row + 0.5) * resolution).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow.operators.tiling import tile_array, to_tiles


@dataclass(frozen=True)
class Frame:
    """Place and size of a grid."""

    x_min: float
    y_max: float
    resolution: float
    rows: int
    cols: int


def _weighted(z: np.ndarray, r: np.ndarray, c: np.ndarray, wr: np.ndarray, wc: np.ndarray) -> np.ndarray:
    """Values between four cells each, by the shares of those that are there; NaN where none has weight."""
    total, weight = np.zeros(len(r)), np.zeros(len(r))
    for dr, a in ((0, 1 - wr), (1, wr)):
        for dc, b in ((0, 1 - wc), (1, wc)):
            v = z[r + dr, c + dc]
            w = np.where(np.isnan(v), 0.0, a * b)
            total += w * np.nan_to_num(v)
            weight += w
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 0, total / weight, np.nan)


def resample(grid: DataFrame, value: str, at: Frame, to: Frame, method: str = "bilinear", size: int = 512) -> DataFrame:
    """(row, col, value) of the grid `to` from grid(row, col, value), which lies at `at`.

    Bilinear values weigh the four cells around a centre, those present by their shares alone; "near" takes the
    cell under it. Cells of `to` without any such cell aren't returned; `extended` adds them. The source is
    shuffled once, by tiles with a margin of one cell; each tile makes the cells whose centres lie in it. A null
    is an absent cell, and of repeated cells one counts.
    """
    if method not in ("bilinear", "near"):
        raise ValueError(method)
    shift = 0.5 if method == "bilinear" else 0.0

    def place(index: np.ndarray | int, rows: bool):
        """Of a target row or column its place among the source's, in cells."""
        if rows:
            return (at.y_max - (to.y_max - (index + 0.5) * to.resolution)) / at.resolution - shift
        return (to.x_min + (index + 0.5) * to.resolution - at.x_min) / at.resolution - shift

    def inside(tile: int, rows: bool) -> np.ndarray:
        """The target's rows or columns whose place is in a tile."""
        step, begin = to.resolution / at.resolution, place(0, rows)
        low, high = int(np.floor((tile * size - begin) / step)) - 1, int(np.ceil(((tile + 1) * size - begin) / step)) + 1
        index = np.arange(max(0, low), min(to.rows if rows else to.cols, high + 1))
        return index[np.floor(place(index, rows)) // size == tile]

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        rows, cols = inside(tr, True), inside(tc, False)
        r, c = (v.ravel() for v in np.meshgrid(rows, cols, indexing="ij"))
        y, x = place(r, True), place(c, False)
        z = tile_array(group, "_v", size, 1)
        r0, c0 = np.floor(y).astype(int), np.floor(x).astype(int)
        zero = np.zeros(len(r))
        found = _weighted(z, r0 - tr * size + 1, c0 - tc * size + 1, y - r0 if shift else zero, x - c0 if shift else zero) if len(r) else zero
        keep = ~np.isnan(found)
        return pd.DataFrame({"row": r[keep], "col": c[keep], value: found[keep]})

    tiled = to_tiles(grid.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")), size, 1, "_v")
    return tiled.groupBy("tr", "tc").applyInPandas(tile, f"row long, col long, `{value}` double")


def bilinear_at(points: DataFrame, grid: DataFrame, at: Frame, value: str = "value") -> DataFrame:
    """points(x, y, ...) with the bilinear value of the grid at each, null where none of the four cells is: for
    places of any kind, such as the cells of a map in another projection. Points of one place share the look-up."""
    fx, fy = (F.col("x") - at.x_min) / at.resolution - 0.5, (F.lit(at.y_max) - F.col("y")) / at.resolution - 0.5
    near = []
    for dr in (0, 1):
        for dc in (0, 1):
            share = lambda f, d: f - F.floor(f) if d else 1 - (f - F.floor(f))
            near.append(F.struct((F.floor(fy) + dr).alias("row"), (F.floor(fx) + dc).alias("col"), (share(fy, dr) * share(fx, dc)).alias("w")))
    places = points.select("x", "y").distinct()
    spread = places.select("x", "y", F.explode(F.array(*near)).alias("n")).select("x", "y", "n.*").filter("w > 0")
    met = spread.join(grid.filter(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("_v")), ["row", "col"])
    found = met.groupBy("x", "y").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value))
    return points.join(found, ["x", "y"], "left").select(*points.columns, value)


def cropped(grid: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells within rows and columns, both ends included; ranges that a raster scan prunes by."""
    return grid.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def extended(grid: DataFrame, frame: Frame, fill: Column | None = None) -> DataFrame:
    """The grid with a row for every cell of the frame; absent cells are null, or `fill`."""
    lines = grid.sparkSession.range(frame.rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frame.cols - 1).cast("long"))).alias("col"))
    rest = [c for c in grid.columns if c not in ("row", "col")]
    out = lines.join(grid.withColumn("_here", F.lit(True)), ["row", "col"], "left")
    return out.select("row", "col", *(F.col(c) if fill is None else F.when(F.col("_here"), F.col(c)).otherwise(fill).alias(c) for c in rest))


def mosaic(grids: list[DataFrame], value: str, how: str = "first") -> DataFrame:
    """One grid of several over the same frame: where they overlap the first that has a value, or the mean, min or
    max. A null is no value."""
    both = None
    for order, g in enumerate(grids):
        part = g.filter(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("_v"), F.lit(order).alias("_o"))
        both = part if both is None else both.unionByName(part)
    rule = {"first": F.min_by("_v", "_o"), "mean": F.avg("_v"), "min": F.min("_v"), "max": F.max("_v")}[how]
    return both.groupBy("row", "col").agg(rule.alias(value))

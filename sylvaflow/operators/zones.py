"""Tables of polygons over a grid: covers, rasters, masks and zonal statistics.

A polygon is a row with `rings`, an array of rings, each an array of (x, y) without the first one repeated; holes
and parts are further rings, told apart by parity. Its cover is found line by line: each side gives its crossing
with every grid line between its ends, and a line's sorted crossings pair into runs of cells. So a polygon of any
size is spread over tasks by line, and the cells that it covers meet its runs in an equi join by line and block of
columns; no cell is ever held against a polygon that isn't near.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of one block of a line.
BLOCK = 64
RINGS = "array<array<struct<x: double, y: double>>>"


def buffers(points: DataFrame, radius: float, per_quadrant: int = 30) -> DataFrame:
    """points(x, y, ...) with the polygon around each, its corners on the circle."""
    corner = lambda i: F.struct((F.col("x") + radius * F.cos(i * (math.pi / 2 / per_quadrant))).alias("x"), (F.col("y") + radius * F.sin(i * (math.pi / 2 / per_quadrant))).alias("y"))
    return points.withColumn("rings", F.array(F.transform(F.sequence(F.lit(0), F.lit(4 * per_quadrant - 1)), corner)))


def _read(raw: bytes, at: int = 0) -> tuple[list[list[tuple[float, float]]], int]:
    """The rings of a polygon or multipolygon in well-known binary of either byte order, in two dimensions."""
    order = "<" if raw[at] else ">"
    kind, n = struct.unpack_from(f"{order}II", raw, at + 1)
    at += 9
    rings: list[list[tuple[float, float]]] = []
    if kind == 6:
        for _ in range(n):
            part, at = _read(raw, at)
            rings += part
        return rings, at
    if kind != 3:
        raise ValueError(f"a polygon or multipolygon is wanted, not geometry {kind}")
    for _ in range(n):
        (m,) = struct.unpack_from(f"{order}I", raw, at)
        points = np.frombuffer(raw, f"{order}f8", 2 * m, at + 4).reshape(-1, 2)
        rings.append([tuple(p) for p in (points[:-1] if m > 1 and (points[0] == points[-1]).all() else points).tolist()])
        at += 4 + 16 * m
    return rings, at


def from_wkb(frame: DataFrame, column: str = "wkb") -> DataFrame:
    """The frame with `rings` of a well-known binary column; null of a null."""
    names = [c for c in frame.columns if c != column]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            found = [None if raw is None else [[{"x": x, "y": y} for x, y in ring] for ring in _read(raw)[0]] for raw in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, kind)], [*names, "rings"])

    fields = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes if n != column)
    return frame.mapInArrow(read, f"{fields}, rings {RINGS}")


def cover(polygons: DataFrame, key: str, x_min: float, y_max: float, resolution: float) -> DataFrame:
    """(key, row, col_from, col_to): the runs of cells whose centres lie inside, by parity of all rings.

    Line 0 is the uppermost, below y_max; column 0 begins at x_min. A centre on a side belongs to the polygon to
    its right or below. Polygons without rings or with rings of fewer than three corners cover nothing of these;
    rows of equal keys are one polygon.
    """
    side = F.expr("transform(sequence(1, size(ring)), i -> struct(ring[i - 1] AS a, ring[i % size(ring)] AS b))")
    sides = polygons.select(key, F.explode("rings").alias("ring")).filter(F.size("ring") > 2).select(key, F.explode(side).alias("s")).select(key, *(F.col(f"s.{e}.{c}").alias(f"{c}{e}") for e in "ab" for c in "xy"))
    line = lambda y: F.ceil((F.lit(y_max) - y) / resolution - 0.5)  # the first line whose centre is at or below y
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    over = sides.withColumns({"_from": line(high), "_to": line(low) - 1}).filter(F.col("_from") <= F.col("_to"))
    at = over.withColumn("row", F.explode(F.sequence("_from", "_to")))
    y = F.lit(y_max) - (F.col("row") + 0.5) * resolution
    x = F.col("xa") + (y - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    crossed = at.select(key, "row", x.alias("x")).groupBy(key, "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    column = lambda v: F.ceil((v - F.lit(x_min)) / resolution - 0.5)
    pair = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(column(F.col("xs")[i]).alias("col_from"), (column(F.col("xs")[i + 1]) - 1).alias("col_to")))
    return crossed.filter(F.size("xs") > 1).select(key, "row", F.explode(pair).alias("run")).select(key, "row", "run.*").filter("col_from <= col_to")


def _met(cells: DataFrame, runs: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Cells with the keys of the runs that hold them: an equi join by line and block."""
    blocks = F.explode(F.sequence(F.floor(F.col("col_from") / BLOCK), F.floor(F.col("col_to") / BLOCK)))
    cut = runs.select(F.col(key), F.col("row").alias("_row"), "col_from", "col_to", blocks.alias("_block"))
    inside = (F.col("row") == F.col("_row")) & (F.floor(F.col("col") / BLOCK) == F.col("_block")) & F.col("col").between(F.col("col_from"), F.col("col_to"))
    met = cells.join(cut, inside, how)
    return met if how == "leftsemi" else met.drop("_row", "_block", "col_from", "col_to")


def inside_polygons(cells: DataFrame, polygons: DataFrame, key: str, x_min: float, y_max: float, resolution: float) -> DataFrame:
    """Cells (row, col, ...) once for each polygon that holds their centre, with its key."""
    return _met(cells, cover(polygons, key, x_min, y_max, resolution), key)


def zonal_statistics(cells: DataFrame, polygons: DataFrame, key: str, value: str, x_min: float, y_max: float, resolution: float) -> DataFrame:
    """(key, mean, n_cells) of the cells within each polygon; a null value counts as no cell. Polygons that hold
    no cell have a null mean."""
    found = inside_polygons(cells.filter(F.col(value).isNotNull()).select("row", "col", value), polygons, key, x_min, y_max, resolution)
    means = found.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n_cells"))
    return polygons.select(key).distinct().join(means, key, "left").select(key, "mean", F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells"))


def rasterise(template: DataFrame, polygons: DataFrame, key: str, x_min: float, y_max: float, resolution: float) -> DataFrame:
    """template(row, col, ...) with `mask`, 1 in any polygon and 0 elsewhere. Runs that overlap give one row."""
    held = _met(template, cover(polygons, key, x_min, y_max, resolution), key, "leftsemi").select("row", "col").distinct()
    return template.join(held.withColumn("mask", F.lit(1)), ["row", "col"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def mask_outside(cells: DataFrame, polygons: DataFrame, key: str, x_min: float, y_max: float, resolution: float) -> DataFrame:
    """Cells whose centre some polygon holds."""
    return _met(cells, cover(polygons, key, x_min, y_max, resolution), key, "leftsemi")


def clipped(runs: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """Runs (key, row, col_from, col_to) as far as they lie within runs of `by`, whichever of them: what a polygon
    table covers of an area, without a cell being written out."""
    blocks = lambda f: f.withColumn("_block", F.explode(F.sequence(F.floor(F.col("col_from") / BLOCK), F.floor(F.col("col_to") / BLOCK))))
    cut = lambda f: blocks(f).withColumns({"col_from": F.greatest("col_from", F.col("_block") * BLOCK), "col_to": F.least("col_to", F.col("_block") * BLOCK + BLOCK - 1)})
    area = cut(by).select("row", "_block", F.col("col_from").alias("_a"), F.col("col_to").alias("_b"))
    cells = F.sequence(F.greatest("col_from", "_a"), F.least("col_to", "_b"))
    met = cut(runs).join(area, ["row", "_block"]).filter((F.col("_a") <= F.col("col_to")) & (F.col("_b") >= F.col("col_from")))
    # a block's cells as one set, so that overlapping areas give each cell once
    sets = met.groupBy(key, "row", "_block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(cells)))).alias("c"))
    first = F.filter("c", lambda v: ~F.array_contains("c", v - 1))
    last = F.filter("c", lambda v: ~F.array_contains("c", v + 1))
    run = F.arrays_zip(first.alias("col_from"), last.alias("col_to"))
    return sets.select(key, "row", F.explode(run).alias("r")).select(key, "row", "r.*")

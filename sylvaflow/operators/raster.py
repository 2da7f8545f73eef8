"""Pixel tables (row, col, value): masks, neighbourhoods, blocks, zones and points.

Neighbourhoods are windows over lines of a grid, dealt out by line; sums are separable, so an 11 x 11 mean
takes one pass along rows and one along columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaflow.operators.quantiles import column_quantiles


def forest_mask(value: Column, binary: bool, classes: tuple[int, ...] = (16, 17)) -> Column:
    """1 where forest: a binary layer as it is, else by land-cover class; null is 0."""
    return F.coalesce(value.cast("int") if binary else value.isin(*classes).cast("int"), F.lit(0))


def is_binary(layer: DataFrame, value: str) -> bool:
    return layer.filter(F.col(value).isNotNull() & ~F.col(value).isin(0, 1)).isEmpty()


def vegetation_mask(pixels: DataFrame, keys: list[str], value: str, least: float = 0.4) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.coalesce((F.max(value) >= least).cast("int"), F.lit(0)).alias("mask"))


def combine_masks(a: DataFrame, b: DataFrame, keys: list[str], how: str = "and") -> DataFrame:
    """Masks of equal grids; a side without a pixel leaves the other's value."""
    x, y = F.coalesce("mask_a", "mask_b"), F.coalesce("mask_b", "mask_a")
    joined = a.select(*keys, F.col("mask").alias("mask_a")).join(b.select(*keys, F.col("mask").alias("mask_b")), keys, "full")
    return joined.select(*keys, (F.least(x, y) if how == "and" else F.greatest(x, y)).alias("mask"))


def focal_mean(grid: DataFrame, value: str = "value", size: int = 11) -> DataFrame:
    """grid(row, col, value) with `focal`, the mean of present cells in a size x size window. Each cell adds to
    the sums of its line's neighbours, also where no cell is; sums are combined before the shuffle."""
    half = size // 2
    near = grid.filter(F.col(value).isNotNull()).select("row", F.explode(F.sequence(F.col("col") - half, F.col("col") + half)).alias("col"), F.col(value).alias("_v"))
    sums = near.groupBy("row", "col").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    # a cell without a sum in its own row still needs its column's window
    sums = sums.join(grid.select("row", "col"), ["row", "col"], "full").fillna({"_s": 0.0, "_n": 0})
    line = Window.partitionBy("col").orderBy("row").rangeBetween(-half, half)
    focal = sums.withColumn("focal", F.try_divide(F.sum("_s").over(line), F.sum("_n").over(line))).select("row", "col", "focal")
    return grid.join(focal, ["row", "col"])


def position_index(grid: DataFrame, value: str = "value", size: int = 11) -> DataFrame:
    """Height above the surroundings: the value less its focal mean."""
    return focal_mean(grid, value, size).withColumn("tpi", F.col(value) - F.col("focal"))


def slope_aspect(grid: DataFrame, value: str = "value", resolution: float = 10.0) -> DataFrame:
    """grid(row, col, value): slope and aspect in degrees from the eight neighbours (Horn's
    weights); null where a neighbour is missing."""
    at = lambda c, line, by, d: F.first(c).over(Window.partitionBy(line).orderBy(by).rangeBetween(d, d))
    side = grid.withColumns({"_w": at(value, "row", "col", -1), "_e": at(value, "row", "col", 1)})
    side = side.withColumns({"_dx": F.col("_e") - F.col("_w"), "_sy": F.col("_w") + 2 * F.col(value) + F.col("_e")})
    full = side.withColumns({"_up": at(F.struct("_dx", "_sy"), "col", "row", -1), "_down": at(F.struct("_dx", "_sy"), "col", "row", 1)})
    dx = (F.col("_up._dx") + 2 * F.col("_dx") + F.col("_down._dx")) / (8 * resolution)
    dy = (F.col("_down._sy") - F.col("_up._sy")) / (8 * resolution)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    aspect = F.when(slope > 0, F.pmod(F.degrees(F.atan2(dx, -dy)) + F.lit(180.0), F.lit(360.0)))
    return full.withColumns({"slope": slope, "aspect": aspect}).drop("_w", "_e", "_dx", "_sy", "_up", "_down")


def block_aggregate(grid: DataFrame, factor: int, value: str, how: str = "mean") -> DataFrame:
    """Blocks of factor x factor cells: mean, or the most frequent value (ties: the least)."""
    block = grid.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"))
    if how == "mean":
        return block.agg(F.avg(value).alias(value))
    # as many groups as blocks and values: a value's count, then the best
    counts = grid.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), F.col(value)).agg(F.count("*").alias("_n"))
    return counts.groupBy("row", "col").agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def at_points(points: DataFrame, grid: DataFrame, x_min: float, y_max: float, resolution: float, value: str) -> DataFrame:
    """points(x, y, ...) with the value of the cell under them, null outside: an equi join on the cell."""
    cell = points.withColumns({"row": F.floor((F.lit(y_max) - F.col("y")) / resolution), "col": F.floor((F.col("x") - F.lit(x_min)) / resolution)})
    return cell.join(grid.select("row", "col", value), ["row", "col"], "left").select(*points.columns, value)


def zonal_mean(points: DataFrame, pixels: DataFrame, radius: float, value: str, key: str = "plot_id") -> DataFrame:
    """Mean of pixels(x, y, value) within `radius` of each of points(key, x, y): each point is put into the
    3 x 3 buckets around it, so only neighbours meet, never all pairs."""
    near = points.select(key, F.col("x").alias("px"), F.col("y").alias("py"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    spread = near.withColumn("o", around).select(key, "px", "py", (F.floor(F.col("px") / radius) + F.col("o.i")).alias("bx"), (F.floor(F.col("py") / radius) + F.col("o.j")).alias("by"))
    cells = pixels.withColumns({"bx": F.floor(F.col("x") / radius), "by": F.floor(F.col("y") / radius)})
    inside = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) <= radius * radius
    return cells.join(spread, ["bx", "by"]).filter(inside).groupBy(key).agg(F.avg(value).alias(value), F.count("*").alias("n_pixels"))


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon, by the parity of crossed edges, as one expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]]):
        if y1 != y2:
            over = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1)
            crossings = crossings + over.cast("int")
    return crossings % 2 == 1


def stretch(pixels: DataFrame, values: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The layers stretched linearly between two of their exact percentiles, clamped to 0..1; a layer whose
    percentiles are equal is 0.5, null stays null."""
    bounds = column_quantiles(pixels, values, [low, high])

    def stretched(c: str) -> Column:
        a, b = bounds[c]
        x = F.col(c).cast("double")
        scaled = (x - F.lit(a)) / F.lit(b - a) if a is not None and b > a else F.lit(0.5)
        return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))

    return pixels.withColumns({c: stretched(c) for c in values})

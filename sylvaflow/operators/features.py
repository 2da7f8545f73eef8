"""The feature matrix: one shuffle of long observations per plot, everything else on arrays of one row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaflow.functions import indices, series


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic splines through (x, y), linear beyond the ends; values of equal x are averaged. y may hold
    several series over the same x, one a row."""
    many = np.atleast_2d(y)
    x, back, number = np.unique(x, return_inverse=True, return_counts=True)
    y = np.zeros((len(many), len(x)))
    np.add.at(y.T, back, many.T)
    y /= number
    n = len(x)
    if n == 1:
        flat = np.repeat(y, len(at), axis=1)
        return flat if len(many) > 1 else flat[0]
    h, slope = np.diff(x), np.diff(y, axis=1) / np.diff(x)
    m = np.zeros_like(y)
    if n > 2:
        # second derivatives from the tridiagonal system, by elimination over all series at once
        c, d = np.zeros(n - 2), np.zeros((len(y), n - 2))
        rhs = 6 * np.diff(slope, axis=1)
        for i in range(n - 2):
            low = h[i] if i else 0.0
            pivot = 2 * (h[i] + h[i + 1]) - low * (c[i - 1] if i else 0.0)
            c[i], d[:, i] = h[i + 1] / pivot, (rhs[:, i] - low * (d[:, i - 1] if i else 0.0)) / pivot
        for i in range(n - 3, -1, -1):
            m[:, i + 1] = d[:, i] - (c[i] * m[:, i + 2] if i < n - 3 else 0.0)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    out = a * y[:, k] + b * y[:, k + 1] + ((a**3 - a) * m[:, k] + (b**3 - b) * m[:, k + 1]) * h[k] ** 2 / 6
    left, right = slope[:, :1] - h[0] * m[:, 1:2] / 6, slope[:, -1:] + h[-1] * m[:, -2:-1] / 6
    out = np.where(at < x[0], y[:, :1] + (at - x[0]) * left, out)
    out = np.where(at > x[-1], y[:, -1:] + (at - x[-1]) * right, out)
    return out if len(many) > 1 else out[0]


def _spline(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Series with the same days are solved together: one elimination for all of them."""
    for t, v, at in parts:
        out: list = [None] * len(t)
        groups: dict[tuple[bytes, bytes], list[tuple[int, np.ndarray]]] = {}
        for k, (x, y, goal) in enumerate(zip(t, v, at)):
            x, y = np.asarray(x, float), np.asarray([np.nan if z is None else z for z in y], float)
            ok = ~np.isnan(y)
            if ok.sum() >= 3:
                groups.setdefault((x[ok].tobytes(), np.asarray(goal, float).tobytes()), []).append((k, y[ok]))
        for (x, goal), rows in groups.items():
            values = natural_spline(np.frombuffer(x), np.stack([y for _, y in rows]), np.frombuffer(goal))
            for (k, _), row in zip(rows, np.atleast_2d(values)):
                out[k] = row
        yield pd.Series(out)


def interpolate(t: Column, v: Column, at: Column) -> Column:
    """A series at the days `at` by natural cubic spline; null with fewer than three values."""
    return F.pandas_udf(_spline, "array<double>")(t, v, at)


def smoother(size: int, order: int = 3, length: int = 7) -> np.ndarray:
    """The Savitzky-Golay filter of series of `size` points as a matrix, with the ends of series.savgol."""
    out = np.eye(size)
    if size >= length:
        weights = series.savgol_weights(order, length)
        for i in range(size):
            start = min(max(i - length // 2, 0), size - length)
            out[i] = 0
            out[i, start : start + length] = weights[i - start]
    return out


def smooth_bands(rows: Column, bands: list[str], at: np.ndarray) -> Column:
    """A struct of the bands of rows (an array of structs of t and bands) at the days `at`: natural cubic splines,
    then Savitzky-Golay. A band with fewer than three values is null. All bands take one pass through Arrow, and
    series with the same days, of any plots and bands of a batch, are solved together."""
    filter_, kind = smoother(len(at)), pa.list_(pa.float64())

    def run(lists: pa.Array) -> pa.Array:
        inner, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        entries = dict(zip([f.name for f in inner.type], inner.flatten()))
        t = entries["t"].to_numpy(zero_copy_only=False).astype(float)
        values = np.stack([entries[b].to_numpy(zero_copy_only=False).astype(float) for b in bands])
        out, filled = np.zeros((len(bands), len(lists), len(at))), np.zeros((len(bands), len(lists)), bool)
        groups: dict[bytes, list[tuple[int, int, np.ndarray]]] = {}
        for row, (a, b) in enumerate(zip(ends, ends[1:])):
            for k in range(len(bands)):
                y = values[k, a:b]
                good = ~(np.isnan(y) | np.isnan(t[a:b]))
                if good.sum() >= 3:
                    groups.setdefault(t[a:b][good].tobytes(), []).append((k, row, y[good]))
        for x, members in groups.items():
            k, row = [m[0] for m in members], [m[1] for m in members]
            out[k, row] = natural_spline(np.frombuffer(x), np.stack([m[2] for m in members]), at) @ filter_.T
            filled[k, row] = True
        columns = []
        for k in range(len(bands)):
            offsets = np.concatenate([[0], np.cumsum(filled[k] * len(at))]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[k, filled[k]].reshape(-1)), type=kind, mask=pa.array(~filled[k])))
        return pa.StructArray.from_arrays(columns, names)

    names = [f"b{k}" for k in range(len(bands))]
    return F.arrow_udf(run, T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]))(rows)


def regular_series(long: DataFrame, keys: list[str], date: str, value: str, grid: Column, origin: str) -> DataFrame:
    """keys, v: the series of long observations at the days of `grid` (days since `origin`), smoothed."""
    day = F.datediff(date, F.to_date(F.lit(origin))).cast("double")
    rows = series.to_series(daily(long.withColumn("_t", day), keys, "_t", [value]), keys, "_t", value)
    rows = rows.withColumn("v", interpolate(F.col("t"), F.col("v"), grid))
    return rows.select(*keys, series.savgol(F.col("v")).alias("v"))


def _field(name: str):
    return lambda r: r[name]


def _radar(name: str):
    return lambda r: indices.radar_indices(r["vv"], r["vh"])[name]


def feature_matrix(wide: DataFrame, bands: list[str], key: str = "plot_id", date: str = "date", year: int = 2024, by_date: bool = False, terrain: tuple[str, ...] = ()) -> DataFrame:
    """One row per plot: statistics of every band and index, phenology and harmonics of NDVI, radar and
    terrain features, where their columns are there. by_date adds a column per date of the grid.

    wide(key, date, bands...): repeated dates of a plot are averaged by the spline, missing values skipped; a
    band with fewer than three values has null features. All bands go through one shuffle, as one struct.
    """
    days = np.arange(0, (dt.date(year + 1, 1, 1) - dt.date(year, 1, 1)).days, 5, dtype=float)
    day = F.datediff(date, F.to_date(F.lit(f"{year}-01-01"))).cast("double")
    row = F.struct(day.alias("t"), *(F.col(b).cast("double").alias(b) for b in bands))
    # equal dates are averaged first, in partial sums, so a plot's array has one entry a date however many rows it has
    dated = wide.groupBy(key, date).agg(*(F.avg(F.col(b).cast("double")).alias(b) for b in bands), *(F.first(c, ignorenulls=True).alias(c) for c in terrain))
    # a plot's row is small and its features are dear: all tasks are wanted, so AQE may not merge them by bytes
    dated = dated.repartition(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    plots = dated.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"), *(F.first(c, ignorenulls=True).alias(c) for c in terrain))
    plots = plots.withColumn("rows", smooth_bands(F.col("rows"), bands, days))
    plots = plots.withColumns({f"s_{b}": F.col("rows")[f"b{k}"] for k, b in enumerate(bands)}).drop("rows")
    names = list(bands)
    if {"B02", "B03", "B04", "B05", "B08", "B11", "B12"} <= set(bands):
        zipped = F.arrays_zip(*(F.col(f"s_{b}").alias(b) for b in bands))
        formula = {
            "NDVI": lambda r: indices.ndvi(r["B08"], r["B04"]), "EVI": lambda r: indices.evi(r["B08"], r["B04"], r["B02"]), "NDWI": lambda r: indices.ndwi(r["B08"], r["B11"]),
            "CRI": lambda r: indices.cri(r["B03"], r["B05"]), "RENDVI": lambda r: indices.rendvi(r["B08"], r["B05"]), "NBR": lambda r: indices.nbr(r["B08"], r["B12"]),
        }
        plots = plots.withColumns({f"s_{n}": F.transform(zipped, f) for n, f in formula.items()})
        names += list(formula)
    out = [F.col(key), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in terrain)]
    arrays = {f"{n}_": F.col(f"s_{n}") for n in names}
    if "NDVI" in names:
        doy = F.array(*(F.lit(float(d + 1)) for d in days))
        plots = series.with_phenology(plots.withColumn("doy", doy), "doy", "s_NDVI")
        out += [F.col(c) for c in plots.columns if c.startswith("pheno_")]
        out += series.fourier(F.col("s_NDVI"), prefix="NDVI_fourier_")
    if {"S1_VV", "S1_VH"} <= set(bands):
        both = F.arrays_zip(F.col("s_S1_VV").alias("vv"), F.col("s_S1_VH").alias("vh"))
        arrays |= {f"S1_{n}_": F.transform(both, _radar(n)) for n in ("ratio", "RVI")}
        out += series.quarter_means(F.col("s_S1_VH"), "S1_VH_")
    if by_date:
        days = [1 + 5 * k for k in range(73)]
        out += [F.try_element_at(F.col(f"s_{n}"), F.lit(k + 1)).alias(f"{n}_d{d:03d}") for n in names for k, d in enumerate(days)]
    plots = series.with_statistics(plots, arrays)
    return plots.select(*out, *(f"{p}{n}" for p in arrays for n in series.STATISTICS))


def valid_series(long: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Rows of the keys with `least` values or more; the counts are combined before they are shuffled."""
    good = long.groupBy(*keys).agg(F.count(value).alias("_n")).filter(F.col("_n") >= least).select(*keys)
    return long.join(good, keys, "left_semi")


def complete_dates(long: DataFrame, date: str, band: str, bands: list[str]) -> DataFrame:
    """Rows of the dates that have all bands."""
    own = long.filter(F.col(band).isin(*bands))
    good = own.groupBy(date).agg(F.collect_set(band).alias("_b")).filter(F.size("_b") == len(bands)).select(date)
    return own.join(good, date, "left_semi")


def multi_year(yearly: dict[int, DataFrame], key: str = "plot_id", spread: str = "pheno_") -> DataFrame:
    """Means of features over years, and `<feature>_sd_interannual` of those whose name begins with `spread`.

    Years are joined by the key, not by row number, over the columns of the first year; a later year
    that lacks one has nulls there, which no mean counts."""
    first = next(iter(yearly.values()))
    names = [c for c in first.columns if c != key]
    rows = None
    for year, frame in yearly.items():
        own = frame.select(key, F.lit(year).alias("_year"), *((F.col(c) if c in frame.columns else F.lit(None)).cast("double").alias(c) for c in names))
        rows = own if rows is None else rows.unionByName(own)
    sds = [c for c in names if c.startswith(spread)] if len(yearly) > 1 else []
    return rows.groupBy(key).agg(F.count_distinct("_year").alias("n_years"), *(F.avg(c).alias(c) for c in names), *(F.stddev_samp(c).alias(f"{c}_sd_interannual") for c in sds))


def pixel_features(cube: DataFrame, bands: list[str], mask: DataFrame | None = None, year: int = 2024, least: int = 3, terrain: tuple[str, ...] = ()) -> DataFrame:
    """The feature matrix of pixels: cube(pixel_id, date, bands..., terrain...), only pixels of mask(pixel_id,
    mask = 1) with `least` values of the first band or more. Radar bands S1_VV and S1_VH, joined by pixel and
    date before, give their features beside the optical ones."""
    if mask is not None:
        cube = cube.join(mask.filter("mask = 1").select("pixel_id"), "pixel_id", "left_semi")
    return feature_matrix(valid_series(cube, ["pixel_id"], bands[0], least), bands, key="pixel_id", year=year, terrain=terrain)


def soft_map(predictions: DataFrame, grid: DataFrame, least: float = 0.10) -> DataFrame:
    """grid(pixel_id, ...) with the layers of predictions(pixel_id, probability): class_idx, confidence,
    shannon, richness and presence (array of 0 and 1); null where a pixel has no prediction."""
    p = F.col("probability")
    presence = indices.presence(p, least)
    layers = predictions.select("pixel_id", indices.argmax(p).alias("class_idx"), F.array_max(p).alias("confidence"), indices.shannon(p).alias("shannon"), F.aggregate(presence, F.lit(0), lambda s, k: s + k).alias("richness"), presence.alias("presence"))
    return grid.join(layers, "pixel_id", "left")


def daily(frame: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """Means of the values by key and date: partial sums before the shuffle, so a hot key has one row a date after it."""
    return frame.groupBy(*keys, date).agg(*(F.avg(v).alias(v) for v in values))

"""Functions of one series, held as parallel arrays ordered in time, by higher-order functions.

A series is one row's array, so nothing here shuffles. `v` are values, `t` days (of the year).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ("mean", "sd", "min", "max", "range", "median", "q25", "q75", "iqr")
KEY_DAYS = (90, 135, 182, 244, 305)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    """Null of an empty array."""
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def statistics(value: Column, prefix: str = "") -> list[Column]:
    """The nine statistics as aggregates of a group; nulls don't count."""
    q = {n: F.percentile(value, F.lit(p)) for n, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))}
    parts = {"mean": F.avg(value), "sd": F.stddev_samp(value), "min": F.min(value), "max": F.max(value), "range": F.max(value) - F.min(value), **q, "iqr": q["q75"] - q["q25"]}
    return [parts[n].alias(f"{prefix}{n}") for n in STATISTICS]


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def array_statistics(v: Column) -> Column:
    """The nine statistics of an array's values, as a struct."""

    def of(own: Column) -> Column:
        n = F.size(own)

        def quantile(p: float) -> Column:
            h = (n - 1) * F.lit(p)
            at = F.floor(h).cast("int")
            low = F.try_element_at(own, at + 1)
            return F.when(n > 0, low + (h - at) * (F.coalesce(F.try_element_at(own, at + 2), low) - low))

        def with_mean(m: Column) -> Column:
            spread = F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
            low, high = F.try_element_at(own, F.lit(1)), F.try_element_at(own, n)
            parts = {"mean": m, "sd": F.when(n > 1, F.sqrt(spread / (n - 1))), "min": low, "max": high, "range": high - low, "median": quantile(0.5), "q25": quantile(0.25), "q75": quantile(0.75)}
            return F.struct(*(c.alias(k) for k, c in parts.items()))

        return let(mean(own), with_mean)

    own = F.array_sort(F.filter(v, lambda x: x.isNotNull()))
    return let(F.when(F.size(own) > 0, own), of)


def with_statistics(frame: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """frame with the nine statistics of each array, their names after its prefix. Null of an empty array."""
    out = frame.withColumns({f"_s{k}": array_statistics(c) for k, c in enumerate(arrays.values())})
    got = {}
    for k, prefix in enumerate(arrays):
        s = F.col(f"_s{k}")
        got |= {f"{prefix}{n}": s["q75"] - s["q25"] if n == "iqr" else s[n] for n in STATISTICS}
    return out.withColumns(got).drop(*(f"_s{k}" for k in range(len(arrays))))


def date_grid(year: int, days: int = 5) -> Column:
    """Array of the dates of a year, `days` apart."""
    return F.expr(f"sequence(date'{year}-01-01', date'{year}-12-31', interval {days} days)")


def resample(t: Column, v: Column, at: Column) -> Column:
    """Linear between neighbours, constant beyond the ends; t ascending, without nulls. Null without points."""
    def one(x: Column) -> Column:
        k = F.size(F.filter(t, lambda d: d <= x))
        low, high = F.try_element_at(t, F.greatest(k, F.lit(1))), F.try_element_at(t, F.least(k + 1, F.size(t)))
        a, b = F.try_element_at(v, F.greatest(k, F.lit(1))), F.try_element_at(v, F.least(k + 1, F.size(v)))
        return F.when((k == 0) | (high == low), F.when(k == 0, F.try_element_at(v, F.lit(1))).otherwise(a)).otherwise(a + (b - a) * (x - low) / (high - low))

    return F.when(F.size(t) > 0, F.transform(at, one))


def gap_fill(v: Column, least: int = 7) -> Column:
    """Nulls by position: linear, constant at the ends; untouched with fewer than `least` values."""
    at = F.transform(v, lambda x, i: F.when(x.isNotNull(), i.cast("double")))
    t = F.filter(at, lambda i: i.isNotNull())
    filled = resample(t, F.filter(v, lambda x: x.isNotNull()), F.transform(v, lambda x, i: i.cast("double")))
    return F.when(F.size(t) == F.size(v), v).when(F.size(t) < least, v).otherwise(filled)


def moving_average(v: Column, width: int = 7) -> Column:
    """Centred; what is too near an end keeps its value."""
    half = width // 2
    return F.transform(v, lambda x, i: F.when((i >= half) & (i + half < F.size(v)), total(F.slice(v, i - half + 1, width)) / width).otherwise(x))


def savgol_weights(order: int = 3, length: int = 7) -> np.ndarray:
    """Row k: weights of the fitted polynomial at point k of a window."""
    x = np.vander(np.arange(length) - length // 2, order + 1, increasing=True)
    return x @ np.linalg.pinv(x.astype(float))


def savgol(v: Column, order: int = 3, length: int = 7) -> Column:
    """Savitzky-Golay; the ends take the fit of the first or last window. Shorter series stay as they are."""
    w, half = savgol_weights(order, length), length // 2
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in w))

    def one(x: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - half, F.size(v) - length))
        return total(F.zip_with(F.slice(v, start + 1, length), F.element_at(rows, i - start + 1), lambda a, b: a * b))

    return F.when(F.size(v) >= length, F.transform(v, one)).otherwise(v)


def fourier(v: Column, harmonics: int = 3, prefix: str = "fourier_") -> list[Column]:
    """Mean, amplitudes and phases by the transform's definition; null with a null inside or too few points."""
    n = F.size(v)
    ok = (n >= 2 * harmonics) & ~F.exists(v, lambda x: x.isNull())
    out = [F.when(ok, mean(v)).alias(f"{prefix}mean")]
    amps, phases = [], []
    for k in range(1, harmonics + 1):
        turn = F.transform(v, lambda x, i: F.struct((x * F.cos(F.lit(2 * np.pi * k) * i / n)).alias("c"), (x * F.sin(F.lit(2 * np.pi * k) * i / n)).alias("s")))  # noqa: B023
        re, im = total(F.transform(turn, lambda p: p["c"])), -total(F.transform(turn, lambda p: p["s"]))
        amps.append(F.when(ok, F.sqrt(re * re + im * im) * 2 / n).alias(f"{prefix}amp_{k}"))
        phases.append(F.when(ok, F.atan2(im, re)).alias(f"{prefix}phase_{k}"))
    return out + amps + phases


def quarter_means(v: Column, prefix: str = "") -> list[Column]:
    """Means of the quarters by position (cut at floor(k * n / 4)), and second less fourth; null below four points."""
    n = F.size(v)
    cut = [F.floor(n * k / 4).cast("int") for k in range(5)]
    q = [F.when(n >= 4, mean(F.filter(F.slice(v, cut[k] + 1, cut[k + 1] - cut[k]), lambda x: x.isNotNull()))) for k in range(4)]
    return [*(q[k].alias(f"{prefix}q{k + 1}") for k in range(4)), (q[1] - q[3]).alias(f"{prefix}summer_winter")]


def thin(rows: Column, days: int) -> Column:
    """Of an array of structs whose field date is ordered: those at least `days` after the last kept. The last
    kept date is carried along, and marks are set in one pass, so the work is linear."""
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<int>").alias("kept"), F.lit(1).alias("at"))

    def step(s: Column, r: Column) -> Column:
        take = s["last"].isNull() | (F.datediff(r["date"], s["last"]) >= days)
        kept = F.when(take, F.array_append(s["kept"], s["at"])).otherwise(s["kept"])
        return F.struct(F.when(take, r["date"]).otherwise(s["last"]).alias("last"), kept.alias("kept"), (s["at"] + 1).alias("at"))

    return F.transform(F.aggregate(rows, start, step)["kept"], lambda k: F.element_at(rows, k))


def evenly(start: Column, end: Column, n: int) -> Column:
    """Array of n dates from start to end, evenly spaced (cut to whole days)."""
    span = F.datediff(end, start)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(start, F.floor(i * span / max(n - 1, 1)).cast("int")))


def _slope(t: Column, v: Column, low: int, high: int) -> Column:
    """Least-squares slope over days low..high; null with fewer than three points."""
    own = F.filter(F.arrays_zip(t.alias("t"), v.alias("v")), lambda p: (p["t"] >= low) & (p["t"] <= high))
    n = F.size(own)
    s = lambda f: F.aggregate(own, F.lit(0.0), lambda a, p: a + f(p))
    return F.when(n > 2, (n * s(lambda p: p["t"] * p["v"]) - s(lambda p: p["t"]) * s(lambda p: p["v"])) / (n * s(lambda p: p["t"] * p["t"]) - s(lambda p: p["t"]) * s(lambda p: p["t"])))


def _area(own: Column) -> Column:
    """Trapezoids under an array of (t, v)."""
    pairs = F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: (b["t"] - a["t"]) * (a["v"] + b["v"]) / 2)
    return total(pairs)


def with_phenology(frame: DataFrame, t: str = "t", v: str = "v", prefix: str = "pheno_", threshold: float = 0.5) -> DataFrame:
    """frame with the 26 seasonal metrics of arrays t (double days of the year, ascending) and v.

    Null values go, with their days; with fewer than three left all metrics are null. Where a mask is empty
    its mean is null. Each step is a projection, so no expression is evaluated twice.
    """
    ok = F.filter(F.arrays_zip(F.col(t).alias("t"), F.col(v).alias("v")), lambda p: p["t"].isNotNull() & p["v"].isNotNull())
    kept = frame.columns
    out = frame.withColumn("_own", F.when(F.size(ok) >= 3, ok))
    out = out.withColumns({"_t": F.transform("_own", lambda p: p["t"]), "_v": F.transform("_own", lambda p: p["v"])})
    out = out.withColumns({"_min": F.array_min("_v"), "_max": F.array_max("_v"), "_n": F.size("_v")})
    out = out.withColumns({"_at": F.array_position("_v", F.col("_max")).cast("int"), "_level": F.col("_min") + F.lit(threshold) * (F.col("_max") - F.col("_min"))})
    level, at = F.col("_level"), F.col("_at")
    up = F.filter(F.slice("_own", F.lit(1), at), lambda p: p["v"] >= level)
    down = F.when(at < F.col("_n"), F.filter(F.slice("_own", at, F.col("_n") - at + 1), lambda p: p["v"] <= level))
    out = out.withColumns({"_sos": F.try_element_at(up, F.lit(1))["t"], "_eos": F.try_element_at(down, F.lit(1))["t"], "_peak": F.try_element_at("_t", at)})
    sos, eos, peak = F.col("_sos"), F.col("_eos"), F.col("_peak")
    growing = F.filter("_own", lambda p: (p["t"] >= sos) & (p["t"] <= eos))
    season = lambda f: mean(F.transform(F.filter("_own", lambda p: f(p["t"])), lambda p: p["v"]))
    out = out.withColumns({
        "_growing": F.when(eos.isNotNull() & (F.size(growing) > 1), _area(growing)),
        "_winter": season(lambda d: (d <= 80) | (d >= 335)), "_spring": season(lambda d: (d > 80) & (d <= 172)),
        "_summer": season(lambda d: (d > 172) & (d <= 264)), "_autumn": season(lambda d: (d > 264) & (d < 335)),
        "_mean": mean(F.col("_v")),
    })
    m = F.col("_mean")
    sd = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.col("_n") - 1))
    inner = lambda k: F.slice("_v", k, F.col("_n") - 2)
    peaks = F.zip_with(F.zip_with(inner(1), inner(2), lambda a, b: b > a), F.zip_with(inner(2), inner(3), lambda a, b: b < a), lambda a, b: (a & b).cast("int"))
    near = lambda d: F.array_min(F.transform("_own", lambda p, i: F.struct(F.abs(p["t"] - d).alias("d"), i.alias("i"), p["v"].alias("v"))))["v"]
    valid = F.col("_own").isNotNull()
    senescence = eos - peak
    named = {
        "SOS": sos, "EOS": eos, "LOS": eos - sos, "max_doy": peak, "max_ndvi": F.col("_max"), "min_ndvi": F.col("_min"), "amplitude": F.col("_max") - F.col("_min"),
        "total_integral": _area(F.col("_own")), "growing_integral": F.col("_growing"),
        "greening_rate": _slope(F.col("_t"), F.col("_v"), 60, 180), "browning_rate": _slope(F.col("_t"), F.col("_v"), 240, 340),
        "ndvi_winter": F.col("_winter"), "ndvi_spring": F.col("_spring"), "ndvi_summer": F.col("_summer"), "ndvi_autumn": F.col("_autumn"),
        "ratio_sum_win": F.when(F.abs("_winter") > 0.01, F.col("_summer") / F.col("_winter")), "cv": F.try_divide(sd, m),
        "greenup_dur": F.when(eos.isNotNull(), peak - sos), "senesc_dur": senescence, "asymmetry": F.when(senescence > 0, (peak - sos) / senescence),
        "n_peaks": F.aggregate(peaks, F.lit(0), lambda s, x: s + x), **{f"ndvi_doy{d:03d}": near(d) for d in KEY_DAYS},
    }
    return out.select(*kept, *(F.when(valid, c).alias(f"{prefix}{n}") for n, c in named.items()))


def phenotype(t: Column, v: Column) -> Column:
    """evergreen, deciduous or semi_deciduous by variation and summer to winter ratio; null where a season is empty."""
    own = F.filter(F.arrays_zip(t.alias("t"), v.alias("v")), lambda p: p["v"].isNotNull())
    def of(own: Column) -> Column:
        season = lambda test: mean(F.transform(F.filter(own, lambda p: test(p["t"])), lambda p: p["v"]))
        m = mean(F.transform(own, lambda p: p["v"]))
        return F.struct(m.alias("m"), season(lambda d: (d <= 59) | (d >= 335)).alias("w"), season(lambda d: (d >= 152) & (d <= 243)).alias("s"), own.alias("own"))

    def label(x: Column) -> Column:
        m = x["m"]
        cv = F.try_divide(F.sqrt(F.aggregate(x["own"], F.lit(0.0), lambda s, p: s + (p["v"] - m) * (p["v"] - m)) / (F.size(x["own"]) - 1)), m)
        ratio = F.when(x["w"] > 0.05, x["s"] / x["w"]).when(x["w"].isNotNull(), F.lit(float("inf")))
        return let(F.struct(cv.alias("cv"), ratio.alias("r")), lambda y: F.when(y["cv"].isNull() | y["r"].isNull(), F.lit(None).cast("string")).when((y["cv"] < 0.10) & (y["r"] < 1.3), "evergreen").when((y["cv"] > 0.25) | (y["r"] > 2.0), "deciduous").otherwise("semi_deciduous"))

    return let(let(own, of), label)


def to_series(frame: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """One row per key with arrays t and v in order of t: the one shuffle that a series needs."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).alias("v"))))
    return frame.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.transform("_rows", lambda r: r["t"]).alias("t"), F.transform("_rows", lambda r: r["v"]).alias("v"))

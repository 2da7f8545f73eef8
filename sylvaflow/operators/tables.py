"""Joins, look-ups, set operations and reshaping over tables of any size.

Dimensions are broadcast only up to DIMENSION_ROWS, which is checked; beyond it Spark chooses the join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaflow.operators.quantiles import column_quantiles

DIMENSION_ROWS = 100_000


def small(frame: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """The frame, to be broadcast if it has `most` rows or fewer; counting stops there."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def inject_terrain(series: DataFrame, terrain: DataFrame, key: str = "plot_id") -> DataFrame:
    """Left join on the key, absent terrain as 0. If no id matches, ids are compared without extension."""
    values = [c for c in terrain.columns if c != key]
    if series.join(terrain, key, "left_semi").isEmpty():
        bare = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.[^.]*$", "")
        right = terrain.withColumn("_bare", bare(key)).drop(key).dropDuplicates(["_bare"])
        joined = series.withColumn("_bare", bare(key)).join(small(right), "_bare", "left").drop("_bare")
    else:
        joined = series.join(small(terrain), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in values}).select(*series.columns, *values)


def remap(frame: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Values by a dictionary; what it lacks stays."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return frame.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)) if mapping else F.col(column))


def first_match(frame: DataFrame, dimension: DataFrame, keys: list[Column], dim_key: str, values: list[str]) -> DataFrame:
    """Values of the dimension by the first of several keys that is in it, null if none is."""
    right = dimension.groupBy(dim_key).agg(*(F.first(c).alias(c) for c in values))
    out = frame
    for i, k in enumerate(keys):
        side = right.select(F.col(dim_key).alias(f"_k{i}"), F.struct(*values).alias(f"_v{i}"))
        out = out.join(small(side), k == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    hit = F.coalesce(*(F.col(f"_v{i}") for i in range(len(keys))))
    return out.select(*frame.columns, *(hit[c].alias(c) for c in values))


def split_by_lists(frame: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Column `split`: test if the id is in that list only or both, else train (also rows in neither)."""
    listed = train.select(key, F.lit("train").alias("_s")).unionByName(test.select(key, F.lit("test").alias("_s")))
    side = listed.groupBy(key).agg(F.min("_s").alias("_s"))
    return frame.join(small(side), key, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).select(*frame.columns, "split")


def nearest(frame: DataFrame, keys: list[str], at: str, value: str, days: tuple[int, ...]) -> DataFrame:
    """Per key the value at the day nearest to each of `days`; of two, the earlier."""
    picks = [F.min_by(value, F.struct(F.abs(F.col(at) - d), F.col(at))).alias(f"{value}_{d:03d}") for d in days]
    return frame.groupBy(*keys).agg(*picks)


def dominant(frame: DataFrame, keys: list[str], weight: str, tie: str) -> DataFrame:
    """The row of greatest weight of each key, by one partial aggregate instead of a sort; ties: least `tie`."""
    rest = [c for c in frame.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(weight)).alias("w"), F.col(tie).alias("t")))
    return frame.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def union_common(frames: list[DataFrame]) -> DataFrame:
    """All rows over the columns that every frame has, in the first one's order."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, (f.select(*names) for f in frames))


def align(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in a model's order, absent ones as 0."""
    return frame.select(*(F.col(c) if c in frame.columns else F.lit(0.0).alias(c) for c in columns))


#: Name patterns of features; radar features are chosen only when asked for.
FEATURE_PATTERNS = (r"^B\d{1,2}A?_", r"^NDVI_", r"^EVI_", r"^NDWI_", r"^CRI_", r"^RENDVI_", r"^NBR_", r"^pheno_", r"^DEM_")


def null_shares(frame: DataFrame, columns: list[str]) -> dict[str, float]:
    row = frame.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns)).first()
    return {c: row[c] if row[c] is not None else 1.0 for c in columns}


def select_features(frame: DataFrame, include_radar: bool = False, most_null: float = 0.5, ids: tuple[str, ...] = ("plot_id", "species_code", "species_name")) -> list[str]:
    """Names of feature columns with a share of nulls below `most_null`: one pass over the table."""
    patterns = [*FEATURE_PATTERNS, *([r"^S1_"] if include_radar else [])]
    names = [c for c in frame.columns if c not in ids and any(re.search(p, c) for p in patterns)]
    return [c for c, share in null_shares(frame, names).items() if share < most_null] if names else []


def _entries(frame: DataFrame, columns: list[str]) -> DataFrame:
    """k (number of the column), v: one row a value, as plans that aggregate many columns side by side grow with them."""
    return frame.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("k", "v"))


def drop_constant(frame: DataFrame, columns: list[str]) -> list[str]:
    """Names of the columns that vary."""
    if not columns:
        return []
    found = dict(_entries(frame, columns).groupBy("k").agg(F.var_samp("v")).collect())
    return [c for k, c in enumerate(columns) if found.get(k)]


def impute_median(frame: DataFrame, columns: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Nulls as the exact median of the batch, or of `reference`; columns without values become 0."""
    if not columns:
        return frame
    gaps = dict(_entries(frame, columns).groupBy("k").agg(F.max(F.col("v").isNull())).collect())
    lacking = [c for k, c in enumerate(columns) if gaps.get(k)]  # a median takes several passes: only of those
    median = {c: found[0] for c, found in column_quantiles(reference or frame, lacking, [0.5]).items()} if lacking else {}
    return frame.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(median[c] if median.get(c) is not None else 0.0)) for c in columns})


def normalise(frame: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """minmax (constant: 0.5) and zscore (no spread: 0) within the keys."""
    x = F.col(column)
    stats = frame.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    joined = frame.join(stats, keys)
    low, high, sd = F.col("_lo"), F.col("_hi"), F.col("_s")
    out = {"minmax": F.when(high > low, (x - low) / (high - low)).otherwise(0.5), "zscore": F.when(sd > 0, (x - F.col("_m")) / sd).otherwise(0.0)}
    return joined.withColumns(out).select(*frame.columns, *out)


def to_wide(frame: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide with a given list of names, so the pivot needs no pass to find them."""
    return frame.groupBy(key).pivot(name, names).agg(F.first(value))


def to_long(frame: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return frame.unpivot(keys, values, "metric", "value")


def row_zscore(frame: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each value less its row's mean over its row's sample deviation."""
    rows = frame.withColumn("_row", F.array(*(F.col(c).cast("double") for c in values)))
    rows = rows.withColumn("_m", F.aggregate("_row", F.lit(0.0), lambda s, x: s + x) / len(values))
    spread = F.aggregate("_row", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m")))
    rows = rows.withColumn("_sd", F.sqrt(spread / (len(values) - 1)))
    return rows.select(*keys, *(F.try_divide(F.col(c) - F.col("_m"), "_sd").alias(c) for c in values))


def ranked(frame: DataFrame, order: str, name: str, n: int) -> DataFrame:
    """The top-k report: the n greatest, ties by name, with their rank. Only n rows reach the window."""
    top = frame.orderBy(F.desc(order), name).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(order), name)))


def between_dates(frame: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Rows dated start .. end, both included: a range that scans can prune by."""
    return frame.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def of_members(frame: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return frame.filter(F.col(column).isin(*values))


def without_classes(frame: DataFrame, columns: tuple[str, ...], classes: tuple) -> DataFrame:
    """Rows in which none of the columns is one of the classes; a null is none of them."""
    bad = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).isin(*classes), F.lit(False)) for c in columns))
    return frame.filter(~bad)


def matching(frame: DataFrame, column: str, pattern: str) -> DataFrame:
    return frame.filter(F.col(column).rlike(pattern))


def detected(statistics: DataFrame, count: str, label: str, cleared: tuple[str, ...]) -> DataFrame:
    """Classes with pixels, without the labels of cleared land."""
    return statistics.filter((F.col(count) > 0) & ~F.col(label).isin(*cleared))


def confident(frame: DataFrame, label: str, confidence: str, least: float = 0.6) -> DataFrame:
    """The label where the confidence is `least` or more, else null."""
    return frame.withColumn(label, F.when(F.col(confidence) >= least, F.col(label)))


def renamed(frame: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Column names by a regular expression."""
    return frame.withColumnsRenamed({c: re.sub(pattern, replacement, c) for c in frame.columns})


def numeric(frame: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """All columns but the ids as doubles; what is no number is null."""
    return frame.select(*(F.col(c) if c in ids else F.col(c).try_cast("double").alias(c) for c in frame.columns))


def level_counts(frame: DataFrame, column: str, levels: tuple[str, ...]) -> DataFrame:
    """level, n for every level, 0 for absent ones."""
    counts = frame.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    all_levels = frame.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    return all_levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def shares(frame: DataFrame, column: str) -> DataFrame:
    """class, n, pct: a histogram; the total is summed from the counts."""
    counts = frame.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (100 * F.col("n") / F.col("t")).alias("pct"))  # one row


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def central_scene(frame: DataFrame, keys: list[str], day: str, value: str, near: int = 182, low: int = 152, high: int = 243) -> DataFrame:
    """Per key the scene nearest to a day of the year within low .. high (of two the earlier); without one
    there the middle scene: the one at place n // 2 + 1 in order of days. frame has a row a key and day."""
    d = F.col(day)
    pick = F.min_by(F.struct(day, value), F.when(d.between(low, high), F.struct(F.abs(d - near), d)))
    ordered = F.array_sort(F.collect_list(F.struct(day, value)))
    found = frame.groupBy(*keys).agg(pick.alias("_p"), ordered.alias("_o"))
    scene = F.coalesce("_p", F.try_element_at("_o", F.floor(F.size("_o") / 2).cast("int") + 1))
    return found.select(*keys, scene[day].alias(day), scene[value].alias(value))


def rescaled(frame: DataFrame, bands: list[str], by: str, above: float = 2.0) -> DataFrame:
    """Bands over 10000 if the greatest value of `by` says that they are stored as integers: one pass to tell."""
    top = frame.agg(F.max(by)).first()[0]
    return frame.withColumns({b: F.col(b) / 10000 for b in bands}) if top is not None and top > above else frame


def band_zscores(frame: DataFrame, bands: list[str], reference: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (sd + 1e-8) of each band, mean and sample deviation of all rows of the split, or of `reference`."""
    row = (reference or frame).agg(*(F.avg(b).alias(f"m_{b}") for b in bands), *(F.stddev_samp(b).alias(f"s_{b}") for b in bands)).first()
    return frame.withColumns({b: (F.col(b) - F.lit(row[f"m_{b}"])) / F.lit((row[f"s_{b}"] or 0.0) + 1e-8) for b in bands})


def first_rows(frame: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of an order: a report."""
    return frame.orderBy(*order).limit(n)


def tensor(frame: DataFrame, keys: list[str], bands: list[str], dates: list[str], pattern: str = "{band}_d{date}") -> DataFrame:
    """keys, x: bands x dates as nested arrays from columns named by the pattern; absent columns and nulls are 0."""
    cell = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in frame.columns else F.lit(0.0)
    rows = F.array(*(F.array(*(cell(pattern.format(band=b, date=d)) for d in dates)) for b in bands))
    return frame.select(*keys, rows.alias("x"))


def to_json_rows(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, json: each row's other columns as one JSON object."""
    return frame.select(*keys, F.to_json(F.struct(*(c for c in frame.columns if c not in keys))).alias("json"))

"""Class counts, weights, confusion, scores and map statistics. What follows the first aggregate is as small
as the number of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_weights(frame: DataFrame, label: str) -> DataFrame:
    """class, n, weight = N / (K n), alternative = 1 / (n + 1) scaled to sum K."""
    counts = frame.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(1 / (F.col("n") + 1)).alias("inv"))
    joined = counts.crossJoin(F.broadcast(sums))  # one row
    return joined.select("class", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"), (F.col("k") / (F.col("n") + 1) / F.col("inv")).alias("alternative"))


def confusion(frame: DataFrame, truth: str, predicted: str) -> DataFrame:
    """reference, prediction, n, share (of the reference): every pair of classes, absent ones with 0.

    The grid is classes x classes, made of the counted pairs, not of rows."""
    counts = frame.groupBy(F.col(truth).alias("reference"), F.col(predicted).alias("prediction")).agg(F.count("*").alias("n"))
    counts = counts.filter("reference is not null and prediction is not null")
    classes = counts.select(F.explode(F.array("reference", "prediction")).alias("c")).distinct()
    listed = classes.agg(F.array_sort(F.collect_list("c")).alias("cs"))
    grid = listed.select("cs", F.explode("cs").alias("reference")).select("reference", F.explode("cs").alias("prediction"))
    full = grid.join(counts, ["reference", "prediction"], "left").fillna({"n": 0})
    sums = full.groupBy("reference").agg(F.sum("n").alias("_t"))
    return full.join(sums, "reference").select("reference", "prediction", "n", F.coalesce(F.try_divide("n", "_t"), F.lit(0.0)).alias("share"))


def per_class(table: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 from confusion(); undefined ones are 0."""
    diagonal = F.sum(F.when(F.col("reference") == F.col("prediction"), F.col("n")).otherwise(0))
    real = table.groupBy(F.col("reference").alias("class")).agg(F.sum("n").alias("support"), diagonal.alias("tp"))
    said = table.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = real.join(said, "class").withColumns({"precision": zero(F.try_divide("tp", "said")), "recall": zero(F.try_divide("tp", "support"))})
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("class", "support", "precision", "recall", f1.alias("f1"))


def evaluation(frame: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, kappa, macro precision, recall and f1, weighted f1: those of confusion() and per_class(),
    from the counted pairs in one line of aggregates, as a plan that meets the table again for each sum is large."""
    pairs = frame.groupBy(F.col(truth).alias("reference"), F.col(predicted).alias("prediction")).agg(F.count("*").cast("double").alias("n"))
    pairs = pairs.filter("reference is not null and prediction is not null")
    none, n = F.lit(0.0), F.col("n")
    real = F.struct(F.col("reference").alias("class"), n.alias("support"), F.when(F.col("reference") == F.col("prediction"), n).otherwise(none).alias("tp"), none.alias("said"))
    said = F.struct(F.col("prediction").alias("class"), none.alias("support"), none.alias("tp"), n.alias("said"))
    sums = pairs.select(F.explode(F.array(real, said)).alias("e")).select("e.*").groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "tp", "said")))
    zero = lambda c: F.coalesce(c, none)
    scores = sums.withColumns({"precision": zero(F.try_divide("tp", "said")), "recall": zero(F.try_divide("tp", "support"))})
    scores = scores.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    means = [F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")]
    both = scores.agg(F.sum("support").alias("n"), F.sum("tp").alias("hit"), F.sum(F.col("support") * F.col("said")).alias("chance"), *means)
    oa, pe = F.try_divide("hit", "n"), F.try_divide(F.col("chance"), F.col("n") * F.col("n"))
    return both.select("n", oa.alias("accuracy"), F.try_divide(oa - pe, 1 - pe).alias("kappa"), "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


def map_statistics(pixels: DataFrame, by: str, confidence: str, entropy: str, resolution: float = 10.0) -> DataFrame:
    """Per class: n_pixels, pct, area_ha, mean confidence in percent, mean entropy."""
    counts = pixels.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("class")).agg(F.count("*").alias("n_pixels"), F.avg(confidence).alias("c"), F.avg(entropy).alias("e"))
    total = counts.agg(F.sum("n_pixels").alias("total"))
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.select("class", "n_pixels", (100 * F.col("n_pixels") / F.col("total")).alias("pct"), (F.col("n_pixels") * resolution * resolution / 10000).alias("area_ha"), (100 * F.col("c")).alias("confidence_pct"), F.col("e").alias("mean_entropy"))


def dominant_label(p: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(p, F.array_max(p)).cast("int"))


def monthly_counts(frame: DataFrame, at: str) -> DataFrame:
    return frame.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def interannual(frame: DataFrame, keys: list[str], year: str, features: list[str], spread: list[str]) -> DataFrame:
    """Means of features over years; sample deviations of `spread`, null with one year."""
    yearly = frame.groupBy(*keys, year).agg(*(F.avg(c).alias(c) for c in features))
    return yearly.groupBy(*keys).agg(F.count("*").alias("n_years"), *(F.avg(c).alias(c) for c in features), *(F.stddev_samp(c).alias(f"{c}_sd_interannual") for c in spread))

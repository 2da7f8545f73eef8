"""Exact quantiles against NumPy, with hot groups and wild spreads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaflow.operators import quantiles
from sylvaflow.operators.quantiles import column_quantiles, group_quantiles

SHARES = [0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0]


@pytest.mark.parametrize("few", [0, 50_000])
def test_columns_of_any_spread(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(1)
    n = 1001
    wide = rng.normal(size=n) * 10.0 ** rng.integers(-40, 40, n)
    columns = {"even": rng.random(n), "few": rng.integers(0, 4, n).astype(float), "wide": wide, "one": np.full(n, 7.5), "huge": np.where(np.arange(n) % 2 == 0, -1.7e308, 1.7e308), "tiny": np.where(np.arange(n) < 10, 5e-324, 0.0)}
    rows = [tuple(float(columns[c][k]) for c in columns) + (None, k if k % 2 else None) for k in range(n)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "none"]) + ", half int")
    got = column_quantiles(frame, [*columns, "none", "half"], SHARES)
    for c, v in columns.items():
        if c == "huge":  # the middle of the least and greatest overflows in NumPy
            assert got[c][0] == -1.7e308 and got[c][-1] == 1.7e308
        else:
            assert np.allclose(got[c], np.quantile(v, SHARES), rtol=1e-12, atol=0)
    assert got["none"] == [None] * len(SHARES)
    assert np.allclose(got["half"], np.quantile(np.arange(1, n, 2), SHARES))


def test_infinite_and_missing_values(spark):
    frame = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert column_quantiles(frame, ["v"], [0.25, 0.5, 0.75])["v"] == [1.0, 2.0, 3.0]
    assert column_quantiles(frame.limit(0), ["v"], [0.5])["v"] == [None]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_groups_that_lie_over_many_tasks(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        hot = spark.range(20_000).select(F.lit("hot").alias("g"), F.lit(1).alias("h"), (F.hash("id") % 9973).cast("double").alias("v"))
        rest = spark.range(3_000).select(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")), F.lit(None).cast("int"), F.col("id") * 0.5)
        odd = spark.createDataFrame([("empty", 1, None), ("nan", 1, float("nan")), ("one", 1, 4.0), (None, 2, 1.0), (None, 2, 2.0)], "g string, h int, v double")
        frame = hot.union(rest).union(odd)
        shares = {f"q{k}": s for k, s in enumerate(SHARES)}
        got = {(r.g, r.h): list(r)[2:] for r in group_quantiles(frame, ["g", "h"], "v", shares).collect()}
        want = {}
        for r in frame.collect():
            want.setdefault((r.g, r.h), []).append(r.v)
        assert got.keys() == want.keys()
        for k, v in want.items():
            v = [x for x in v if x is not None and x == x]
            assert got[k] == [None] * len(SHARES) if not v else np.allclose(got[k], np.quantile(v, SHARES))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rounds_are_few(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 4)
    monkeypatch.setattr(quantiles, "FEW", 0)
    frame = spark.range(300).select((F.hash("id") % 1000).cast("double").alias("v"))
    values = np.array([r.v for r in frame.collect()])
    assert np.allclose(column_quantiles(frame, ["v"], SHARES)["v"], np.quantile(values, SHARES))

"""Whitening against a dense computation in whole numbers."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sylvaflow.llm.queries import op13_whitening
from sylvaflow.llm.whitening import whitened

KIND = "vec_id long, embedding array<double>, label int, component string, n string, x int"


def by_hand(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n = len(x)
    y = n * x - x.sum(0)
    centred = y / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return (y**2).sum(1), centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whole_table_against_dense_algebra(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    deviation, whole, share = by_hand([r.embedding for r in rows], 32)
    got = op13_whitening(spark, SMALL).orderBy("vec_id", "component").toPandas()
    assert len(got) == 32 * len(rows) and got.vec_id[::32].tolist() == [r.vec_id for r in rows]
    assert got.deviation[::32].tolist() == deviation.tolist()
    values = got.whitened.to_numpy(float).reshape(-1, 32)
    assert np.abs(values * np.sign((values * whole).sum(0)) - whole).max() < 1e-8
    assert np.abs(got.explained[:32] - share).max() < 1e-10 and got.identity_error.max() < 1e-9


def test_odd_vectors(spark):
    rows = [(1, None), (2, [1.0, float("nan")]), (3, [1.0, 2.0]), (None, [1.0, 2.5]), (4, [2.0]), (5, [1.0, None]), (6, [3e38, 1.0]), (7, []), (7, [5.0, 1.0]), (8, [float("-inf"), 0.0])]
    frame = spark.createDataFrame([(*r, 1, "a", "b", 3) for r in rows], KIND)
    got = whitened(frame).toPandas()
    used = [[1, 2], [1, 2.5], [2, 0], [0, 0], [5, 1]]
    deviation, _, share = by_hand(used, 2)
    assert len(got) == 10 and set(got.n) == {5} and sorted(got.deviation[::2]) == sorted(deviation.tolist())
    assert got.vec_id.isna().sum() == 2 and np.allclose(sorted(set(got.explained)), sorted(share))
    assert whitened(frame.filter("vec_id = 1")).count() == 0 and whitened(frame.filter("vec_id = 7 and size(embedding) = 0")).count() == 0


def test_components_without_variance_are_null(spark):
    frame = spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitened(frame).groupBy("component").agg(F.count("whitened").alias("n"), F.max("identity_error").alias("e")).orderBy("component").collect()
    assert [r.n for r in got] == [9, 0, 0] and got[0].e < 1e-9


def test_many_rows_keep_sums_exact(spark):
    frame = spark.range(30_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1e15), F.lit(-1e15) - F.col("id"), F.col("id").cast("double")).alias("embedding"))
    row = whitened(frame).filter("vec_id = 17 and component = 1").first()
    n, total = 30_000, sum(64 * i for i in range(30_000))
    want = 0
    for x, s in ((0, 0), (-64 * 17, -total), (64 * 17, total)):
        want += (n * x - s) ** 2
    assert row.deviation == (want if want < 2**63 else None)
    assert pytest.approx(1.0, abs=1e-6) == whitened(frame).filter("component = 1").agg(F.var_pop("whitened")).first()[0]

"""Resampling against a plain loop, projections there and back, and a cache that computes once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaflow.functions.projections import to_lambert93, to_wgs84
from sylvaflow.operators.resampling import Frame, bilinear_at, cropped, extended, mosaic, resample
from sylvaflow.sources.cache import cached, ensured, stored_rows


def bilinear(z, fy, fx):
    r, c = math.floor(fy), math.floor(fx)
    total = weight = 0.0
    for dr in (0, 1):
        for dc in (0, 1):
            w = (fy - r if dr else 1 - fy + r) * (fx - c if dc else 1 - fx + c)
            if 0 <= r + dr < z.shape[0] and 0 <= c + dc < z.shape[1] and not np.isnan(z[r + dr, c + dc]):
                total, weight = total + w * z[r + dr, c + dc], weight + w
    return total / weight if weight > 0 else None


@pytest.fixture(scope="module")
def field(spark):
    z = np.random.default_rng(1).normal(size=(23, 31))
    z[4:8, 10:14] = np.nan
    rows = [(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return z, spark.createDataFrame(rows, "row long, col long, value double")


@pytest.mark.parametrize(("res", "size"), [(3.7, 7), (17.0, 64)])
def test_resampling_is_that_of_a_loop(spark, field, res, size):
    z, grid = field
    at, to = Frame(100.0, 500.0, 10.0, 23, 31), Frame(88.0, 511.0, res, int(260 / res), int(340 / res))
    got = {(r.row, r.col): r.value for r in resample(grid, "value", at, to, size=size).collect()}
    near = {(r.row, r.col): r.value for r in resample(grid, "value", at, to, "near", size).collect()}
    for r in range(to.rows):
        for c in range(to.cols):
            x, y = to.x_min + (c + 0.5) * res, to.y_max - (r + 0.5) * res
            fy, fx = (500.0 - y) / 10, (x - 100.0) / 10
            want = bilinear(z, fy - 0.5, fx - 0.5)
            assert (got.get((r, c)) is None) == (want is None) and (want is None or abs(got[r, c] - want) < 1e-9)
            cell = (math.floor(fy), math.floor(fx))
            held = 0 <= cell[0] < 23 and 0 <= cell[1] < 31 and not np.isnan(z[cell])
            assert near.get((r, c)) == (z[cell] if held else None)


def test_values_at_points(spark, field):
    z, grid = field
    rng = np.random.default_rng(2)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(90, 420, 60), rng.uniform(260, 510, 60)))]
    frame = spark.createDataFrame([*points, (99, points[0][1], points[0][2])], "id int, x double, y double")
    got = {r.id: r.value for r in bilinear_at(frame, grid, Frame(100.0, 500.0, 10.0, 23, 31)).collect()}
    for k, x, y in points:
        want = bilinear(z, (500 - y) / 10 - 0.5, (x - 100) / 10 - 0.5)
        assert got[k] is None if want is None else abs(got[k] - want) < 1e-9
    assert got[99] == got[0]


def test_mosaics_crops_and_extensions(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 5.0)], "row long, col long, value double")
    b = spark.createDataFrame([(0, 0, 3.0), (0, 1, 4.0)], "row long, col long, value double")
    for how, want in (("first", [1.0, 4.0, 5.0]), ("mean", [2.0, 4.0, 5.0]), ("max", [3.0, 4.0, 5.0])):
        assert [r.value for r in mosaic([a, b], "value", how).orderBy("row", "col").collect()] == want
    assert cropped(b, (0, 0), (1, 1)).count() == 1
    assert sorted((r.row, r.col, r.value) for r in extended(b, Frame(0, 0, 1, 2, 2), F.lit(9.0)).collect()) == [(0, 0, 3.0), (0, 1, 4.0), (1, 0, 9.0), (1, 1, 9.0)]


def test_projection_there_and_back(spark):
    rows = [(3.0, 46.5), (-5.1, 48.4), (9.5, 41.3), (2.35, 48.85), (7.7, 48.6), (3.0, 90.0), (None, 45.0)]
    frame = spark.createDataFrame(rows, "lon double, lat double")
    x, y = to_lambert93(F.col("lon"), F.col("lat"))
    there = frame.withColumns({"x": x, "y": y})
    lon, lat = to_wgs84(F.col("x"), F.col("y"))
    got = there.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert abs(got[0].x - 700000) < 1e-6 and abs(got[0].y - 6600000) < 1e-6
    for r in got[:5]:
        assert abs(r.lon2 - r.lon) < 1e-9 and abs(r.lat2 - r.lat) < 1e-9  # under a tenth of a millimetre
    assert got[5].x is None and got[6].x is None
    ax, bx = (spark.createDataFrame([(2.35, v)], "lon double, lat double").select(*to_lambert93(F.col("lon"), F.col("lat"))).first() for v in (49.0, 49.001))
    assert abs(math.dist(ax, bx) - 111.209) < 0.01  # true to scale on the standard parallel: a degree is 111.209 km there


def test_only_missing_keys_are_computed(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def compute(missing):
        seen.append(sorted(r.plot for r in missing.collect()))
        return missing.filter("plot <> 'x_y_z_4'").select("plot", F.length("plot").alias("n"))

    ask = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "plot string, extra int")
    assert ensured(ask("a", "bb", "a", None), path, "plot", compute) == 2 and seen == [["a", "bb"]]
    assert ensured(ask("bb"), path, "plot", compute) == 0 and len(seen) == 1
    got = {(r.plot, r.extra, r.n) for r in cached(ask("bb", "ccc", "x_y_z_4"), path, "plot", compute).collect()}
    assert got == {("bb", 1, 2), ("ccc", 1, 3), ("x_y_z_4", 1, None)} and seen[1:] == [["ccc", "x_y_z_4"]]
    assert cached(ask("x_y_z_4"), path, "plot", compute).count() == 1 and len(seen) == 2
    short = lambda k: F.nullif(F.split_part(k, F.lit("_"), F.lit(4)), F.lit(""))
    found = {r.plot: r.n for r in cached(ask("T_1_S_bb", "ccc", "T_1_S_new"), path, "plot", compute, short).collect()}
    assert found == {"T_1_S_bb": 2, "ccc": 3, "T_1_S_new": 3} and seen[2:] == [["new"]]
    assert stored_rows(spark, path).count() == 5 and stored_rows(spark, str(tmp_path / "none")) is None

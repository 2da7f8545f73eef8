import datetime as dt
import json

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sylvaflow.functions import series
from sylvaflow.operators import evaluation, features, learning, raster, tables
from sylvaflow.sources import readers
from sylvaflow.streaming.thinning import windowed_statistics


def test_spline_is_that_of_a_dense_solve():
    rng = np.random.default_rng(3)
    x = np.sort(rng.choice(100, 9, replace=False)).astype(float)
    y, at = rng.normal(size=9), np.linspace(-5, 110, 60)
    n, h = len(x), np.diff(x)
    a = np.eye(n)
    b = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)

    def value(t):
        if t < x[0]:
            return y[0] + (t - x[0]) * ((y[1] - y[0]) / h[0] - h[0] * m[1] / 6)
        if t > x[-1]:
            return y[-1] + (t - x[-1]) * ((y[-1] - y[-2]) / h[-1] + h[-1] * m[-2] / 6)
        k = min(max(int(np.searchsorted(x, t, "right")) - 1, 0), n - 2)
        p, q = (x[k + 1] - t) / h[k], (t - x[k]) / h[k]
        return p * y[k] + q * y[k + 1] + ((p**3 - p) * m[k] + (q**3 - q) * m[k + 1]) * h[k] ** 2 / 6

    assert np.allclose(features.natural_spline(x, y, at), [value(t) for t in at])
    assert np.allclose(features.natural_spline(np.array([0.0, 1, 2]), np.array([1.0, 3, 5]), np.array([-1.0, 4])), [-1, 9])


def test_phenology_of_short_and_flat_series(spark):
    rows = [(1, [None, 1.0, None], [1.0, 6.0, 11.0]), (2, [0.2, 0.8, 0.2, 0.8], [1.0, 100.0, 200.0, 300.0]), (3, [0.5] * 4, [1.0, 2.0, 3.0, 4.0])]
    got = {r.id: r for r in series.with_phenology(spark.createDataFrame(rows, "id int, v array<double>, t array<double>")).collect()}
    assert got[1].pheno_SOS is None and got[1].pheno_n_peaks is None
    assert got[2].pheno_max_doy == 100 and got[2].pheno_EOS == 200 and got[2].pheno_n_peaks == 1
    assert got[3].pheno_amplitude == 0 and got[3].pheno_SOS == 1.0


def test_thinning_keeps_a_single_scene(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day)] + [(2, day + dt.timedelta(k)) for k in (0, 4, 9, 10, 19, 20)]
    arrays = F.array_sort(F.collect_list(F.struct("date")))
    got = {r.id: [k.date.day for k in r.kept] for r in spark.createDataFrame(rows, "id int, date date").groupBy("id").agg(series.thin(arrays, 10).alias("kept")).collect()}
    assert got == {1: [1], 2: [1, 11, 21]}


def test_split_is_exact(spark):
    frame = spark.range(1000).withColumn("y", F.when(F.col("id") < 900, "a").otherwise("b"))
    got = {(r.y, r.split): r["count"] for r in learning.split_train_test(frame, "y", "id").groupBy("y", "split").count().collect()}
    assert got == {("a", "train"): 630, ("a", "test"): 270, ("b", "train"): 70, ("b", "test"): 30}


def test_evaluation_of_an_absent_class(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "t string, p string")
    row = evaluation.evaluation(pairs, "t", "p").first()
    assert row.accuracy == pytest.approx(2 / 3) and row.kappa == pytest.approx(0) and row.macro_recall == pytest.approx(0.5)


def test_fallback_key_join(spark):
    s = spark.createDataFrame([("x_1.tif", 1.0), ("x_2.tif", 2.0)], "plot_id string, v double")
    t = spark.createDataFrame([("x_1", 7.0)], "plot_id string, dem double")
    assert {r.plot_id: r.dem for r in tables.inject_terrain(s, t).collect()} == {"x_1.tif": 7.0, "x_2.tif": 0.0}


def test_columns_by_name_and_nulls(spark):
    f = spark.createDataFrame([(1, 1.0, None, 2.0), (2, 2.0, None, 2.0)], "plot_id int, NDVI_mean double, B02_mean double, S1_VV_mean double")
    assert tables.select_features(f) == ["NDVI_mean"] and tables.select_features(f, include_radar=True) == ["NDVI_mean", "S1_VV_mean"]
    assert tables.drop_constant(f, ["NDVI_mean", "S1_VV_mean"]) == ["NDVI_mean"]
    assert [r.B02_mean for r in tables.impute_median(f, ["B02_mean"]).collect()] == [0.0, 0.0]


def test_polygon(spark):
    row = spark.range(1).select(*(raster.in_polygon(F.lit(x), F.lit(y), [(0, 0), (4, 0), (0, 4)]) for x, y in ((1.0, 1.0), (3.0, 3.0), (-1.0, 1.0)))).first()
    assert list(row) == [True, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"Larix_kaempferi_3_20718_XA_LM.tif": [["Larix", 0.65], ["Picea", 0.35]]}))
    got = {r.genus: r for r in readers.read_labels(spark, str(tmp_path / "labels.json")).collect()}
    assert got["Larix"].proportion == 0.65 and got["Larix"].species == "Larix_kaempferi"
    shape = {"features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}, {"properties": {"id": "q"}, "geometry": {"type": "Point", "coordinates": [5, 6]}}]}
    (tmp_path / "c.geojson").write_text(json.dumps(shape))
    assert {r.patch_id: (r.x, r.y) for r in readers.read_centroids(spark, str(tmp_path / "c.geojson")).collect()} == {"p": (1.0, 1.0), "q": (5.0, 6.0)}
    (tmp_path / "S2_20210504_B08.tif").write_bytes(b"x")
    row = readers.list_scenes(spark, str(tmp_path)).first()
    assert row.band == "B08" and str(row.date) == "2021-05-04"
    (tmp_path / "a.lst").write_text("x\n y \n\n")
    assert readers.read_split(spark, str(tmp_path / "a.lst"), str(tmp_path / "a.lst")).count() == 4


def test_synthetic_features(spark):
    plots = readers.synthetic(spark, [(1, "Fagus", "deciduous"), (2, "Pinus", "evergreen")], samples=2, year=2021)
    assert plots.count() == 2 * 2 * 73
    rows = features.feature_matrix(plots, ["B02", "B03", "B04", "B05", "B08", "B11", "B12"], year=2021).collect()
    by = {r.plot_id: r for r in rows}
    assert len(rows) == 4 and by["sp01_001"].pheno_amplitude > 0.3 > by["sp02_001"].NDVI_sd


def test_feature_matrix_against_a_plain_form(spark):
    """Own days and gaps of each plot; repeated dates, a null date, a band with too few values, a plot without any."""
    rng, start = np.random.default_rng(8), dt.date(2023, 1, 1)
    rows = []
    for plot in range(12):
        for day in sorted(rng.choice(365, 20 + plot % 3, replace=False).tolist()) if plot % 4 else range(3, 360, 17):
            b = float(rng.normal()) if rng.random() < 0.9 else None
            rows.append((plot, start + dt.timedelta(days=day), b, float(day) if plot != 5 or day < 40 and len(rows) % 2 else None))
    rows += [rows[0], (1, None, 5.0, 5.0), (90, start, None, None), (91, None, None, None)]
    wide = spark.createDataFrame(rows, "plot_id long, date date, X double, Y double")
    got = {r.plot_id: r for r in features.feature_matrix(wide, ["X", "Y"], year=2023, by_date=True).collect()}
    assert got.keys() == {r[0] for r in rows}
    at, weights = np.arange(0, 365, 5.0), series.savgol_weights()
    for plot in got:
        for k, band in ((2, "X"), (3, "Y")):
            by = {}
            for r in rows:
                if r[0] == plot and r[1] is not None and r[k] is not None:
                    by.setdefault((r[1] - start).days, []).append(r[k])
            if len(by) < 3:
                assert got[plot][f"{band}_mean"] is None and got[plot][f"{band}_d001"] is None
                continue
            x = np.array(sorted(by), float)
            v = features.natural_spline(x, np.array([np.mean(by[int(d)]) for d in x]), at)
            left = [min(max(i - 3, 0), 66) for i in range(73)]
            v = np.array([v[s : s + 7] @ weights[i - s] for i, s in enumerate(left)])
            assert np.allclose([got[plot][f"{band}_d{int(d) + 1:03d}"] for d in at], v)
            assert np.isclose(got[plot][f"{band}_mean"], v.mean()) and np.isclose(got[plot][f"{band}_sd"], v.std(ddof=1))
    assert features.feature_matrix(wide.limit(0), ["X", "Y"], year=2023).count() == 0


def test_windows_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    """The stream's own times are without zone; late rows are kept as long as their window is open."""
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    found = windowed_statistics(stream, "ts", ["event_type"], "value")
    run = found.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    key = lambda r: (str(r["start"]), r["event_type"], r["n"], round(r["mean"], 6))
    want = windowed_statistics(batch.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value")
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, want.collect()))

"""Assembly of training sets, and cubes of scenes, in their odd cases."""

import datetime as dt

from sylvaflow.operators.datasets import assembled, dominant_labels, radar_cube, scene_cube


def test_labels_splits_and_terrain(spark):
    labels = spark.createDataFrame([("a", "Pinus", 0.6), ("a", "Quercus", 0.4), ("b", "Quercus", 0.5), ("b", "Fagus", 0.5), ("c", "Cleared", 1.0), ("d", "Unknown", None)], "patch_id string, genus string, proportion double")
    genera = spark.createDataFrame([("Pinus", "Pin", 1), ("Fagus", "Hetre", 2), ("Fagus", "Hetre", 2)], "genus string, species_name string, species_code int")
    got = {r.patch_id: (r.genus, r.species_name, r.species_code) for r in dominant_labels(labels, genera, ("Cleared",)).collect()}
    assert got == {"a": ("Pinus", "Pin", 1), "b": ("Fagus", "Hetre", 2), "d": ("Unknown", "Unknown", 0)}
    series = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", 4.0), ("z", 5.0)], "plot_id string, ndvi double")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "plot_id string")
    terrain = spark.createDataFrame([("a", 120.0)], "plot_id string, dem double")
    rows = assembled(labels, genera, series, terrain, (ids("z"), ids("b")), ("Cleared",)).collect()
    assert sorted((r.plot_id, r.ndvi, r.split, r.dem) for r in rows) == [("a", 1.0, "train", 120.0), ("a", 2.0, "train", 120.0), ("b", 3.0, "test", 0.0)]
    alone = assembled(labels, genera, series).collect()
    assert {r.plot_id for r in alone} == {"a", "b", "c"} and {r.split for r in alone} <= {"train", "test"}
    assert assembled(labels, genera, series.limit(0)).count() == 0


def test_cubes(spark):
    day = lambda m, d, y=2023: dt.date(y, m, d)
    rows = [("p2", day(5, 1), "VV", 0, 0, -9.0), ("p1", day(5, 1), "VV", 0, 0, -8.0), ("p1", day(5, 1), "VH", 0, 0, -15.0), ("p1", day(5, 1), "VH", 0, 1, -14.0), ("p1", day(6, 1), "VV", 0, 0, -7.0), ("p1", day(5, 1, 2022), "VH", 0, 0, 0.0), ("p1", day(6, 1), "XX", 0, 0, 1.0)]
    cells = spark.createDataFrame(rows, "path string, date date, layer string, row long, col long, value double")
    got = sorted((r.row, r.col, r.date.month, r.VV, r.VH, r.VV_VH_ratio) for r in radar_cube(cells, 2023).collect())
    assert got == [(0, 0, 5, -8.0, -15.0, 7.0), (0, 1, 5, None, -14.0, None)]
    assert scene_cube(cells, ("VV", "VH"), 2023, 1).filter("month(date) = 6").first().VV == -7.0
    assert radar_cube(cells.limit(0), 2023).count() == 0

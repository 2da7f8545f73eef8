"""Polygon tables over a grid against points in polygons."""

import random

from sylvaflow.operators import polygons, zones


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]]):
            if (ya > y) != (yb > y) and x >= xa + (y - ya) * (xb - xa) / (yb - ya):
                odd = not odd
    return odd


def shapes(rng, n):
    out = {}
    for k in range(n):
        corner = lambda s: [(rng.uniform(-20, 220), rng.uniform(-20, 220)) for _ in range(s)]
        out[k] = [corner(rng.randint(3, 8)) for _ in range(rng.randint(1, 3))]
    return out


def table(spark, found):
    return spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in found.items()], f"plot long, rings {zones.RINGS}")


def test_cells_of_polygons_with_holes_and_crossings(spark):
    found = shapes(random.Random(2), 12)
    cells = spark.createDataFrame([(r, c, float(r * 7 + c)) for r in range(20) for c in range(20)], "row long, col long, value double")
    plots = table(spark, found)
    want = {k: {(r, c) for r in range(20) for c in range(20) if inside(c * 10 + 5, 195 - r * 10, rings)} for k, rings in found.items()}
    got = {}
    for r in zones.inside_polygons(cells, plots, "plot", 0.0, 200.0, 10.0).collect():
        got.setdefault(r["plot"], []).append((r["row"], r["col"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    means = {r["plot"]: r for r in zones.zonal_statistics(cells, plots, "plot", "value", 0.0, 200.0, 10.0).collect()}
    assert all(means[k].n_cells == len(v) and (not v or abs(means[k]["mean"] - sum(r * 7 + c for r, c in v) / len(v)) < 1e-9) for k, v in want.items())
    every = set().union(*want.values())
    assert {(r.row, r.col) for r in zones.mask_outside(cells, plots, "plot", 0.0, 200.0, 10.0).collect()} == every
    raster = zones.rasterise(cells, plots, "plot", 0.0, 200.0, 10.0).collect()
    assert len(raster) == 400 and {(r.row, r.col) for r in raster if r.mask} == every


def test_no_cell_is_held_against_every_polygon(spark):
    cells, plots = spark.range(9).selectExpr("id AS row", "id AS col", "1.0 AS value"), table(spark, shapes(random.Random(1), 3))
    plan = zones.zonal_statistics(cells, plots, "plot", "value", 0.0, 200.0, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_runs_cut_by_runs(spark):
    runs = spark.createDataFrame([(1, 0, 3, 200), (2, 0, 10, 12), (2, 1, 0, 5)], "plot long, row long, col_from long, col_to long")
    area = spark.createDataFrame([(0, 0, 10, 70), (0, 0, 60, 90), (0, 0, 150, 400), (0, 1, 6, 9)], "plot long, row long, col_from long, col_to long")
    cells = {(r["plot"], r.row, c) for r in zones.clipped(runs, area, "plot").collect() for c in range(r.col_from, r.col_to + 1)}
    assert cells == {(1, 0, c) for c in [*range(10, 91), *range(150, 201)]} | {(2, 0, c) for c in (10, 11, 12)}


def test_patches_come_back_from_their_polygons(spark):
    rng = random.Random(4)
    z = {(r, c): rng.choice([0, 0, 1]) for r in range(17) for c in range(15)}
    grid = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row long, col long, class int")
    found = zones.from_wkb(polygons.polygonise(grid, "class", 30.0, 90.0, 2.0, 6).selectExpr("class", "patch_row * 100 + patch_col AS plot", "wkb"))
    classes = {r["plot"]: r["class"] for r in found.select("plot", "class").collect()}
    back = zones.inside_polygons(grid.select("row", "col"), found, "plot", 30.0, 90.0, 2.0).collect()
    assert len(back) == len(z) and all(classes[r["plot"]] == z[r.row, r.col] for r in back)


def test_odd_polygons(spark):
    rows = [(1, None), (2, []), (3, [[]]), (4, [[{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 10.0}]]), (5, [[{"x": 0.0, "y": 0.0}, {"x": 30.0, "y": 0.0}, {"x": 30.0, "y": 0.0}]])]
    plots = spark.createDataFrame(rows, f"plot long, rings {zones.RINGS}")
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row long, col long, value double")
    assert [(r["plot"], r["mean"], r.n_cells) for r in zones.zonal_statistics(cells, plots, "plot", "value", 0.0, 10.0, 10.0).orderBy("plot").collect()] == [(k, None, 0) for k in range(1, 6)]
    buffered = zones.buffers(spark.createDataFrame([(1, 5.0, 5.0)], "plot long, x double, y double"), 3.0)
    assert [r.n_cells for r in zones.zonal_statistics(cells, buffered, "plot", "value", 0.0, 10.0, 10.0).collect()] == [1]

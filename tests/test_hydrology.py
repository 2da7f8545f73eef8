"""Filling and flow accumulation over tiles against one array."""

import heapq

import numpy as np
import pytest

from sylvaflow.operators.hydrology import FACETS, NEAR, fill_depressions, flow_accumulation, wetness_index


def spread(z):
    """Relax until nothing changes: a cell is no lower than its lowest neighbour, outside cells have no height."""
    w = np.where(np.isnan(z), -np.inf, np.inf)
    w = np.pad(w, 1, constant_values=-np.inf)
    while True:
        low = np.min([w[1 + dr : w.shape[0] - 1 + dr, 1 + dc : w.shape[1] - 1 + dc] for dr, dc in NEAR], 0)
        new = np.where(np.isnan(z), -np.inf, np.minimum(w[1:-1, 1:-1], np.maximum(z, low)))
        if (new == w[1:-1, 1:-1]).all():
            return np.where(np.isnan(z), np.nan, new)
        w[1:-1, 1:-1] = new


def by_cell(w):
    """Flow cell by cell with the facets spelt out."""
    n, m = w.shape
    at = lambda r, c: w[r, c] if 0 <= r < n and 0 <= c < m else np.nan
    cells = [(r, c) for r in range(n) for c in range(m) if not np.isnan(w[r, c])]
    out, steps = {}, {}
    for r, c in cells:
        best = (0.0, None)
        for side, corner in FACETS:
            e0, e1, e2 = w[r, c], at(r + NEAR[side][0], c + NEAR[side][1]), at(r + NEAR[corner][0], c + NEAR[corner][1])
            if np.isnan(e1) and np.isnan(e2):
                continue
            if np.isnan(e2):
                s, to = e0 - e1, [(side, 1.0)]
            elif np.isnan(e1):
                s, to = (e0 - e2) / np.sqrt(2), [(corner, 1.0)]
            else:
                a = np.arctan2(e1 - e2, e0 - e1)
                if a <= 0:
                    s, to = e0 - e1, [(side, 1.0)]
                elif a >= np.pi / 4:
                    s, to = (e0 - e2) / np.sqrt(2), [(corner, 1.0)]
                else:
                    s, to = np.hypot(e0 - e1, e1 - e2), [(side, 1 - a / (np.pi / 4)), (corner, a / (np.pi / 4))]
            if s > best[0] * (1 + 1e-12):
                best = (s, to)
        out[r, c] = [((r + NEAR[k][0], c + NEAR[k][1]), p) for k, p in best[1]] if best[1] else []
        if best[1]:
            steps[r, c] = 0
        elif any(np.isnan(at(r + dr, c + dc)) for dr, dc in NEAR):
            steps[r, c] = 1
    line = [(d, cell) for cell, d in steps.items()]
    heapq.heapify(line)
    while line:
        d, (r, c) = heapq.heappop(line)
        for dr, dc in NEAR:
            near = (r + dr, c + dc)
            if near in out and w[near] == w[r, c] and d + 1 < steps.get(near, np.inf):
                steps[near] = d + 1
                heapq.heappush(line, (d + 1, near))
    for (r, c), d in steps.items():
        if d and not any(np.isnan(at(r + dr, c + dc)) for dr, dc in NEAR):
            out[r, c] = next([((r + dr, c + dc), 1.0)] for dr, dc in NEAR if at(r + dr, c + dc) == w[r, c] and steps[r + dr, c + dc] == d - 1)
    flow = dict.fromkeys(cells, 1.0)
    for cell in sorted(cells, key=lambda k: (-w[k], -steps[k])):
        for to, p in out[cell]:
            flow[to] += p * flow[cell]
    return flow


def terrain(seed, n=37, m=29, whole=True):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, m)).cumsum(0).cumsum(1) + rng.normal(size=(n, m)) * 4
    z = np.round(z) if whole else z
    z[12:17, 5:9] = np.nan
    z[20:27, 10:20] = z[20:27, 10:20].min()  # a flat over several tiles
    return z


def frame_of(spark, z, at=(-8, 5)):
    rows = [(int(r) + at[0], int(c) + at[1], None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "row long, col long, value double")


@pytest.mark.parametrize(("seed", "size"), [(1, 8), (2, 13), (3, 64)])
def test_tiles_give_what_one_array_gives(spark, seed, size):
    z = terrain(seed, whole=seed != 2)
    filled = fill_depressions(frame_of(spark, z), size)
    got = {(r.row + 8, r.col - 5): r.filled for r in filled.collect()}
    want = spread(z)
    assert got == {k: v for k, v in np.ndenumerate(want) if not np.isnan(v)}
    flow = {(r.row + 8, r.col - 5): r.flow for r in flow_accumulation(filled, size).collect()}
    right = by_cell(want)
    assert flow.keys() == right.keys() and max(abs(flow[k] - right[k]) for k in right) < 1e-6


def test_odd_grids(spark):
    empty = spark.createDataFrame([], "row long, col long, value double")
    assert fill_depressions(empty).count() == 0 and flow_accumulation(fill_depressions(empty)).count() == 0
    nothing = spark.createDataFrame([(0, 0, None), (0, 1, float("nan"))], "row long, col long, value double")
    assert fill_depressions(nothing).count() == 0
    twice = spark.createDataFrame([(5, 5, 3.0), (5, 5, 2.0), (5, 6, 1.0)], "row long, col long, value double")
    assert {(r.col, r.filled) for r in fill_depressions(twice, 4).collect()} == {(5, 2.0), (6, 1.0)}
    assert {(r.col, r.flow) for r in flow_accumulation(fill_depressions(twice, 4), 4).collect()} == {(5, 1.0), (6, 2.0)}


def test_wetness_of_a_valley(spark):
    z = np.fromfunction(lambda r, c: abs(c - 10) * 2.0 + (30 - r) * 0.5, (31, 21))
    got = {(r.row, r.col): r for r in wetness_index(frame_of(spark, z, (0, 0)), 10.0, 9).collect()}
    assert got[29, 10].twi > got[5, 10].twi > got[5, 5].twi and got[0, 0].twi is None
    assert max(v.flow for v in got.values()) > 500

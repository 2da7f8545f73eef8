"""Patches and rings against flood fill and scan conversion."""

import struct

import numpy as np
import pytest

from sylvaflow.operators.graphs import components
from sylvaflow.operators.polygons import label_patches, polygonise


def patches_of(z):
    """First cell of each cell's patch by flood fill."""
    out = {}
    for cell, v in np.ndenumerate(z):
        if v < 0 or cell in out:
            continue
        line = [cell]
        out[cell] = cell
        while line:
            r, c = line.pop()
            for near in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)):
                if 0 <= near[0] < z.shape[0] and 0 <= near[1] < z.shape[1] and z[near] == v and near not in out:
                    out[near] = cell
                    line.append(near)
    return out


def read_wkb(raw):
    order, kind, n = struct.unpack_from("<BII", raw)
    at, found = 9, []
    for _ in range(n):
        (m,) = struct.unpack_from("<I", raw, at)
        found.append(np.frombuffer(raw, "<f8", 2 * m, at + 4).reshape(-1, 2))
        at += 4 + 16 * m
    assert (order, kind, at) == (1, 3, len(raw))
    return found


def covered(found, n, m):
    """Cells whose centre is inside by the parity of the rings' sides above it."""
    inside = np.zeros((n, m), bool)
    for ring in found:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if y1 == y2:
                low, high = sorted((x1, x2))
                inside[int(-y1) :, int(low) : int(high)] ^= True
    return inside


def grid_of(spark, z, kind="int", shift=0):
    rows = [(int(r) + shift, int(c) + shift, None if v < 0 else (int(v) if kind == "int" else f"class {v}")) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, f"row long, col long, class {kind}")


@pytest.mark.parametrize(("size", "kind"), [(5, "int"), (11, "string"), (64, "int")])
def test_rings_cover_the_patches(spark, size, kind):
    rng = np.random.default_rng(size)
    z = rng.integers(-1, 3, (26, 23))
    z[2:20, 3:19] = 2
    z[5:9, 5:9] = 0
    z[6, 6] = 2  # an island in a hole
    z[9, 9] = 0  # meets the hole at a corner
    z[12:14, 10:17] = -1
    want = patches_of(z)
    got = {(r.row, r.col): (r.patch_row, r.patch_col) for r in label_patches(grid_of(spark, z, kind), "class", size).collect()}
    assert got == want
    found = polygonise(grid_of(spark, z, kind), "class", size=size).collect()
    assert len(found) == len(set(want.values()))
    for p in found:
        outer, *holes = read_wkb(p.wkb)
        mine = np.zeros(z.shape, bool)
        for cell, head in want.items():
            mine[cell] = head == (p.patch_row, p.patch_col)
        assert (covered([outer, *holes], *z.shape) == mine).all() and p.n_cells == p.area == mine.sum() and p.n_holes == len(holes)
        for ring in (outer, *holes):  # simple: no corner twice
            assert len({tuple(v) for v in ring}) == len(ring) - 1
        padded = np.pad(mine, 1)
        assert p.perimeter == (padded[1:] != padded[:-1]).sum() + (padded[:, 1:] != padded[:, :-1]).sum()


def test_map_units_and_odd_grids(spark):
    z = np.array([[1, 1], [-1, 1]])
    (p,) = polygonise(grid_of(spark, z, shift=-1), "class", 100.0, 500.0, 10.0, 4).collect()
    assert (p["class"], p.n_cells, p.area, p.perimeter) == (1, 3, 300.0, 80.0)
    (outer,) = read_wkb(p.wkb)
    assert outer[0].tolist() == outer[-1].tolist() == [90.0, 510.0] and len(outer) == 7
    empty = spark.createDataFrame([], "row long, col long, class int")
    assert polygonise(empty).count() == 0
    twice = spark.createDataFrame([(0, 0, 2), (0, 0, 1), (0, 1, 1)], "row long, col long, class int")
    assert [(r["class"], r.n_cells) for r in polygonise(twice).collect()] == [(1, 2)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)] + [(300, 7), (300, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in [*range(201), 300]) and all(got[k] == 1000 for k in range(1000, 1400)) and got[5000] == 5000

"""Polygons of a class grid: connected patches of equal class, traced into rings with holes.

Patches are labelled tile by tile and joined over the tiles' borders as components of a graph of labels. A ring is
walked with its patch on the left; where two cells of a patch meet at a corner alone, it turns right, so that
rings touch there instead of crossing. Walks that leave a tile are pieces, which the components of their ends put
together. Only what is one value in the result, a ring or a polygon, is ever gathered.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.operators.graphs import components
from sylvaflow.operators.stages import stored
from sylvaflow.operators.tiling import tile_array, to_tiles

_HALF = 1 << 19
#: Steps east, north, west and south over corners (row, col).
_STEP = ((0, 1), (-1, 0), (0, -1), (1, 0))
#: From a corner, the cell to the left and right of each step.
_LEFT = ((-1, 0), (-1, -1), (0, -1), (0, 0))
_RIGHT = ((0, 0), (-1, 0), (-1, -1), (0, -1))


def _labels(z: np.ndarray) -> np.ndarray:
    """Patches of equal values joined by sides, from 0; NaN is -1. Runs of rows are joined, not cells."""
    n, m = z.shape
    new = np.ones((n, m), bool)
    new[:, 1:] = (z[:, 1:] != z[:, :-1]) | np.isnan(z[:, 1:])
    run = np.cumsum(new.ravel()).reshape(n, m) - 1
    parent = list(range(int(run[-1, -1]) + 1)) if n and m else []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    meets = z[1:] == z[:-1]
    for a, b in np.unique(np.stack([run[:-1][meets], run[1:][meets]], 1), axis=0).tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(len(parent))])
    _, number = np.unique(roots, return_inverse=True)
    return np.where(np.isnan(z), -1, number[run])


def _label_tile(size: int):
    def label(group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        number = _labels(tile_array(group, "code", size, 0))
        r, c = group["row"].to_numpy() - tr * size, group["col"].to_numpy() - tc * size
        node = ((tr + _HALF) << 43) + ((tc + _HALF) << 23) + number[r, c].astype(np.int64)
        return pd.DataFrame({"row": group["row"], "col": group["col"], "code": group["code"], "node": node})

    return label


def label_patches(grid: DataFrame, value: str = "class", size: int = 512) -> DataFrame:
    """grid(row, col, value) with the first cell of each one's patch as (patch_row, patch_col), the least row and
    then column. Cells without a class are left out; of a repeated cell's classes the least counts."""
    cells = grid.filter(F.col(value).isNotNull()).groupBy("row", "col").agg(F.min(value).alias(value))
    # tiles compare classes as numbers that a double holds: a class's own if it is a small integer, else its hash
    own = F.col(value).cast("long") if dict(cells.dtypes)[value] in ("tinyint", "smallint", "int") else F.pmod(F.xxhash64(value), F.lit(2**52))
    coded = stored(cells.withColumn("code", own), "classes")
    tiled = to_tiles(coded, size, 0, "code")
    found = stored(tiled.groupBy("tr", "tc").applyInPandas(_label_tile(size), "row long, col long, code long, node long"), "labels")
    beside = lambda dr, dc, at: found.filter(F.pmod(at, F.lit(size)) == size - 1).select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "code", F.col("node").alias("a"))
    over = beside(1, 0, "row").union(beside(0, 1, "col"))
    links = over.join(found.select("row", "col", "code", F.col("node").alias("b")), ["row", "col", "code"]).select("a", "b").distinct()
    roots = components(links)
    first = found.groupBy("node").agg(F.min(F.struct("row", "col")).alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = first.groupBy("root").agg(F.min("first").alias("head")).select("root", F.col("head.row").alias("patch_row"), F.col("head.col").alias("patch_col"))
    named = first.select("node", "root").join(heads, "root").drop("root")
    return coded.drop("code").join(found.select("row", "col", "node"), ["row", "col"]).join(named, "node").drop("node")


# --- rings --------------------------------------------------------------------------------------


def _key(r: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return ((r + (1 << 29)) << 32) + ((c + (1 << 29)) << 2) + d


def _walks(z: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], int | None, int]]:
    """Walks along the patches of a tile's own cells (inside a margin of 1): the first step as (corner's row, col
    and direction), the corners, the step that would come next in another tile (None: the walk is a ring), the
    patch's number."""
    n, m = z.shape[0] - 2, z.shape[1] - 2
    own = lambda r, c: 1 <= r <= n and 1 <= c <= m
    after, patch = {}, {}
    for d, (dr, dc) in enumerate(_STEP):
        # a step from corner (r, c) has the cell `left` on its left and the cell `right` on its right
        lr, lc = _LEFT[d]
        rr, rc = _RIGHT[d]
        r, c = np.nonzero(~np.isnan(z[1:-1, 1:-1]))
        r, c = r + 1, c + 1
        across_r, across_c = r - lr + rr, c - lc + rc
        edge = z[across_r, across_c] != z[r, c]
        for y, x in zip((r - lr)[edge].tolist(), (c - lc)[edge].tolist()):
            value = z[y + lr, x + lc]
            v, u = y + dr, x + dc
            ahead_right = (v + rr, u + rc)
            ahead_left = (v + lr, u + lc)
            if z[ahead_right] == value:
                turn, cell = (d + 3) % 4, ahead_right
            elif z[ahead_left] == value:
                turn, cell = d, ahead_left
            else:
                turn, cell = (d + 1) % 4, (y + lr, x + lc)
            after[y, x, d] = ((v, u, turn), own(*cell))
            patch[y, x, d] = value
    inner = {step for step, here in after.values() if here}
    left = dict.fromkeys(after)
    for start in [k for k in after if k not in inner] + list(after):
        if start not in left:
            continue
        step, corners = start, []
        while True:
            left.pop(step)
            if not corners or step[2] != corners[-1][2]:
                corners.append(step)
            nxt, here = after[step]
            if not here or nxt == start:
                break
            step = nxt
        yield start, [s[:2] for s in corners], None if here else nxt, patch[start]


_WALK = "patch_row long, patch_col long, start long, next long, corners array<long>"


def _walk_tile(size: int):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        group = group.assign(_n=group.groupby(["patch_row", "patch_col"]).ngroup())
        heads = group.drop_duplicates("_n").set_index("_n")[["patch_row", "patch_col"]].to_dict("index")
        at_r, at_c = tr * size - 1, tc * size - 1
        rows = []
        for start, corners, nxt, number in _walks(tile_array(group, "_n", size, 1)):
            key = lambda s: int(_key(s[0] + at_r, s[1] + at_c, s[2]))
            flat = [v for r, c in corners for v in (r + at_r, c + at_c)]
            head = heads[int(number)]
            rows.append((head["patch_row"], head["patch_col"], key(start), None if nxt is None else key(nxt), flat))
        out = pd.DataFrame(rows, columns=["patch_row", "patch_col", "start", "next", "corners"], dtype=object)
        return out.astype({"patch_row": "int64", "patch_col": "int64", "start": "int64", "next": "Int64"})  # keys need all their bits

    return walk


def _ring_area(corners: np.ndarray) -> float:
    """Signed area of a ring of (row, col) corners, positive with the patch inside."""
    y, x = -corners[:, 0].astype(float), corners[:, 1].astype(float)
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _turns(corners: np.ndarray) -> np.ndarray:
    """The corners at which a ring turns, from the least one on."""
    step = np.roll(corners, -1, 0) - corners
    corners = corners[(step != 0).any(1)]
    ahead, behind = np.sign(np.roll(corners, -1, 0) - corners), np.sign(corners - np.roll(corners, 1, 0))
    corners = corners[(ahead != behind).any(1)]
    return np.roll(corners, -int(np.lexsort((corners[:, 1], corners[:, 0]))[0]), 0)


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a ring in their order."""
    pieces = {s: (n, c) for s, n, c in zip(group["start"], group["next"], group["corners"])}
    first = min(pieces)
    step, corners = first, []
    while True:
        nxt, part = pieces[step]
        corners.extend(part)
        step = int(nxt)
        if step == first:
            break
    return pd.DataFrame({"patch_row": group["patch_row"].iloc[:1], "patch_col": group["patch_col"].iloc[:1], "corners": [corners]})


def rings(patches: DataFrame, size: int = 512) -> DataFrame:
    """(patch_row, patch_col, corners, area) of every ring of patches(row, col, patch_row, patch_col): corners as
    row, col, row, col ... where it turns, from the least on; area is negative for holes."""
    tiled = to_tiles(patches, size, 1, "patch_row", "patch_col")
    pieces = stored(tiled.groupBy("tr", "tc").applyInPandas(_walk_tile(size), _WALK), "walks")
    open_ = pieces.filter("next is not null")
    named = components(open_.select(F.col("start").alias("a"), F.col("next").alias("b")))
    kind = "patch_row long, patch_col long, corners array<long>"
    closed = open_.join(named.withColumnRenamed("node", "start"), "start").groupBy("root").applyInPandas(_joined, kind)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_turns(np.array(c, np.int64).reshape(-1, 2)) for c in batch.column("corners").to_pylist()]
            corners = pa.array([f.ravel().tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), corners, pa.array([_ring_area(f) for f in found], pa.float64())], ["patch_row", "patch_col", "corners", "area"])

    whole = pieces.filter("next is null").select("patch_row", "patch_col", "corners")
    return whole.union(closed).mapInArrow(finished, f"{kind}, area double")


def as_wkb(found: list[list[int]], x_min: float, y_max: float, resolution: float) -> bytes:
    """A polygon of rings, the outer one first, as well-known binary."""
    out = [struct.pack("<BII", 1, 3, len(found))]
    for ring in found:
        corners = np.array(ring, float).reshape(-1, 2)
        corners = np.vstack([corners, corners[:1]])
        points = np.stack([x_min + corners[:, 1] * resolution, y_max - corners[:, 0] * resolution], 1)
        out += [struct.pack("<I", len(points)), points.astype("<f8").tobytes()]
    return b"".join(out)


def polygonise(grid: DataFrame, value: str = "class", x_min: float = 0.0, y_max: float = 0.0, resolution: float = 1.0, size: int = 512) -> DataFrame:
    """(value, patch_row, patch_col, n_cells, n_holes, area, perimeter, wkb) of each patch of equal class.

    Area and perimeter are those of the rings, in map units; the rings cover exactly the patch's cells. Cells
    without a class belong to no patch. An empty grid gives no rows.
    """
    patches = stored(label_patches(grid, value, size), "patches")
    cells = patches.groupBy(value, "patch_row", "patch_col").agg(F.count("*").alias("n_cells"))
    found = rings(patches, size)
    length = F.aggregate(F.sequence(F.lit(0), F.size("corners") - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.abs(F.col("corners")[i] - F.col("corners")[(i + 2) % F.size("corners")]) + F.abs(F.col("corners")[i + 1] - F.col("corners")[(i + 3) % F.size("corners")]))
    ring = F.struct((-F.col("area")).alias("order"), "corners")
    polygon = found.withColumn("length", length).groupBy("patch_row", "patch_col").agg(F.sort_array(F.collect_list(ring)).alias("rings"), F.sum("area").alias("area"), F.sum("length").alias("perimeter"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wkb = [as_wkb([r["corners"] for r in rows], x_min, y_max, resolution) for rows in batch.column("rings").to_pylist()]
            holes = [len(rows) - 1 for rows in batch.column("rings").to_pylist()]
            keep = [batch.column(k) for k in ("patch_row", "patch_col", "area", "perimeter")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(holes, pa.int64()), pa.array(wkb, pa.binary())], ["patch_row", "patch_col", "area", "perimeter", "n_holes", "wkb"])

    shaped = polygon.mapInArrow(written, "patch_row long, patch_col long, area double, perimeter long, n_holes long, wkb binary")
    joined = cells.join(shaped, ["patch_row", "patch_col"])
    return joined.select(value, "patch_row", "patch_col", "n_cells", "n_holes", (F.col("area") * resolution * resolution).alias("area"), (F.col("perimeter") * resolution).alias("perimeter"), "wkb")

"""Depression filling and D-infinity flow accumulation of a height grid, tile by tile.

A tile is flooded from its edge on its own, which leaves basins and the heights at which they spill into each
other. Joined along the tiles' borders, these form a graph that is far smaller than the grid; its minimax heights
to the outside come from rounds in which each basin joins the neighbour that it spills into first, so the number
of rounds grows with the logarithm of the basins. Flow leaves a cell by its steepest triangular facet, split
between two neighbours, and crosses a filled flat towards its nearest outlet. A tile sums its own cells and says
what share of each inflow leaves it where; rounds over these border flows alone then give every tile's inflow.
A tile with its margin is all that one task holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow.functions.indices import topographic_wetness
from sylvaflow.operators.graphs import jumped
from sylvaflow.operators.raster import slope_aspect
from sylvaflow.operators.stages import stored
from sylvaflow.operators.tiling import tile_array, to_tiles

#: Neighbours from the east, against the clock; even ones share a side.
NEAR = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
#: Facets as (side neighbour, corner neighbour).
FACETS = ((0, 1), (2, 1), (2, 3), (4, 3), (4, 5), (6, 5), (6, 7), (0, 7))
#: The node of everything without a height.
OUTSIDE = -1
_HALF = 1 << 19


def _node(tr: Column | int, tc: Column | int, label):
    return ((tr + _HALF) << 43) + ((tc + _HALF) << 23) + label


# --- filling ------------------------------------------------------------------------------------


def flooded(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Flood a tile (with a margin of 1) from its edge and from cells beside missing ones: heights, basins
    from 0, and the least height at which two basins meet, or one meets the outside (-1)."""
    n, m = z.shape[0] - 2, z.shape[1] - 2
    height, basin = np.full((n + 2, m + 2), np.nan), np.full((n + 2, m + 2), -1)
    have = ~np.isnan(z)
    have[[0, -1], :] = have[:, [0, -1]] = False
    open_side = np.zeros_like(have)
    for dr, dc in NEAR:
        open_side[1:-1, 1:-1] |= np.isnan(z[1 + dr : n + 1 + dr, 1 + dc : m + 1 + dc])
    rim = np.zeros_like(have)
    rim[[1, -2], :] = rim[:, [1, -2]] = True
    heap = [(float(z[r, c]), int(r), int(c)) for r, c in np.argwhere(have & (rim | open_side))]
    heapq.heapify(heap)
    seen, meets, count = np.zeros_like(have), {}, 0
    for _, r, c in heap:
        seen[r, c] = True
    while heap:
        level, r, c = heapq.heappop(heap)
        height[r, c] = level
        if basin[r, c] < 0:
            basin[r, c], count = count, count + 1
        own = int(basin[r, c])
        if open_side[r, c]:
            meets[OUTSIDE, own] = min(level, meets.get((OUTSIDE, own), np.inf))
        for dr, dc in NEAR:
            y, x = r + dr, c + dc
            if not have[y, x]:
                continue
            if not seen[y, x]:
                seen[y, x], basin[y, x] = True, own
                heapq.heappush(heap, (max(level, float(z[y, x])), y, x))
            elif basin[y, x] not in (own, -1) and not np.isnan(height[y, x]):
                pair = (min(own, int(basin[y, x])), max(own, int(basin[y, x])))
                meets[pair] = min(max(level, height[y, x]), meets.get(pair, np.inf))
            elif basin[y, x] not in (own, -1):
                pair = (min(own, int(basin[y, x])), max(own, int(basin[y, x])))
                meets[pair] = min(max(level, float(z[y, x])), meets.get(pair, np.inf))
    return height[1:-1, 1:-1], basin[1:-1, 1:-1], meets


def _flood_tile(size: int):
    def flood(group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        height, basin, meets = flooded(tile_array(group, "value", size, 1))
        r, c = np.nonzero(basin >= 0)
        cells = pd.DataFrame({"edge": False, "row": r + tr * size, "col": c + tc * size, "a": _node(tr, tc, basin[r, c].astype(np.int64)), "b": 0, "z": height[r, c]})
        name = lambda k: OUTSIDE if k == OUTSIDE else _node(tr, tc, k)
        spills = pd.DataFrame([(True, 0, 0, name(p), name(q), h) for (p, q), h in meets.items()], columns=cells.columns)
        return pd.concat([cells, spills]) if len(spills) else cells

    return flood


def _minimax(edges: DataFrame) -> DataFrame:
    """(node, level): the least over all ways to the outside of the greatest height on the way.

    In each round every basin takes its lowest edge, ties by the ends' names; it then lies at that edge's height
    or at the level of the basin it is joined to, if that is higher. Joined basins become one.
    """
    edges = stored(edges.groupBy("a", "b").agg(F.min("z").alias("z")), "spills")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "z"))
    nodes = stored(both(edges).filter(F.col("a") != OUTSIDE).select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("at"), F.lit(float("-inf")).alias("level")), "basins")
    while not edges.isEmpty():
        order = F.struct("z", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
        best = both(edges).filter(F.col("a") != OUTSIDE).groupBy("a").agg(F.min(order).alias("m"))
        to = stored(best.select("a", F.when(F.col("m.p") == F.col("a"), F.col("m.q")).otherwise(F.col("m.p")).alias("up"), F.col("m.z").alias("z")), "joins")
        back = to.select(F.col("a").alias("up"), F.col("up").alias("over"))
        pair = (F.col("over") == F.col("a")) & (F.col("a") < F.col("up"))
        top = stored(to.join(back, "up", "left").select("a", F.when(pair, F.col("a")).otherwise(F.col("up")).alias("up"), "z"), "joins")
        top = jumped(top)
        step = top.select(F.col("a").alias("at"), "up", "z")
        nodes = stored(nodes.join(step, "at", "left").select("node", F.coalesce("up", "at").alias("at"), F.greatest("level", "z").alias("level")), "basins")
        end = lambda c: top.select(F.col("a").alias(c), F.col("up").alias(f"{c}2"))
        moved = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"), "z").filter("x <> y")
        edges = stored(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("z").alias("z")), "spills")
    return nodes.select("node", "level")


def fill_depressions(grid: DataFrame, size: int = 512) -> DataFrame:
    """grid(row, col, value) with `filled`: the least height from which a cell drains to the outside.

    Cells without a value, and all that isn't in the table, are the outside; cells with null or NaN values are
    not returned. Of repeated cells the lowest counts. Heights are doubles. Tiles have size x size cells, at
    most 2048 a side.
    """
    cells = grid.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).groupBy("row", "col").agg(F.min(F.col("value").cast("double")).alias("value"))
    cells = stored(cells, "heights")
    tiled = to_tiles(cells, size, 1, "value")
    kind = "edge boolean, row long, col long, a long, b long, z double"
    own = tiled.groupBy("tr", "tc").agg(F.count("*")).limit(1)  # an empty grid has no tiles
    if own.isEmpty():
        return cells.withColumn("filled", F.col("value"))
    found = stored(tiled.groupBy("tr", "tc").applyInPandas(_flood_tile(size), kind), "flooded")
    lies = found.filter("not edge").select("row", "col", F.col("a").alias("node"), "z")
    rim = lies.filter((F.pmod("row", F.lit(size)).isin(0, size - 1)) | (F.pmod("col", F.lit(size)).isin(0, size - 1)))
    beside = F.explode(F.array(*(F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    other = rim.select("node", "z", beside.alias("n")).select(F.col("node").alias("x"), F.col("z").alias("h"), "n.*")
    across = other.join(rim, ["row", "col"]).filter("x <> node").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"), F.greatest("h", "z").alias("z"))
    levels = _minimax(found.filter("edge").select("a", "b", "z").unionByName(across))
    filled = lies.join(levels, "node", "left").select("row", "col", F.greatest("z", "level").alias("filled"))
    return cells.join(filled, ["row", "col"])


# --- directions ---------------------------------------------------------------------------------


def facets(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each inner cell of a tile: its steepest facet (-1: none falls), the share that goes to the facet's
    corner, and whether a neighbour is missing."""
    n, m = z.shape[0] - 2, z.shape[1] - 2
    near = [z[1 + dr : n + 1 + dr, 1 + dc : m + 1 + dc] for dr, dc in NEAR]
    own = z[1:-1, 1:-1]
    best, facet, share = np.zeros_like(own), np.full(own.shape, -1), np.zeros_like(own)
    with np.errstate(invalid="ignore"):
        for k, (side, corner) in enumerate(FACETS):
            e1, e2 = near[side], near[corner]
            s1, s2, direct = own - e1, e1 - e2, (own - e2) / np.sqrt(2.0)
            angle = np.arctan2(s2, s1)
            only_side, only_corner = np.isnan(e2) | (angle <= 0), np.isnan(e1) | (angle >= np.pi / 4)
            slope = np.where(only_side & ~np.isnan(e1), s1, np.where(only_corner, direct, np.sqrt(s1 * s1 + s2 * s2)))
            part = np.where(only_side & ~np.isnan(e1), 0.0, np.where(only_corner, 1.0, angle / (np.pi / 4)))
            steeper = ~np.isnan(slope) & (slope > best)
            best, facet, share = np.where(steeper, slope, best), np.where(steeper, k, facet), np.where(steeper, part, share)
    return facet, share, np.isnan(np.stack(near)).any(0)


def _spread_in_flats(z: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Steps to an outlet over cells of equal height, given those known (NaN: not known, -1: not of a flat)."""
    out = np.where(np.isnan(steps), np.inf, steps)
    known = [(float(out[r, c]), int(r), int(c)) for r, c in np.argwhere(np.isfinite(out) & (steps >= 0))]
    heapq.heapify(known)
    n, m = z.shape
    while known:
        d, r, c = heapq.heappop(known)
        if d > out[r, c]:
            continue
        for dr, dc in NEAR:
            y, x = r + dr, c + dc
            if 0 <= y < n and 0 <= x < m and z[y, x] == z[r, c] and out[y, x] > d + 1:
                out[y, x] = d + 1
                heapq.heappush(known, (d + 1, y, x))
    return out


def _flat_cells(size: int):
    """Cells of a tile that no facet leaves, and the ones of equal height beside them in the next tiles, with
    the steps to an outlet known within the tile."""

    def flats(group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        z = tile_array(group, "filled", size, 2)
        facet, _, edge = facets(z)  # of the tile and one cell around it
        inner = z[1:-1, 1:-1]
        level = ~np.isnan(inner) & (facet < 0)
        steps = np.where(level, np.where(edge, 1.0, np.nan), np.where(np.isnan(inner), -1.0, 0.0))
        steps = _spread_in_flats(inner, steps)
        own = np.zeros_like(level)
        own[1:-1, 1:-1] = True
        r, c = np.nonzero(level & own)
        return pd.DataFrame({"row": r - 1 + tr * size, "col": c - 1 + tc * size, "filled": inner[r, c], "steps": steps[r, c]})

    return flats


def _flat_round(size: int):
    def relax(group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        z, steps = tile_array(group, "filled", size, 1), tile_array(group, "steps", size, 1)
        new = _spread_in_flats(z, np.where(np.isinf(steps), np.nan, steps))
        r, c = np.nonzero(~np.isnan(z[1:-1, 1:-1]))
        before, after = steps[1:-1, 1:-1][r, c], new[1:-1, 1:-1][r, c]
        return pd.DataFrame({"row": r + tr * size, "col": c + tc * size, "filled": z[1:-1, 1:-1][r, c], "steps": after, "fell": after < before})

    return relax


def _flats(filled: DataFrame, size: int) -> DataFrame:
    """(row, col, steps) of each cell that no facet leaves: steps over its flat to the nearest outlet. Rounds
    pass steps over tile borders until none falls; only cells of flats take part."""
    kind = "row long, col long, filled double, steps double"
    now = stored(to_tiles(filled, size, 2, "filled").groupBy("tr", "tc").applyInPandas(_flat_cells(size), kind), "flats")
    while True:
        tiled = to_tiles(now, size, 1, "filled", "steps").groupBy("tr", "tc")
        moved = stored(tiled.applyInPandas(_flat_round(size), f"{kind}, fell boolean"), "flats")
        now = moved.drop("fell")
        if moved.filter("fell").isEmpty():
            return now.select("row", "col", "steps")


def _receivers(z: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each inner cell its two receiving neighbours (-1: none) and the first one's share."""
    facet, share, edge = facets(z)
    n, m = facet.shape
    sides, corners = np.array([f[0] for f in FACETS]), np.array([f[1] for f in FACETS])
    first, second, part = np.where(facet >= 0, sides[facet], -1), np.where(facet >= 0, corners[facet], -1), 1 - share
    own_z, own = z[1:-1, 1:-1], np.nan_to_num(steps[1:-1, 1:-1], nan=0.0)
    level = (facet < 0) & ~edge & ~np.isnan(own_z)
    for k in reversed(range(8)):
        dr, dc = NEAR[k]
        there, left = z[1 + dr : n + 1 + dr, 1 + dc : m + 1 + dc], np.nan_to_num(steps[1 + dr : n + 1 + dr, 1 + dc : m + 1 + dc], nan=0.0)
        first = np.where(level & (there == own_z) & (left == own - 1), k, first)
    part = np.where(facet < 0, 1.0, part)
    first = np.where(part == 0, second, first)
    second = np.where((part == 0) | (part == 1), -1, second)
    return first, second, np.where(part == 0, 1.0, part)


_FLOW = "kind int, row long, col long, to_row long, to_col long, first int, second int, part double, rank double, steps double"


def _flow_tile(size: int):
    """What a tile does with its flow: 0 cells with their receivers, 1 what its own cells send over its border,
    2 what share of an inflow into one of its cells goes over the border where."""

    def flow(group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        z, steps = tile_array(group, "filled", size, 2), tile_array(group, "steps", size, 2)
        first, second, part = _receivers(z, steps)
        n = size + 2  # the tile and one cell around it
        own = np.zeros((n, n), bool)
        own[1:-1, 1:-1] = ~np.isnan(z[2:-2, 2:-2])
        targets = _targets(first, second, part)
        order = _downhill(z[1:-1, 1:-1], steps[1:-1, 1:-1], own)
        amount, sent = own.astype(float), {}
        for r, c in order:
            for y, x, w in targets(r, c):
                if own[y, x]:
                    amount[y, x] += w * amount[r, c]
                else:
                    sent[y, x] = sent.get((y, x), 0.0) + w * amount[r, c]
        at_r, at_c = tr * size - 1, tc * size - 1
        rows = [(1, 0, 0, y + at_r, x + at_c, 0, 0, v, 0.0, 0.0) for (y, x), v in sent.items()]
        rank = {cell: k for k, cell in enumerate(order)}
        ring = [(r, c) for r, c in np.argwhere(~np.isnan(z[1:-1, 1:-1]) & ~own).tolist()]
        entries = {(y, x) for r, c in ring for y, x, _ in targets(r, c) if 0 <= y < n and 0 <= x < n and own[y, x]}
        for entry in sorted(entries):
            for (y, x), w in _carried_on(entry, targets, own, rank).items():
                rows.append((2, entry[0] + at_r, entry[1] + at_c, y + at_r, x + at_c, 0, 0, w, 0.0, 0.0))
        r, c = np.nonzero(own)
        cells = pd.DataFrame({"kind": 0, "row": r + at_r, "col": c + at_c, "to_row": 0, "to_col": 0, "first": first[r, c], "second": second[r, c], "part": part[r, c], "rank": z[1:-1, 1:-1][r, c], "steps": np.nan_to_num(steps[1:-1, 1:-1][r, c], nan=0.0)})
        return pd.concat([cells, pd.DataFrame(rows, columns=cells.columns)]) if rows else cells

    return flow


def _targets(first: np.ndarray, second: np.ndarray, part: np.ndarray):
    def targets(r: int, c: int) -> Iterator[tuple[int, int, float]]:
        k, w = first[r, c], part[r, c]
        if k >= 0:
            yield r + NEAR[k][0], c + NEAR[k][1], w
            k = second[r, c]
            if k >= 0:
                yield r + NEAR[k][0], c + NEAR[k][1], 1 - w

    return targets


def _downhill(z: np.ndarray, steps: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Own cells so that each comes before those that it flows to."""
    r, c = np.nonzero(own)
    order = np.lexsort((-np.nan_to_num(steps[r, c], nan=0.0), -z[r, c]))
    return list(zip(r[order].tolist(), c[order].tolist()))


def _carried_on(entry: tuple[int, int], targets, own: np.ndarray, rank: dict) -> dict[tuple[int, int], float]:
    """Shares of a unit that enters a cell, by the cells over the border that they reach."""
    amount, out, heap = {entry: 1.0}, {}, [(rank[entry], entry)]
    while heap:
        _, cell = heapq.heappop(heap)
        given = amount.pop(cell)
        for y, x, w in targets(*cell):
            if not own[y, x]:
                out[y, x] = out.get((y, x), 0.0) + w * given
            elif (y, x) in amount:
                amount[y, x] += w * given
            else:
                amount[y, x] = w * given
                heapq.heappush(heap, (rank[y, x], (y, x)))
    return out


def _sum_tile(size: int):
    """Cells of a tile with what flows through them, given the inflow over its border."""

    def total(group: pd.DataFrame) -> pd.DataFrame:
        cells, inflow = group[group["kind"] == 0], group[group["kind"] == 1]
        tr, tc = int(group["tr"].iat[0]), int(group["tc"].iat[0])
        amount, get = np.zeros((size + 2, size + 2)), {}
        r, c = cells["row"].to_numpy() - tr * size + 1, cells["col"].to_numpy() - tc * size + 1
        amount[r, c] = 1.0
        np.add.at(amount, (inflow["row"].to_numpy() - tr * size + 1, inflow["col"].to_numpy() - tc * size + 1), inflow["part"].to_numpy())
        for name, missing in (("first", -1), ("second", -1), ("part", 1.0), ("rank", np.nan), ("steps", 0.0)):
            get[name] = np.full(amount.shape, missing)
            get[name][r, c] = cells[name].to_numpy()
        own = np.zeros(amount.shape, bool)
        own[r, c] = True
        targets = _targets(get["first"].astype(int), get["second"].astype(int), get["part"])
        for y, x in _downhill(get["rank"], get["steps"], own):
            for v, u, w in targets(y, x):
                if own[v, u]:
                    amount[v, u] += w * amount[y, x]
        return pd.DataFrame({"row": cells["row"].to_numpy(), "col": cells["col"].to_numpy(), "flow": amount[r, c]})

    return total


def flow_accumulation(filled: DataFrame, size: int = 512) -> DataFrame:
    """(row, col, flow) of filled(row, col, filled): the number of cells that drain through each, itself
    included, shares counting as shares. Cells without an outlet downhill drain to the outside."""
    cells = stored(filled.select("row", "col", "filled"), "filled")
    flow_in = cells.join(_flats(cells, size), ["row", "col"], "left")
    found = stored(to_tiles(flow_in, size, 2, "filled", "steps").groupBy("tr", "tc").applyInPandas(_flow_tile(size), _FLOW), "flow")
    links = stored(found.filter("kind = 2").select("row", "col", "to_row", "to_col", "part"), "links")
    to = [F.col("to_row").alias("row"), F.col("to_col").alias("col")]
    new = stored(found.filter("kind = 1").groupBy(*to).agg(F.sum("part").alias("amount")), "inflow")
    inflow = new
    while not new.isEmpty():  # each round carries what entered a tile to the next ones
        new = stored(new.join(links, ["row", "col"]).groupBy(*to).agg(F.sum(F.col("amount") * F.col("part")).alias("amount")), "inflow")
        inflow = inflow.unionByName(new)
    tile = lambda c: F.floor(F.col(c) / size)
    entering = inflow.groupBy("row", "col").agg(F.sum("amount").alias("part")).select(F.lit(1).alias("kind"), "row", "col", F.lit(-1).alias("first"), F.lit(-1).alias("second"), "part", F.lit(0.0).alias("rank"), F.lit(0.0).alias("steps"))
    both = found.filter("kind = 0").select("kind", "row", "col", "first", "second", "part", "rank", "steps").unionByName(entering)
    return both.withColumns({"tr": tile("row"), "tc": tile("col")}).groupBy("tr", "tc").applyInPandas(_sum_tile(size), "row long, col long, flow double")


def wetness_index(grid: DataFrame, resolution: float = 10.0, size: int = 512, most: float = 20.0) -> DataFrame:
    """grid(row, col, value) with the topographic wetness index: the logarithm of the catchment per width over
    the tangent of the slope, at most `most`; null where the slope is, at the grid's edge."""
    flow = flow_accumulation(fill_depressions(grid, size), size)
    slope = slope_aspect(grid, "value", resolution).select("row", "col", "slope")
    met = flow.join(slope, ["row", "col"])
    twi = topographic_wetness(F.col("flow") * resolution, F.tan(F.radians("slope")), most)
    return met.select("row", "col", "flow", "slope", F.when(F.col("slope").isNotNull(), twi).alias("twi"))

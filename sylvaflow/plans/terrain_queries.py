"""Queries of water over the grid: filled depressions, flow accumulation and wetness, by tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow.operators import hydrology
from sylvaflow.plans.queries import GRID, grid, query, r6

#: Cells a side of a tile: small enough that the grid of 64 x 64 has several.
SIZE = 24

#: Relaxation in DuckDB: the heights of changed cells are offered to their neighbours until none falls.
FILLED = f"""g AS ({GRID}), k AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([0, -1, -1, -1, 0, 1, 1, 1]) AS dr, unnest([1, 1, 0, -1, -1, -1, 0, 1]) AS dc),
nb AS (SELECT g.row, g.col, k.k, n.row AS nr, n.col AS nc, n.value AS nv FROM g CROSS JOIN k JOIN g n ON n.row = g.row + dr AND n.col = g.col + dc),
rim AS (SELECT g.row, g.col, g.value FROM g LEFT JOIN nb USING (row, col) GROUP BY ALL HAVING count(nb.k) < 8),
f(row, col, w) USING KEY (row, col) AS (
    SELECT row, col, value FROM rim
    UNION SELECT nb.nr, nb.nc, min(greatest(nb.nv, f.w)) AS w FROM f JOIN nb ON nb.row = f.row AND nb.col = f.col LEFT JOIN recurring.f AS o ON o.row = nb.nr AND o.col = nb.nc
    GROUP BY nb.nr, nb.nc, o.w HAVING o.w IS NULL OR min(greatest(nb.nv, f.w)) < o.w)"""

#: Facets, steps over flats, receivers and amounts that move a cell at a time.
FLOW = f"""{FILLED}, w AS (SELECT f.row, f.col, f.w, rim.row IS NOT NULL AS edge FROM f LEFT JOIN rim USING (row, col)),
near AS (SELECT nb.row, nb.col, nb.k, w.w AS v FROM nb JOIN w ON w.row = nb.nr AND w.col = nb.nc),
pairs AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS facet, unnest([0, 2, 2, 4, 4, 6, 6, 0]) AS side, unnest([1, 1, 3, 3, 5, 5, 7, 7]) AS corner),
sides AS (SELECT w.row, w.col, w.w AS e0, facet, side, corner, a.v AS e1, b.v AS e2 FROM w CROSS JOIN pairs LEFT JOIN near a ON a.row = w.row AND a.col = w.col AND a.k = side LEFT JOIN near b ON b.row = w.row AND b.col = w.col AND b.k = corner),
slopes AS (SELECT *, CASE WHEN e1 IS NULL THEN pi() WHEN e2 IS NULL THEN 0 ELSE atan2(e1 - e2, e0 - e1) END AS angle FROM sides WHERE e1 IS NOT NULL OR e2 IS NOT NULL),
steep AS (SELECT *, CASE WHEN angle <= 0 THEN e0 - e1 WHEN angle >= pi() / 4 THEN (e0 - e2) / sqrt(2) ELSE sqrt((e0 - e1) * (e0 - e1) + (e1 - e2) * (e1 - e2)) END AS s, least(1, greatest(0, angle / (pi() / 4))) AS share FROM slopes),
best AS (SELECT row, col, side, corner, share FROM steep WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY s DESC, facet) = 1),
flat AS (SELECT w.row, w.col, w.w, w.edge FROM w LEFT JOIN best USING (row, col) WHERE best.side IS NULL),
d(row, col, d) USING KEY (row, col) AS (
    SELECT row, col, 0 FROM best UNION ALL SELECT row, col, 1 FROM flat WHERE edge
    UNION SELECT flat.row, flat.col, min(d.d + 1) AS d FROM d JOIN w ON w.row = d.row AND w.col = d.col JOIN nb ON nb.nr = d.row AND nb.nc = d.col JOIN flat ON flat.row = nb.row AND flat.col = nb.col AND flat.w = w.w
    LEFT JOIN recurring.d AS o ON o.row = flat.row AND o.col = flat.col GROUP BY flat.row, flat.col, o.d HAVING o.d IS NULL OR min(d.d + 1) < o.d),
moves AS (
    SELECT row, col, side AS k, 1 - share AS p FROM best WHERE share < 1 UNION ALL SELECT row, col, corner, share FROM best WHERE share > 0
    UNION ALL SELECT flat.row, flat.col, min(nb.k), 1 FROM flat JOIN d ON d.row = flat.row AND d.col = flat.col JOIN nb ON nb.row = flat.row AND nb.col = flat.col JOIN w ON w.row = nb.nr AND w.col = nb.nc AND w.w = flat.w JOIN d n ON n.row = nb.nr AND n.col = nb.nc AND n.d = d.d - 1 WHERE NOT flat.edge GROUP BY flat.row, flat.col),
went AS (SELECT moves.row, moves.col, nb.nr, nb.nc, p FROM moves JOIN nb ON nb.row = moves.row AND nb.col = moves.col AND nb.k = moves.k),
m(step, row, col, amount) AS (SELECT 0, row, col, 1::DOUBLE FROM w UNION ALL SELECT step + 1, nr, nc, sum(amount * p) FROM m JOIN went ON went.row = m.row AND went.col = m.col GROUP BY step, nr, nc),
flow AS (SELECT row, col, sum(amount) AS flow FROM m GROUP BY row, col)"""

#: Horn's slope as rise over 80 m where all eight neighbours are there.
RISE = """h AS (SELECT nb.row, nb.col, sum(CASE WHEN k IN (0, 1, 7) THEN 1 WHEN k IN (3, 4, 5) THEN -1 ELSE 0 END * CASE WHEN k IN (0, 4) THEN 2 ELSE 1 END * nv) AS dx, sum(CASE WHEN k IN (5, 6, 7) THEN 1 WHEN k IN (1, 2, 3) THEN -1 ELSE 0 END * CASE WHEN k IN (2, 6) THEN 2 ELSE 1 END * nv) AS dy FROM nb GROUP BY ALL HAVING count(*) = 8)"""


@query(f"WITH RECURSIVE {FILLED} SELECT g.row, g.col, round(w - value, 6) AS depth FROM g JOIN f USING (row, col)")
def filled_depressions(spark, sf_dir):
    found = hydrology.fill_depressions(grid(spark, sf_dir), SIZE)
    return r6(found.select("row", "col", (F.col("filled") - F.col("value")).alias("depth")))


@query(f"WITH RECURSIVE {FLOW} SELECT row, col, round(flow, 6) AS flow FROM flow")
def flow_accumulation(spark, sf_dir):
    filled = hydrology.fill_depressions(grid(spark, sf_dir), SIZE)
    return r6(hydrology.flow_accumulation(filled, SIZE))


@query(f"WITH RECURSIVE {FLOW}, {RISE} SELECT row, col, round(CASE WHEN dx IS NOT NULL THEN least(20, ln(greatest(flow * 10, 1) / greatest(sqrt(dx * dx + dy * dy) / 80, 0.001))) END, 6) AS twi FROM flow LEFT JOIN h USING (row, col)")
def wetness_index(spark, sf_dir):
    return r6(hydrology.wetness_index(grid(spark, sf_dir), 10.0, SIZE).select("row", "col", "twi"))

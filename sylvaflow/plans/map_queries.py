"""Queries of maps: patches and polygons of classes, polygon tables over the grid, and stretched layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow.functions.projections import to_lambert93, to_wgs84
from sylvaflow.operators import datasets, polygons, raster, resampling, zones
from sylvaflow.operators.stages import shared_path
from sylvaflow.plans.queries import GRID, grid, load, query, r6, vectors
from sylvaflow.plans.terrain_queries import SIZE
from sylvaflow.sources.arrays import read_npy, write_npy
from sylvaflow.sources.cache import cached
from sylvaflow.sources.rasters import read_raster, write_raster
from sylvaflow.sources.readers import read_labels, read_series, read_split, write_report

CLASSES = f"SELECT row, col, round(value / 4)::INT AS class FROM ({GRID})"

#: Labelling in DuckDB: the least cell of a patch is passed on by sides until no label falls.
PATCHES = f"""c AS ({CLASSES}), nb AS (SELECT a.row, a.col, b.row AS nr, b.col AS nc, b.class FROM c a JOIN (SELECT unnest([0, 0, 1, -1]) AS dr, unnest([1, -1, 0, 0]) AS dc) ON true JOIN c b ON b.row = a.row + dr AND b.col = a.col + dc AND b.class = a.class),
lab(row, col, head) USING KEY (row, col) AS (
    SELECT row, col, row * 1000 + col FROM c
    UNION SELECT nb.nr, nb.nc, min(lab.head) AS head FROM lab JOIN nb ON nb.row = lab.row AND nb.col = lab.col JOIN recurring.lab AS o ON o.row = nb.nr AND o.col = nb.nc GROUP BY nb.nr, nb.nc, o.head HAVING min(lab.head) < o.head)"""


def classes(spark, sf_dir):
    return grid(spark, sf_dir).select("row", "col", F.round(F.col("value") / 4).cast("int").alias("class"))


@query(f"WITH RECURSIVE {PATCHES} SELECT row, col, c.class, head // 1000 AS patch_row, head % 1000 AS patch_col FROM lab JOIN c USING (row, col)")
def class_patches(spark, sf_dir):
    return polygons.label_patches(classes(spark, sf_dir), "class", SIZE)


@query(f"""WITH RECURSIVE {PATCHES}, p AS (SELECT head, row, col, class FROM lab JOIN c USING (row, col)),
corner AS (SELECT head, row + dr AS r, col + dc AS q, count(*) AS n, sum(1 << (dr * 2 + dc)) AS mask FROM p JOIN (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc) ON true GROUP BY ALL),
turns AS (SELECT head, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND mask IN (6, 9) THEN -2 ELSE 0 END) AS t FROM corner GROUP BY 1),
sides AS (SELECT p.head, count(*) AS same FROM p JOIN nb ON nb.row = p.row AND nb.col = p.col GROUP BY 1)
SELECT class, head // 1000 AS patch_row, head % 1000 AS patch_col, count(*) AS n_cells, CAST(1 - any_value(t) / 4 AS BIGINT) AS n_holes, count(*) * 100.0::DOUBLE AS area, (4 * count(*) - coalesce(any_value(same), 0)) * 10.0::DOUBLE AS perimeter
FROM p JOIN turns USING (head) LEFT JOIN sides USING (head) GROUP BY ALL""")
def class_polygons(spark, sf_dir):
    """Area, perimeter and holes as the traced rings have them; SQL counts cells, sides and corners."""
    return polygons.polygonise(classes(spark, sf_dir), "class", 0.0, 640.0, 10.0, SIZE).drop("wkb")


#: An outer ring around each supplier's place and a hole in it, as sides; no corner meets a cell's centre.
PLOTS = """s AS (SELECT s_suppkey AS plot_id, (s_suppkey % 63) * 10.0::DOUBLE + 3.3 AS x, (s_suppkey % 50) * 10.0::DOUBLE + 4.1 AS y, 20 + s_suppkey % 40 AS r FROM supplier),
side AS (SELECT plot_id, x + r * xa AS xa, y + r * ya AS ya, x + r * xb AS xb, y + r * yb AS yb FROM s JOIN (SELECT unnest([1, 0.3, -1, -0.6, 0.2, 0.25, -0.1, -0.35]) AS xa, unnest([0.1, 1, 0.4, -1, -0.3, 0.3, 0.45, -0.2]) AS ya, unnest([0.3, -1, -0.6, 1, 0.25, -0.1, -0.35, 0.2]) AS xb, unnest([1, 0.4, -1, 0.1, 0.3, 0.45, -0.2, -0.3]) AS yb) ON true),
cell AS (SELECT row, col, value, col * 10.0::DOUBLE + 5 AS cx, 640.0::DOUBLE - row * 10 - 5 AS cy FROM g),
crossed AS (SELECT plot_id, row, col, value FROM side JOIN cell ON (ya > cy) <> (yb > cy) AND cx >= xa + (cy - ya) * (xb - xa) / (yb - ya) GROUP BY ALL HAVING count(*) % 2 = 1)"""


def plots(spark, sf_dir):
    """The same polygons as a table of rings."""
    corner = lambda u, v: F.struct((F.col("x") + F.col("r") * u).alias("x"), (F.col("y") + F.col("r") * v).alias("y"))
    outer = F.array(*(corner(u, v) for u, v in ((1.0, 0.1), (0.3, 1.0), (-1.0, 0.4), (-0.6, -1.0))))
    hole = F.array(*(corner(u, v) for u, v in ((0.2, -0.3), (0.25, 0.3), (-0.1, 0.45), (-0.35, -0.2))))
    key = F.col("s_suppkey")
    s = load(spark, sf_dir, "supplier").select(key.alias("plot_id"), ((key % 63) * 10.0 + 3.3).alias("x"), ((key % 50) * 10.0 + 4.1).alias("y"), (20 + key % 40).alias("r"))
    return s.select("plot_id", F.array(outer, hole).alias("rings"))


@query(f"WITH g AS ({GRID}), {PLOTS} SELECT s.plot_id, round(avg(value), 6) AS mean, count(value) AS n_cells FROM s LEFT JOIN crossed USING (plot_id) GROUP BY 1")
def polygon_zones(spark, sf_dir):
    return r6(zones.zonal_statistics(grid(spark, sf_dir), plots(spark, sf_dir), "plot_id", "value", 0.0, 640.0, 10.0))


@query(f"WITH g AS ({GRID}), {PLOTS}, held AS (SELECT DISTINCT row, col, 1 AS mask FROM crossed WHERE plot_id % 4 = 1) SELECT row, col, coalesce(mask, 0)::INT AS mask FROM g LEFT JOIN held USING (row, col)")
def rasterised_polygons(spark, sf_dir):
    return zones.rasterise(grid(spark, sf_dir).select("row", "col"), plots(spark, sf_dir).filter("plot_id % 4 = 1"), "plot_id", 0.0, 640.0, 10.0)


@query(f"WITH g AS ({GRID}), {PLOTS} SELECT a.plot_id, count(DISTINCT a.row * 1000 + a.col) AS n_cells FROM (SELECT plot_id, row, col FROM crossed WHERE plot_id % 2 = 0) a JOIN (SELECT DISTINCT row, col FROM crossed WHERE plot_id % 2 = 1) b USING (row, col) GROUP BY 1")
def clipped_polygons(spark, sf_dir):
    """Cells of every second polygon within the area of the others: runs cut by runs. The grid's extent is part of
    the area, as the clip is."""
    runs = zones.cover(plots(spark, sf_dir), "plot_id", 0.0, 640.0, 10.0)
    cells = grid(spark, sf_dir).select("row", F.col("col").alias("col_from"), F.col("col").alias("col_to"), F.lit(0).alias("plot_id"))
    area = zones.clipped(cells, runs.filter("plot_id % 2 = 1"), "plot_id")
    cut = zones.clipped(runs.filter("plot_id % 2 = 0"), area, "plot_id")
    return cut.groupBy("plot_id").agg(F.sum(F.col("col_to") - F.col("col_from") + 1).alias("n_cells"))


@query(f"WITH g AS ({GRID}), p AS (SELECT s_suppkey AS plot_id, (s_suppkey % 63) * 10.0::DOUBLE + 3 AS px, (s_suppkey % 50) * 10.0::DOUBLE + 4 AS py FROM supplier), side AS (SELECT plot_id, px + 15 * cos(i * pi() / 60) AS xa, py + 15 * sin(i * pi() / 60) AS ya, px + 15 * cos(((i + 1) % 120) * pi() / 60) AS xb, py + 15 * sin(((i + 1) % 120) * pi() / 60) AS yb FROM p CROSS JOIN range(120) t(i)), cell AS (SELECT value, col * 10.0::DOUBLE + 5 AS cx, 640.0::DOUBLE - row * 10 - 5 AS cy, row, col FROM g), held AS (SELECT plot_id, row, col, value FROM side JOIN cell ON abs(cy - ya) < 40 AND (ya > cy) <> (yb > cy) AND cx >= xa + (cy - ya) * (xb - xa) / (yb - ya) GROUP BY ALL HAVING count(*) % 2 = 1) SELECT plot_id, round(avg(value), 6) AS mean, count(value) AS n_cells FROM p LEFT JOIN held USING (plot_id) GROUP BY 1")
def buffer_means(spark, sf_dir):
    p = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plot_id"), ((F.col("s_suppkey") % 63) * 10.0 + 3).alias("x"), ((F.col("s_suppkey") % 50) * 10.0 + 4).alias("y"))
    return r6(zones.zonal_statistics(grid(spark, sf_dir), zones.buffers(p, 15.0), "plot_id", "value", 0.0, 640.0, 10.0))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b, quantile_cont(l_tax, 0.02) AS c, quantile_cont(l_tax, 0.98) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, (l_extendedprice - a) / (b - a))), 6) AS l_extendedprice, round(least(1, greatest(0, (l_tax - c) / (d - c))), 6) AS l_tax FROM lineitem CROSS JOIN q""")
def stretched_layers(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    return r6(raster.stretch(x, ["l_extendedprice", "l_tax"]))


# --- files ----------------------------------------------------------------------------------------------


@query(f"SELECT row, col, col * 10.0::DOUBLE + 5 AS x, 635.0::DOUBLE - row * 10 AS y, value, floor(value)::DOUBLE AS whole FROM ({GRID}) WHERE row BETWEEN 17 AND 40 AND col >= 30")
def raster_window(spark, sf_dir):
    """The grid written as tiled raster files, and a window read back by tiles."""
    path = shared_path(spark, "raster")
    g = grid(spark, sf_dir).withColumn("whole", F.floor("value"))
    write_raster(g, path, ["value", "whole"], 0.0, 640.0, 10.0, 16)
    window = read_raster(spark, path).filter("y <= 465 AND y >= 235 AND x >= 305")
    return window.select(F.round((635 - F.col("y")) / 10).cast("long").alias("row"), F.round((F.col("x") - 5) / 10).cast("long").alias("col"), "x", "y", F.col("band_1").alias("value"), F.col("band_2").alias("whole"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squares FROM embeddings")
def array_rows(spark, sf_dir):
    """The embeddings written as .npy files of row ranges, and read back. Their ids number them from 0."""
    path = shared_path(spark, "array")
    write_npy(vectors(spark, sf_dir).select(F.col("vec_id").alias("row"), F.col("v").alias("values")), path, "float32", parts=4)
    back = read_npy(spark, path, range_bytes=16_000)
    return r6(back.select("row", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x).alias("squares")))


# --- other grids ----------------------------------------------------------------------------------------

#: The grid of 64 x 64 cells of 10 m, and one of 7 m that begins 3 m further and ends beyond it.
AT, TO = resampling.Frame(0.0, 640.0, 10.0, 64, 64), resampling.Frame(3.0, 637.0, 7.0, 95, 93)
CENTRES = "t AS (SELECT r AS row, c AS col, (640 - (637 - (r + 0.5) * 7)) / 10.0::DOUBLE AS fy, (3 + (c + 0.5) * 7) / 10.0::DOUBLE AS fx FROM range(95) a(r) CROSS JOIN range(93) b(c))"


@query(f"WITH g AS ({GRID}), {CENTRES}, n AS (SELECT t.row, t.col, floor(fy - 0.5) + dr AS r, floor(fx - 0.5) + dc AS c, CASE dr WHEN 1 THEN (fy - 0.5) - floor(fy - 0.5) ELSE 1 - (fy - 0.5) + floor(fy - 0.5) END * CASE dc WHEN 1 THEN (fx - 0.5) - floor(fx - 0.5) ELSE 1 - (fx - 0.5) + floor(fx - 0.5) END AS w FROM t CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc)) SELECT n.row, n.col, round(sum(w * value) / sum(w), 10) AS value FROM n JOIN g ON g.row = r AND g.col = c AND w > 0 GROUP BY ALL")
def resampled_grid(spark, sf_dir):
    # weights of hundredths often end in a 5 at the seventh place, so these keep ten
    return resampling.resample(grid(spark, sf_dir), "value", AT, TO, size=SIZE).withColumn("value", F.round("value", 10))


@query(f"WITH g AS ({GRID}), {CENTRES}, n AS (SELECT row, col, floor(fy) AS r, floor(fx) AS c FROM t), near AS (SELECT n.row, n.col, value FROM n JOIN g ON g.row = r AND g.col = c), two AS (SELECT row, col, value FROM near UNION ALL SELECT row, col, value + 1 FROM g WHERE row >= 32) SELECT row, col, round(avg(value), 6) AS value FROM two WHERE row BETWEEN 20 AND 70 AND col BETWEEN 10 AND 80 GROUP BY ALL")
def mosaic_window(spark, sf_dir):
    """A window of the mean of two grids, one of them moved to the other's cells."""
    g = grid(spark, sf_dir)
    one = resampling.resample(g, "value", AT, TO, "near", SIZE)
    two = g.filter("row >= 32").withColumn("value", F.col("value") + 1)
    return r6(resampling.cropped(resampling.mosaic([one, two], "value", "mean"), (20, 70), (10, 80)))


@query("""WITH k AS (SELECT sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257222101::DOUBLE AS f)), u AS (SELECT e, cos(radians(49)) / sqrt(1 - pow(e * sin(radians(49)), 2)) AS m1, cos(radians(44)) / sqrt(1 - pow(e * sin(radians(44)), 2)) AS m2, tan(pi() / 4 - radians(49) / 2) / pow((1 - e * sin(radians(49))) / (1 + e * sin(radians(49))), e / 2) AS t1, tan(pi() / 4 - radians(44) / 2) / pow((1 - e * sin(radians(44))) / (1 + e * sin(radians(44))), e / 2) AS t2, tan(pi() / 4 - radians(46.5) / 2) / pow((1 - e * sin(radians(46.5))) / (1 + e * sin(radians(46.5))), e / 2) AS t0 FROM k),
n AS (SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n FROM u), s AS (SELECT *, 6378137 * m1 / (n * pow(t1, n)) AS s FROM n),
p AS (SELECT c_custkey, c_custkey % 140 / 10.0::DOUBLE - 4.5 AS lon, 42 + c_custkey % 90 / 10.0::DOUBLE AS lat FROM customer),
r AS (SELECT c_custkey, lon, lat, s * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2), n) AS rho, n * radians(lon - 3) AS theta, s * pow(t0, n) AS rho0 FROM p CROSS JOIN s)
SELECT c_custkey, round(700000 + rho * sin(theta), 3) AS x, round(6600000 + rho0 - rho * cos(theta), 3) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM r""")
def projected_points(spark, sf_dir):
    """Places in metres, and back in degrees."""
    key = F.col("c_custkey")
    p = load(spark, sf_dir, "customer").select(key, (key % 140 / 10 - 4.5).alias("lon"), (42 + key % 90 / 10).alias("lat"))
    x, y = to_lambert93(F.col("lon"), F.col("lat"))
    there = p.select(key, x.alias("x"), y.alias("y"))
    lon, lat = to_wgs84(F.col("x"), F.col("y"))
    return there.select(key, F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(f"WITH g AS ({GRID}), {PLOTS}, m AS (SELECT s.plot_id, round(avg(value), 6) AS mean, count(value) AS n_cells FROM s LEFT JOIN crossed USING (plot_id) GROUP BY 1) SELECT plot_id, mean, n_cells, (SELECT count(*) FILTER (plot_id % 3 <> 0) FROM m) AS n_new FROM m")
def terrain_cache(spark, sf_dir):
    """Plots of which a third is in the cache: a first run computes these, a second one the others alone."""
    path, shapes, made = shared_path(spark, "cache"), plots(spark, sf_dir), []

    def compute(missing):
        made.append(missing.count())
        return r6(zones.zonal_statistics(grid(spark, sf_dir), shapes.join(missing, "plot_id", "leftsemi"), "plot_id", "value", 0.0, 640.0, 10.0))

    ids = shapes.select("plot_id")
    cached(ids.filter("plot_id % 3 = 0"), path, "plot_id", compute)
    found = cached(ids, path, "plot_id", compute)
    return found.withColumn("n_new", F.lit(made[-1]).cast("long"))


# --- training sets --------------------------------------------------------------------------------------

PATCH = "'P_' || (user_id % 7) || '_' || user_id"


@query(f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS proportion FROM c),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY proportion DESC, event_type) = 1),
m AS (SELECT user_id, {PATCH} AS plot_id, event_type AS genus, proportion, CASE event_type WHEN 'click' THEN 'clic' WHEN 'view' THEN 'vue' WHEN 'purchase' THEN 'achat' ELSE event_type END AS species_name, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 4 WHEN 'purchase' THEN 5 ELSE 0 END AS species_code FROM d WHERE event_type <> 'error'),
s AS (SELECT user_id, ts::DATE AS date, round(avg(value), 6) AS ndvi FROM events GROUP BY ALL)
SELECT plot_id, strftime(date, '%Y-%m-%d') AS date, ndvi, genus, proportion, species_name, species_code::INT AS species_code, CASE WHEN user_id % 3 = 1 THEN 'test' ELSE 'train' END AS split, round(coalesce(c_acctbal, 0), 2) AS dem FROM m JOIN s USING (user_id) LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 > 0) ON c_custkey = user_id""")
def assembled_dataset(spark, sf_dir):
    """Label files, split lists, a terrain file and series, written from the tables and read by their readers."""
    path = shared_path(spark, "dataset")
    e = load(spark, sf_dir, "events").withColumn("plot_id", F.expr(PATCH))
    total = e.groupBy("plot_id").agg(F.count("*").alias("total"))
    pair = F.array("event_type", F.round(F.col("n") / F.col("total"), 6).cast("string"))
    each = e.groupBy("user_id", "plot_id", "event_type").agg(F.count("*").alias("n")).join(total, "plot_id").groupBy("user_id", "plot_id").agg(F.collect_list(pair).alias("pairs"))
    # a label file is one object: some hundred patches each
    whole = each.groupBy(F.floor(F.col("user_id") / 200).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("plot_id", "pairs")))).alias("value"))
    whole.write.partitionBy("file").text(f"{path}/labels")
    ids = e.select("user_id", "plot_id").distinct()
    for name, rest in (("train", 0), ("test", 1)):
        ids.filter(F.col("user_id") % 3 == rest).select(F.col("plot_id").alias("value")).write.text(f"{path}/{name}")
    write_report(ids.join(load(spark, sf_dir, "customer").filter("c_custkey % 5 > 0"), F.col("c_custkey") == F.col("user_id")).select("plot_id", F.round("c_acctbal", 2).alias("dem")), f"{path}/terrain")
    write_report(e.groupBy("plot_id", F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 6).alias("ndvi")), f"{path}/series")
    labels = read_labels(spark, f"{path}/labels/*")
    split = read_split(spark, f"{path}/train", f"{path}/test")
    lists = tuple(split.filter(F.col("split") == name).select(F.col("id").alias("plot_id")) for name in ("train", "test"))
    series = read_series(spark, f"{path}/series", "plot_id string, date string, ndvi double")
    terrain = read_series(spark, f"{path}/terrain", "plot_id string, dem double")
    genera = spark.createDataFrame([("click", "clic", 3), ("view", "vue", 4), ("purchase", "achat", 5)], "genus string, species_name string, species_code int")
    return datasets.assembled(labels, genera, series, terrain, lists, ("error",))


@query("""WITH c AS (SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, l_shipdate::DATE AS date, CASE WHEN l_linenumber % 2 = 0 THEN 'VV' ELSE 'VH' END AS layer, 'f' || (l_suppkey % 3) AS path, avg(l_quantity) AS value FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY ALL), f AS (SELECT date, layer, min(path) AS path FROM c GROUP BY ALL), k AS (SELECT date FROM f GROUP BY 1 HAVING count(*) = 2), o AS (SELECT row, col, date, max(value) FILTER (layer = 'VV') AS VV, max(value) FILTER (layer = 'VH') AS VH FROM c JOIN f USING (date, layer, path) WHERE date IN (SELECT date FROM k) GROUP BY ALL) SELECT row, col, strftime(date, '%Y-%m-%d') AS date, round(VV, 6) AS VV, round(VH, 6) AS VH, round(VV - VH, 6) AS VV_VH_ratio FROM o""")
def radar_cube(spark, sf_dir):
    """Scenes of two polarisations, several files a date; dates with one polarisation alone go."""
    x = load(spark, sf_dir, "lineitem").filter("l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'")
    layer = F.when(F.col("l_linenumber") % 2 == 0, "VV").otherwise("VH")
    cells = x.groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"), F.to_date("l_shipdate").alias("date"), layer.alias("layer"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("path")).agg(F.avg("l_quantity").alias("value"))
    return r6(datasets.radar_cube(cells, 1997).withColumn("date", F.col("date").cast("string")))

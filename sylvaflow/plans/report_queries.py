"""Queries of filters, look-ups, parsing, class reports, masks and yearly features, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow.functions import indices, names, series
from sylvaflow.operators import clustering, features, learning, quantiles, raster, tables
from sylvaflow.plans.queries import BAND_SQL, GRID, ORACLE_SQL, POINTS, grid, load, pixels, query, r6, vectors
from sylvaflow.sources import readers

__all__ = ["ORACLE_SQL"]


# --- filters -------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS date FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1996-10-31'""")
def date_range(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"))
    return tables.between_dates(x, "date", "1996-03-01", "1996-10-31")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def member_rows(spark, sf_dir):
    return tables.of_members(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ("O", "P"))


@query("""SELECT p_partkey, coalesce(p_size IN (4, 5, 6), false) AS clear FROM part""")
def clear_sky(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", indices.clear_sky(F.col("p_size")).alias("clear"))


@query("""SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE NOT coalesce(c_mktsegment IN ('BUILDING', '3'), false) AND NOT coalesce(c_nationkey::VARCHAR IN ('BUILDING', '3'), false)""")
def excluded_classes(spark, sf_dir):
    x = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.col("c_nationkey").cast("string").alias("k"))
    return tables.without_classes(x, ("c_mktsegment", "k"), ("BUILDING", "3")).drop("k")


@query("""SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#1')""")
def matching_rows(spark, sf_dir):
    return tables.matching(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "^Brand#1")


STATS = "SELECT p_type AS class, count(*) AS n FROM part GROUP BY 1"


@query(f"""SELECT class, n FROM ({STATS}) WHERE n > 0 AND class NOT IN ('PROMO', 'ECONOMY')""")
def detected_classes(spark, sf_dir):
    counts = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("n"))
    return tables.detected(counts, "n", "class", ("PROMO", "ECONOMY"))


@query("""SELECT p_partkey, CASE WHEN p_size / 50 >= 0.6 THEN p_type END AS class FROM part""")
def confident_classes(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("class"), (F.col("p_size") / 50).alias("c"))
    return tables.confident(x, "class", "c").drop("c")


@query("""SELECT user_id, event_type, count(*) AS n FROM events WHERE (user_id) IN (SELECT user_id FROM events GROUP BY 1 HAVING count(value) >= 60) GROUP BY ALL""")
def valid_series(spark, sf_dir):
    x = features.valid_series(load(spark, sf_dir, "events"), ["user_id"], "value", 60)
    return x.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT user_id, ts::DATE AS date, event_type FROM events), k AS (SELECT date FROM e GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM e)) SELECT user_id, date, event_type FROM e WHERE date IN (SELECT date FROM k)""")
def complete_dates(spark, sf_dir):
    x = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "event_type").distinct()
    kinds = [r[0] for r in x.select("event_type").distinct().collect()]  # as few as there are bands
    return features.complete_dates(x, "date", "event_type", kinds).select("user_id", "date", "event_type")


@query("""SELECT l_orderkey AS "EVI_orderkey", l_linenumber AS "EVI_linenumber", l_quantity::DOUBLE AS "EVI_quantity" FROM lineitem""")
def renamed_numeric(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("l_quantity"))
    return tables.renamed(tables.numeric(x, ("l_orderkey", "l_linenumber")), "^l_", "EVI_")


@query("""SELECT s_suppkey, s_acctbal, 0.0::DOUBLE AS absent FROM supplier""")
def aligned_columns(spark, sf_dir):
    return tables.align(load(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal", "absent"])


@query("""SELECT unnest(['B02_mean', 'NDVI_mean']) AS feature""")
def selected_features(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    f = x.select(F.col("l_orderkey").alias("plot_id"), F.col("l_tax").alias("B02_mean"), F.col("l_discount").alias("NDVI_mean"), F.when(F.col("l_quantity") < 0, 1.0).alias("EVI_mean"), F.lit(1.0).alias("CRI_mean"), F.col("l_quantity").alias("S1_VV_mean"))
    chosen = tables.drop_constant(f, tables.select_features(f))
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


# --- joins and sets ------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_acctbal AS elevation FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def fallback_keys(spark, sf_dir):
    """No id matches as it is, so both sides are compared without extension."""
    t = load(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".dem")).alias("plot_id"), F.col("c_acctbal").alias("elevation"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(".tif")).alias("plot_id"))
    return tables.inject_terrain(o, t).select("o_orderkey", "elevation")


@query("""SELECT p_partkey, coalesce(a.n_name, b.n_name) AS name FROM part LEFT JOIN nation a ON a.n_nationkey = p_size LEFT JOIN nation b ON b.n_nationkey = p_partkey % 25""")
def first_matches(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    found = tables.first_match(load(spark, sf_dir, "part").select("p_partkey", "p_size"), n, [F.col("p_size"), F.col("p_partkey") % 25], "n_nationkey", ["name"])
    return found.select("p_partkey", "name")


DAYS = "SELECT user_id, dayofyear(ts)::INT AS doy, min(value) AS value FROM events GROUP BY ALL"


@query(f"""WITH d AS ({DAYS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY doy) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM d), i AS (SELECT user_id, arg_min(doy, abs(doy - 20) * 1000 + doy) AS doy FROM d WHERE doy BETWEEN 18 AND 20 GROUP BY 1) SELECT r.user_id, r.doy, r.value FROM r LEFT JOIN i USING (user_id) WHERE CASE WHEN i.doy IS NOT NULL THEN r.doy = i.doy ELSE r.k = n // 2 + 1 END""")
def central_scenes(spark, sf_dir):
    x = load(spark, sf_dir, "events").groupBy("user_id", F.dayofyear("ts").alias("doy")).agg(F.min("value").alias("value"))
    return tables.central_scene(x, ["user_id"], "doy", "value", 20, 18, 20)


@query("""SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0""")
def keys_in_both(spark, sf_dir):
    return tables.in_both(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), load(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_nationkey"))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def keys_in_one(spark, sf_dir):
    return tables.only_in_first(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), load(spark, sf_dir, "orders").select("o_custkey"))


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def distinct_series(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query(f"""SELECT row, col, greatest((value > 25)::INT, (value < 20)::INT) AS mask FROM ({GRID})""")
def united_masks(spark, sf_dir):
    g = grid(spark, sf_dir)
    one = lambda test: g.select("row", "col", test.cast("int").alias("mask"))
    return raster.combine_masks(one(F.col("value") > 25), one(F.col("value") < 20), ["row", "col"], "or")


# --- aggregates and reports ----------------------------------------------------------------------------


@query("""SELECT o_orderstatus, c_mktsegment, o_orderdate::DATE AS date, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def profiles_by_type(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    x = o.join(c, o.o_custkey == c.c_custkey).groupBy("o_orderstatus", "c_mktsegment", F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("mean"))
    return x.withColumn("mean", F.round("mean", 4))


@query("""SELECT l_returnflag, dayofyear(l_shipdate)::INT AS doy, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.75), 6) AS q75 FROM lineitem GROUP BY ALL""")
def quartiles_by_day(spark, sf_dir):
    keys = ["l_returnflag", "doy"]
    x = load(spark, sf_dir, "lineitem").select("l_returnflag", F.dayofyear("l_shipdate").alias("doy"), "l_quantity")
    q = quantiles.group_quantiles(x, keys, "l_quantity", {"q25": 0.25, "q75": 0.75})
    return r6(x.groupBy(*keys).agg(F.avg("l_quantity").alias("mean")).join(q, keys))


@query(f"""SELECT label, {", ".join(f"round(avg(embedding[{k + 1}]::DOUBLE), 6) AS NDVI_{k}" for k in range(64))} FROM embeddings GROUP BY 1""")
def mean_profiles(spark, sf_dir):
    return r6(vectors(spark, sf_dir).groupBy("label").agg(*(F.avg(F.col("v")[k]).alias(f"NDVI_{k}") for k in range(64))))


@query("""SELECT l.level, coalesce(n, 0) AS n FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS level) l LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) ON lang = level""")
def level_counts(spark, sf_dir):
    return tables.level_counts(load(spark, sf_dir, "documents"), "lang", ("de", "en", "es", "fr", "xx"))


@query("""SELECT c_mktsegment, sum(o_totalprice * 100 / 10000) AS area_ha FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def area_by_type(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.sum(F.col("o_totalprice") * 100 / 10000).alias("area_ha"))


@query("""SELECT lang AS class, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY 1""")
def class_shares(spark, sf_dir):
    return r6(tables.shares(load(spark, sf_dir, "documents"), "lang"))


@query("""WITH s AS (SELECT l_linenumber AS fold, avg((l_returnflag = 'N')::INT) AS accuracy FROM lineitem GROUP BY 1) SELECT round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max FROM s""")
def fold_summary(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg((F.col("l_returnflag") == "N").cast("int")).alias("accuracy"))
    return r6(s.agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sd"), F.min("accuracy").alias("min"), F.max("accuracy").alias("max")))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12""")
def first_scenes(spark, sf_dir):
    """A report of the first scenes of an order."""
    return tables.first_rows(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 12)


@query("""SELECT list_sort(list(DISTINCT p_type)) AS classes FROM part""")
def class_list(spark, sf_dir):
    return load(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_type")).alias("classes"))


@query("""SELECT p_partkey, CASE WHEN p_size > 30 THEN 'Confirmed' WHEN p_size > 15 THEN 'Tentative' ELSE 'Rejected' END AS decision, round_even(p_retailprice, 1) AS importance FROM part""")
def decisions(spark, sf_dir):
    raw = F.when(F.col("p_size") > 30, "confirmed").when(F.col("p_size") > 15, "tentative").otherwise("rejected")
    return load(spark, sf_dir, "part").select("p_partkey", indices.decision_label(raw).alias("decision"), indices.rounded(F.col("p_retailprice"), 1).alias("importance"))


@query(f"""WITH s AS (SELECT vec_id, i, v FROM ({POINTS})), m AS (SELECT vec_id, avg(v) AS m, stddev_samp(v) AS sd FROM s GROUP BY 1) SELECT vec_id, {", ".join(f"round(max(CASE WHEN i = {k} THEN (v - m) / sd END), 6) AS c{k}" for k in range(1, 65))} FROM s JOIN m USING (vec_id) GROUP BY 1""")
def heatmap_rows(spark, sf_dir):
    x = vectors(spark, sf_dir).select("vec_id", *(F.col("v")[k - 1].alias(f"c{k}") for k in range(1, 65)))
    return r6(tables.row_zscore(x, ["vec_id"], [f"c{k}" for k in range(1, 65)]))


# --- scalars -------------------------------------------------------------------------------------------


@query(f"""SELECT l_orderkey, l_linenumber, round(1 / (B02 + 1e-10) - 1 / (B03 + 1e-10), 3) AS CRI FROM (SELECT l_orderkey, l_linenumber, {BAND_SQL} FROM lineitem)""")
def pigment_index(spark, sf_dir):
    """The variant of the table builder."""
    return pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(indices.all_indices("ts_long")["CRI"], 3).alias("CRI"))


@query("""SELECT p_partkey, greatest(0.2, least(0.8, p_size / 50)) AS clamped, round(0.2 + 0.5 * (1 / (1 + exp(-0.08 * (p_size * 7 - 110))) - 1 / (1 + exp(-0.06 * (p_size * 7 - 290)))), 9) AS green, round(sin(radians(p_size * 7.3::DOUBLE)), 9) AS aspect_sin, round(cos(radians(p_size * 7.3::DOUBLE)), 9) AS aspect_cos, round(least(20, ln(greatest(p_retailprice, 1) / greatest(p_size / 1000 - 0.02, 0.001))), 9) AS twi, (p_size / 50 - 0.5) > 0.03 AS overfit FROM part""")
def plot_scalars(spark, sf_dir):
    s = F.col("p_size")
    parts = indices.aspect_parts(s * F.lit(7.3))
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        indices.clamp(s / 50, 0.2, 0.8).alias("clamped"),
        F.round(indices.double_logistic((s * 7).cast("double"), F.lit(0.2), F.lit(0.7), F.lit(110.0), F.lit(290.0)), 9).alias("green"),
        *(F.round(c, 9).alias(n) for n, c in parts.items()),
        F.round(indices.topographic_wetness(F.col("p_retailprice"), s / 1000 - 0.02), 9).alias("twi"),
        indices.overfit(s / 50, F.lit(0.5)).alias("overfit"),
    )


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - m) / (s + 1e-8), 6) AS l_quantity, round((l_discount - n) / (t + 1e-8), 6) AS l_discount FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg(l_discount) AS n, stddev_samp(l_discount) AS t FROM lineitem)""")
def band_zscores(spark, sf_dir):
    return r6(tables.band_zscores(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 AS l_extendedprice, l_quantity / 10000 AS l_quantity FROM lineitem""")
def reflectance(spark, sf_dir):
    return tables.rescaled(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], "l_extendedprice")


FEATURES = "CASE p_partkey % 6 WHEN 0 THEN 'pheno_' WHEN 1 THEN 'NDVI_fourier_' WHEN 2 THEN 'S1_' WHEN 3 THEN 'DEM_' WHEN 4 THEN 'EVI_' ELSE 'B02_' END"


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'phenology' WHEN 1 THEN 'harmonic' WHEN 2 THEN 'radar' WHEN 3 THEN 'terrain' WHEN 4 THEN 'index' ELSE 'band' END AS type FROM part""")
def feature_types(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", names.feature_type(F.concat(F.expr(FEATURES), "p_type")).alias("type"))


FILES = "'/data/S2_' || strftime(o_orderdate, '%Y%m%d') || '_B08_' || o_orderkey || '.tif'"


@query(f"""SELECT o_orderkey, strptime(regexp_extract(f, '[0-9]{{8}}'), '%Y%m%d')::DATE AS date, 'B08' AS band, NULL::VARCHAR AS pol, split_part(regexp_replace(regexp_replace(f, '.*/', ''), '\\.[^.]*$', ''), '_', 4) AS field4, regexp_replace(regexp_replace(f, '.*/', ''), '\\.[^.]*$', '') AS stem FROM (SELECT o_orderkey, {FILES} AS f FROM orders)""")
def parsed_files(spark, sf_dir):
    f = F.concat(F.lit("/data/S2_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_B08_"), F.col("o_orderkey").cast("string"), F.lit(".tif"))
    return load(spark, sf_dir, "orders").select("o_orderkey", names.date_in(f).alias("date"), names.band_in(f).alias("band"), names.polarisation_in(f).alias("pol"), names.field(names.stem(f), 4).alias("field4"), names.stem(f).alias("stem"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '971' WHEN 1 THEN '2A' WHEN 2 THEN '2B' ELSE lpad((p_size % 90 + 1)::VARCHAR, 2, '0') END AS department FROM part""")
def departments(spark, sf_dir):
    code = F.expr("case p_size % 4 when 0 then '97105' when 1 then '2a004' when 2 then '2B033' else concat(lpad(p_size % 90 + 1, 2, '0'), '123') end")
    return load(spark, sf_dir, "part").select("p_partkey", names.department(code).alias("department"))


@query("""SELECT user_id, k::INT AS k, (a + (k * date_diff('day', a, b) // 6)::INT)::DATE AS date FROM (SELECT user_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY 1), (SELECT unnest(generate_series(0, 6)) AS k)""")
def even_dates(spark, sf_dir):
    x = load(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return x.select("user_id", F.posexplode(series.evenly(F.col("a"), F.col("b"), 7)).alias("k", "date"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN o_totalprice / 1000000 END AS cloud_cover, 'none' AS platform FROM orders WHERE o_totalprice >= 100000 AND o_totalprice / 1000000 <= 0.2""")
def catalogue_properties(spark, sf_dir):
    """Properties of nested JSON with defaults, and the null-rejecting cloud threshold."""
    json = F.when(F.col("o_totalprice") >= 100000, F.to_json(F.struct(F.struct((F.col("o_totalprice") / 1000000).alias("eo:cloud_cover")).alias("properties")))).otherwise('{"properties": {}}')
    read = F.from_json(json, "properties struct<`eo:cloud_cover`:double,platform:string>")
    x = load(spark, sf_dir, "orders").select("o_orderkey", read["properties"]["eo:cloud_cover"].alias("cloud_cover"), F.coalesce(read["properties"]["platform"], F.lit("none")).alias("platform"))
    return x.filter(F.col("cloud_cover") <= 0.2)


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def json_rows(spark, sf_dir):
    return tables.to_json_rows(load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("""SELECT s_suppkey, [[coalesce(s_acctbal, 0.0::DOUBLE), 0.0::DOUBLE], [s_nationkey::DOUBLE, 0.0::DOUBLE]] AS x FROM supplier""")
def tensors(spark, sf_dir):
    x = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("B02_d001"), F.col("s_nationkey").alias("B03_d001"))
    return tables.tensor(x, ["s_suppkey"], ["B02", "B03"], ["001", "006"])


# --- pixels --------------------------------------------------------------------------------------------


@query(f"""SELECT row, col, coalesce((floor(value) IN (16, 17, 24, 25))::INT, 0) AS mask FROM ({GRID})""")
def land_cover_mask(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("class", F.floor("value").cast("int"))
    return g.select("row", "col", raster.forest_mask(F.col("class"), raster.is_binary(g, "class"), (16, 17, 24, 25)).alias("mask"))


@query("""SELECT user_id AS pixel_id, coalesce((max(value) >= 90)::INT, 0) AS mask FROM events GROUP BY 1""")
def greenness_mask(spark, sf_dir):
    return raster.vegetation_mask(load(spark, sf_dir, "events").withColumnRenamed("user_id", "pixel_id"), ["pixel_id"], "value", 90.0)


@query("""SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN NULL WHEN 'ECONOMY' THEN 'E' ELSE p_type END AS type FROM part""")
def reclassified(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("type"))
    return tables.remap(x, "type", {"ECONOMY": "E"})


@query("""SELECT c_custkey, (CASE WHEN ((c_custkey % 40) + (c_acctbal / 1000)) < 25 AND c_custkey % 40 > 2 AND c_acctbal / 1000 > 1 THEN 1 ELSE 0 END)::INT AS inside FROM customer""")
def points_in_polygon(spark, sf_dir):
    """A triangle's legs at x = 2.5, between the whole numbers, and y = 1, and the line x + y = 25."""
    x, y = (F.col("c_custkey") % 40).cast("double"), F.col("c_acctbal") / 1000
    return load(spark, sf_dir, "customer").select("c_custkey", raster.in_polygon(x, y, [(2.5, 1.0), (24.0, 1.0), (2.5, 22.5)]).cast("int").alias("inside"))


SOFT = f"SELECT vec_id, i, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS x FROM ({POINTS}))"


@query(f"""WITH p AS ({SOFT}), l AS (SELECT vec_id, (arg_max(i, p * 1000000 - i / 1000000) - 1)::BIGINT AS class_idx, round(max(p), 6) AS confidence, round(-sum(p * ln(p)) / ln(64), 6) AS shannon, sum((p >= 0.02)::INT)::INT AS richness FROM p GROUP BY 1) SELECT d.doc_id AS pixel_id, class_idx, confidence, shannon, richness FROM documents d LEFT JOIN l ON vec_id = doc_id""")
def soft_map(spark, sf_dir):
    """Layers of soft predictions on a grid that has more pixels than predictions."""
    p = vectors(spark, sf_dir).select(F.col("vec_id").alias("pixel_id"), indices.softmax(F.col("v")).alias("probability"))
    cells = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("pixel_id"))
    return r6(features.soft_map(p, cells, 0.02).drop("presence"))


# --- years, plots, models ------------------------------------------------------------------------------


@query("""WITH x AS (SELECT l_suppkey, year(l_shipdate) AS y, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL), y AS (SELECT l_suppkey, q, CASE WHEN y < 2001 THEN d END AS d FROM x) SELECT l_suppkey AS plot_id, count(*) AS n_years, round(avg(q), 6) AS pheno_quantity, round(avg(d), 6) AS discount, round(stddev_samp(q), 6) AS pheno_quantity_sd_interannual FROM y GROUP BY 1""")
def multi_year_features(spark, sf_dir):
    """Tables of features, one a year; the last lacks a column."""
    x = load(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    own = lambda y: x.filter(F.col("y") == y).groupBy(F.col("l_suppkey").alias("plot_id")).agg(F.avg("l_quantity").alias("pheno_quantity"), F.avg("l_discount").alias("discount"))
    return r6(features.multi_year({**{y: own(y) for y in range(1995, 2001)}, 2001: own(2001).drop("discount")}))


@query()
def pixel_features(spark, sf_dir):
    """Splines have no SQL form: features of the pixels that a mask keeps, optical and radar in one row."""
    x = load(spark, sf_dir, "lineitem")
    cube = x.filter(F.year("l_shipdate") == 1997).select(F.col("l_suppkey").alias("pixel_id"), F.to_date("l_shipdate").alias("date"), F.col("l_tax").alias("B04"), F.col("l_quantity").alias("B08"), (-F.col("l_quantity") / 5).alias("S1_VV"), (-F.col("l_quantity") / 4).alias("S1_VH"))
    mask = x.groupBy(F.col("l_suppkey").alias("pixel_id")).agg((F.max("l_quantity") >= 40).cast("int").alias("mask"))
    return features.pixel_features(cube, ["B04", "B08", "S1_VV", "S1_VH"], mask, 1997)


@query()
def synthetic_plots(spark, sf_dir):
    """Made-up plots of the nations, as many samples as a study has; noise by hash, so rows repeat anywhere."""
    kinds = [(r.n_nationkey, r.n_name, "evergreen" if r.n_regionkey % 2 else "deciduous") for r in load(spark, sf_dir, "nation").collect()]
    return readers.synthetic(spark, kinds, samples=3, year=2023)


@query()
def fold_scores(spark, sf_dir):
    """Scores of all folds and repeats with the operator's own settings; forests have no SQL form."""
    x = vectors(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("label"), *(F.col("v")[k].alias(f"f{k}") for k in range(64)))
    rows = learning.cross_validate(x, [f"f{k}" for k in range(64)], "label", "vec_id")
    return spark.createDataFrame([(r["repeat"], r["fold"], r["accuracy"], r["kappa"], r["macro_f1"]) for r in rows], "repeat int, fold int, accuracy double, kappa double, macro_f1 double")


@query(f"""WITH g AS ({GRID}), n AS (SELECT a.row, a.col, sum(CASE WHEN b.col > a.col THEN w ELSE -w END * b.value) AS dx, count(*) AS k FROM (SELECT *, unnest([1, 2, 1]) AS w, unnest([-1, 0, 1]) AS dr FROM g) a JOIN g b ON b.row = a.row + a.dr AND abs(b.col - a.col) = 1 GROUP BY ALL), m AS (SELECT a.row, a.col, sum(CASE WHEN b.row > a.row THEN w ELSE -w END * b.value) AS dy, count(*) AS k FROM (SELECT *, unnest([1, 2, 1]) AS w, unnest([-1, 0, 1]) AS dc FROM g) a JOIN g b ON b.col = a.col + a.dc AND abs(b.row - a.row) = 1 GROUP BY ALL), t AS (SELECT g.row, g.col, dx, dy FROM g JOIN n USING (row, col) JOIN m USING (row, col) WHERE n.k = 6 AND m.k = 6 AND dx * dx + dy * dy > 1e-6) SELECT row, col, round(dx / sqrt(dx * dx + dy * dy), 6) AS east, round(-dy / sqrt(dx * dx + dy * dy), 6) AS north FROM t""")
def terrain_aspect(spark, sf_dir):
    """The aspect as a direction: the downslope side's unit vector turned by half a circle."""
    found = raster.slope_aspect(grid(spark, sf_dir)).filter("aspect is not null and slope > 0.001")
    back = F.radians(F.col("aspect") - 180)
    return r6(found.select("row", "col", F.sin(back).alias("east"), F.cos(back).alias("north")))




@query()
def shadow_selection(spark, sf_dir):
    """Which features tell rich customers, by shadows; forests have no SQL form."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("price"), F.avg(F.dayofyear("o_orderdate")).alias("day"))
    x = load(spark, sf_dir, "customer").withColumn("label", F.when(F.col("c_acctbal") > 4500, "rich").otherwise("other")).join(o, "c_custkey", "left")
    rows = learning.select_by_shadows(x, ["c_acctbal", "orders", "price", "day"], "label", "c_custkey")
    return spark.createDataFrame(rows, "feature string, decision string, mean_importance double")


@query()
def clustered_heatmap(spark, sf_dir):
    """Mean quantity, price, discount and tax of each supplier's lines, in the order of their clustering."""
    values = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return r6(clustering.clustered_profiles(tables.band_zscores(load(spark, sf_dir, "lineitem"), values).select("l_suppkey", *values), "l_suppkey", values))

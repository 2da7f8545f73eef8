"""The library's queries over the tables of FIXTURES.md, each with an independent SQL form where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow.functions import indices, names, series
from sylvaflow.operators import evaluation, features, learning, raster, tables
from sylvaflow.streaming.thinning import windowed_statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(frame: DataFrame, *but: str) -> DataFrame:
    """Doubles to six places, so that the order of a sum doesn't show."""
    return frame.select(*((F.round(c, 6).alias(c) if t == "double" and c not in but else F.col(c)) for c, t in frame.dtypes))


#: 64-point series of the embeddings: v at days 1, 6, 11 ...
POINTS = "SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, 1 + 5 * (generate_subscripts(embedding, 1) - 1) AS t, unnest(embedding)::DOUBLE AS v FROM embeddings"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", "label", v.alias("v"), F.transform(v, lambda x, i: (1 + 5 * i).cast("double")).alias("t"))


@query("""SELECT user_id, event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY ALL""")
def temporal_stats(spark, sf_dir):
    return r6(load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(*series.statistics(F.col("value"))))


@query("""SELECT l_returnflag, l_shipdate::DATE AS date, dayofyear(l_shipdate)::INT AS doy, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY ALL""")
def profiles(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("date"), "l_quantity")
    return r6(x.groupBy("l_returnflag", "date", F.dayofyear("date").alias("doy")).agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd")))


BANDS = {"B02": "l_tax", "B03": "l_discount", "B04": "l_discount + 0.01", "B05": "l_quantity / 100", "B06": "l_quantity / 90", "B08": "l_extendedprice / 100000", "B11": "l_quantity / 50", "B12": "l_tax + 0.02"}
BAND_SQL = ", ".join(f"{e} AS {b}" for b, e in BANDS.items())


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", *(F.expr(e).alias(b) for b, e in BANDS.items()))


@query(f"""SELECT l_orderkey, l_linenumber, round((B08 - B04) / (B08 + B04 + 1e-10), 6) AS NDVI, round(2.5 * (B08 - B04) / (B08 + 6 * B04 - 7.5 * B02 + 1 + 1e-10), 6) AS EVI, round((B08 - B11) / (B08 + B11 + 1e-10), 6) AS NDWI, round((B08 - B05) / (B08 + B05 + 1e-10), 6) AS RENDVI, round((B08 - B12) / (B08 + B12 + 1e-10), 6) AS NBR, round((1 / (B03 + 1e-10) - 1 / (B05 + 1e-10)) / 1e4, 6) AS CRI FROM (SELECT l_orderkey, l_linenumber, {BAND_SQL} FROM lineitem)""")
def spectral_indices(spark, sf_dir):
    found = {n: F.round(c / 1e4 if n == "CRI" else c, 6).alias(n) for n, c in indices.all_indices().items()}
    return pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", *found.values())


@query(f"""SELECT l_orderkey, l_linenumber, round((B03 - B08) / (B03 + B08 + 1e-10), 6) AS NDWI, round((B06 - B05) / (B06 + B05 + 1e-10), 6) AS RENDVI FROM (SELECT l_orderkey, l_linenumber, {BAND_SQL} FROM lineitem)""")
def table_indices(spark, sf_dir):
    found = indices.all_indices("ts_long")
    return pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.round(found[n], 6).alias(n) for n in ("NDWI", "RENDVI")))


@query("""SELECT l_orderkey, l_linenumber, round(vv - vh, 6) AS ratio, round(4 * q / (p + q), 6) AS RVI, round((p - q) / (p + q), 6) AS RFDI, round(CASE WHEN l_discount > 0 THEN 10 * log10(l_discount) END, 6) AS db FROM (SELECT *, pow(10, vv / 10) AS p, pow(10, vh / 10) AS q FROM (SELECT *, -l_quantity / 5 AS vv, -l_quantity / 5 - 10 * l_discount AS vh FROM lineitem))""")
def radar_indices(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    vv = -F.col("l_quantity") / 5
    found = indices.radar_indices(vv, vv - 10 * F.col("l_discount")) | {"db": indices.to_db(F.col("l_discount"))}
    return x.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query("""WITH g AS (SELECT unnest(generate_series(0, 365, 5)) AS x), s AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, avg(value) AS v FROM events GROUP BY ALL), k AS (SELECT DISTINCT user_id FROM s), l AS (SELECT user_id, x, arg_max(v, t) AS a, max(t) AS ta FROM k JOIN g ON true JOIN s USING (user_id) WHERE t <= x GROUP BY ALL), h AS (SELECT user_id, x, arg_min(v, t) AS b, min(t) AS tb FROM k JOIN g ON true JOIN s USING (user_id) WHERE t > x GROUP BY ALL) SELECT k.user_id, g.x::INT AS day, round(CASE WHEN ta IS NULL THEN b WHEN tb IS NULL THEN a ELSE a + (b - a) * (g.x - ta) / (tb - ta) END, 6) AS value FROM k JOIN g ON true LEFT JOIN l ON l.user_id = k.user_id AND l.x = g.x LEFT JOIN h ON h.user_id = k.user_id AND h.x = g.x""")
def grid_resample(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("double")
    daily = load(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.avg("value").alias("value"))
    grid = F.transform(series.date_grid(2024), lambda d: F.datediff(d, F.to_date(F.lit("2024-01-01"))).cast("double"))
    rows = series.to_series(daily, ["user_id"], "day", "value").withColumn("at", grid)
    rows = rows.select("user_id", F.explode(F.arrays_zip(F.col("at").alias("d"), series.resample(F.col("t"), F.col("v"), F.col("at")).alias("v"))).alias("p"))
    return rows.select("user_id", F.col("p.d").cast("int").alias("day"), F.round("p.v", 6).alias("value"))


@query(f"""WITH s AS ({POINTS}), n AS (SELECT vec_id, i, CASE WHEN i % 3 = 0 THEN NULL ELSE v END AS v FROM s), w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY i) AS a, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY vec_id ORDER BY i) AS ia, first_value(v IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM n) SELECT vec_id, i::INT AS i, round(CASE WHEN v IS NOT NULL THEN v WHEN ia IS NULL THEN b WHEN ib IS NULL THEN a ELSE a + (b - a) * (i - ia) / (ib - ia) END, 6) AS v FROM w""")
def gap_filled(spark, sf_dir):
    x = vectors(spark, sf_dir).withColumn("v", F.transform("v", lambda x, i: F.when((i + 1) % 3 != 0, x)))
    return x.select("vec_id", F.posexplode(series.gap_fill(F.col("v"))).alias("i", "v")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("v", 6).alias("v"))


@query(f"""WITH s AS ({POINTS}) SELECT vec_id, i::INT AS i, round(CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w ELSE v END, 6) AS v FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def moving_average(spark, sf_dir):
    x = vectors(spark, sf_dir).select("vec_id", F.posexplode(series.moving_average(F.col("v"))).alias("i", "v"))
    return x.select("vec_id", (F.col("i") + 1).alias("i"), F.round("v", 6).alias("v"))


def _savgol_sql() -> str:
    """The interior's known weights, and the ends' as integers over 42."""
    tap = lambda ws: " + ".join(f"{w} * list_extract(e, o + {j + 1})" for j, w in enumerate(ws))
    rows = {0: (39, 8, -4, -4, 1, 4, -2), 1: (8, 19, 16, 6, -4, -7, 4), 2: (-4, 16, 19, 12, 2, -4, 1), 3: (-4, 6, 12, 14, 12, 6, -4), 4: (1, -4, 2, 12, 19, 16, -4), 5: (4, -7, -4, 6, 16, 19, 8), 6: (-2, 4, 1, -4, -4, 8, 39)}
    cases = " ".join(f"WHEN i - 1 - o = {k} THEN ({tap(w)}) / 42.0" for k, w in rows.items())
    return f"SELECT vec_id, i::INT AS i, round(CASE {cases} END, 6) AS v FROM (SELECT vec_id, i, list_transform(embedding, lambda x: x::DOUBLE) AS e, greatest(0, least(i - 4, 57)) AS o FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings))"


@query(_savgol_sql())
def savitzky_golay(spark, sf_dir):
    x = vectors(spark, sf_dir).select("vec_id", F.posexplode(series.savgol(F.col("v"))).alias("i", "v"))
    return x.select("vec_id", (F.col("i") + 1).alias("i"), F.round("v", 6).alias("v"))


@query(f"""WITH s AS ({POINTS}), m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_samp(v) AS sd FROM s GROUP BY 1), p AS (SELECT vec_id, min(i) AS pk FROM s JOIN m USING (vec_id) WHERE v = hi GROUP BY 1),
b AS (SELECT s.*, lo, hi, mean, sd, pk, lo + 0.5 * (hi - lo) AS lv, lead(v) OVER w AS nv, lag(v) OVER w AS pv, lead(t) OVER w AS nt FROM s JOIN m USING (vec_id) JOIN p USING (vec_id) WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
c AS (SELECT vec_id, min(CASE WHEN i <= pk AND v >= lv THEN t END) AS sos, min(CASE WHEN i >= pk AND pk < 64 AND v <= lv THEN t END) AS eos, max(CASE WHEN i = pk THEN t END) AS mx FROM b GROUP BY 1),
d AS (SELECT vec_id, any_value(sos) AS sos, any_value(eos) AS eos, any_value(mx) AS mx, any_value(hi) AS hi, any_value(lo) AS lo, any_value(sd) AS sd, any_value(mean) AS mean, sum((nt - t) * (v + nv) / 2) AS total, sum((nt - t) * (v + nv) / 2) FILTER (WHERE t >= sos AND nt <= eos) AS growing,
regr_slope(v, t) FILTER (WHERE t BETWEEN 60 AND 180) AS g, regr_slope(v, t) FILTER (WHERE t BETWEEN 240 AND 340) AS r, avg(v) FILTER (WHERE t <= 80 OR t >= 335) AS w, avg(v) FILTER (WHERE t > 80 AND t <= 172) AS sp, avg(v) FILTER (WHERE t > 172 AND t <= 264) AS su, avg(v) FILTER (WHERE t > 264 AND t < 335) AS au,
count(*) FILTER (WHERE v > pv AND v > nv) AS peaks, arg_min(v, abs(t - 90) * 1000 + t) AS k1, arg_min(v, abs(t - 135) * 1000 + t) AS k2, arg_min(v, abs(t - 182) * 1000 + t) AS k3, arg_min(v, abs(t - 244) * 1000 + t) AS k4, arg_min(v, abs(t - 305) * 1000 + t) AS k5 FROM b JOIN c USING (vec_id) GROUP BY 1)
SELECT vec_id, sos::DOUBLE AS pheno_SOS, eos::DOUBLE AS pheno_EOS, (eos - sos)::DOUBLE AS pheno_LOS, mx::DOUBLE AS pheno_max_doy, round(hi, 6) AS pheno_max_ndvi, round(lo, 6) AS pheno_min_ndvi, round(hi - lo, 6) AS pheno_amplitude, round(total, 6) AS pheno_total_integral, round(growing, 6) AS pheno_growing_integral, round(g, 6) AS pheno_greening_rate, round(r, 6) AS pheno_browning_rate, round(w, 6) AS pheno_ndvi_winter, round(sp, 6) AS pheno_ndvi_spring, round(su, 6) AS pheno_ndvi_summer, round(au, 6) AS pheno_ndvi_autumn, round(CASE WHEN abs(w) > 0.01 THEN su / w END, 6) AS pheno_ratio_sum_win, round(CASE WHEN mean <> 0 THEN sd / mean END, 4) AS pheno_cv, CASE WHEN eos IS NOT NULL THEN (mx - sos)::DOUBLE END AS pheno_greenup_dur, (eos - mx)::DOUBLE AS pheno_senesc_dur, round(CASE WHEN eos - mx > 0 THEN (mx - sos) / (eos - mx) END, 6) AS pheno_asymmetry, peaks::INT AS pheno_n_peaks, round(k1, 6) AS pheno_ndvi_doy090, round(k2, 6) AS pheno_ndvi_doy135, round(k3, 6) AS pheno_ndvi_doy182, round(k4, 6) AS pheno_ndvi_doy244, round(k5, 6) AS pheno_ndvi_doy305 FROM d""")
def phenology(spark, sf_dir):
    found = r6(series.with_phenology(vectors(spark, sf_dir)).drop("label", "v", "t"), "pheno_cv")
    return found.withColumn("pheno_cv", F.round("pheno_cv", 4))


@query(f"""WITH s AS ({POINTS}), k AS (SELECT unnest([1, 2, 3]) AS k), f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * (i - 1) / 64)) AS re, -sum(v * sin(2 * pi() * k * (i - 1) / 64)) AS im, avg(v) AS m FROM s JOIN k ON true GROUP BY ALL) SELECT vec_id, round(any_value(m), 6) AS fourier_mean, {", ".join(f"round(max(CASE WHEN k = {k} THEN 2 * sqrt(re * re + im * im) / 64 END), 6) AS fourier_amp_{k}, round(max(CASE WHEN k = {k} THEN atan2(im, re) END), 5) AS fourier_phase_{k}" for k in (1, 2, 3))} FROM f GROUP BY 1""")
def fourier_features(spark, sf_dir):
    found = r6(vectors(spark, sf_dir).select("vec_id", *series.fourier(F.col("v"))), *(f"fourier_phase_{k}" for k in (1, 2, 3)))
    return found.withColumns({f"fourier_phase_{k}": F.round(f"fourier_phase_{k}", 5) for k in (1, 2, 3)})


@query(f"""WITH s AS ({POINTS}), q AS (SELECT vec_id, avg(v) FILTER (WHERE i <= 16) AS q1, avg(v) FILTER (WHERE i BETWEEN 17 AND 32) AS q2, avg(v) FILTER (WHERE i BETWEEN 33 AND 48) AS q3, avg(v) FILTER (WHERE i > 48) AS q4, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q25, median(v) AS median FROM s GROUP BY 1) SELECT vec_id, round(q1, 6) AS S1_VH_q1, round(q2, 6) AS S1_VH_q2, round(q3, 6) AS S1_VH_q3, round(q4, 6) AS S1_VH_q4, round(q2 - q4, 6) AS S1_VH_summer_winter, round(mean, 6) AS mean, round(sd, 6) AS sd, round(q25, 6) AS q25, round(median, 6) AS median FROM q""")
def radar_series(spark, sf_dir):
    x = series.with_statistics(vectors(spark, sf_dir), {"": F.col("v")})
    return r6(x.select("vec_id", *series.quarter_means(F.col("v"), "S1_VH_"), "mean", "sd", "q25", "median"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, ts::DATE AS date, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts::DATE, value, event_id) AS k FROM events), w AS (SELECT user_id, event_type, date, value, k, date AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_type, o.date, o.value, o.k, CASE WHEN date_diff('day', w.last, o.date) >= 10 THEN o.date ELSE w.last END, date_diff('day', w.last, o.date) >= 10 FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.k = w.k + 1) SELECT user_id, event_type, date, value FROM w WHERE kept""")
def thinned_scenes(spark, sf_dir):
    # only a date's first scene can be kept, so a key's array has one entry a date
    first = load(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("date")).agg(F.min("value").alias("value"))
    rows = F.array_sort(F.collect_list(F.struct("date", "value")))
    x = first.groupBy("user_id", "event_type").agg(rows.alias("rows")).withColumn("kept", series.thin(F.col("rows"), 10))
    return x.select("user_id", "event_type", F.explode("kept").alias("k")).select("user_id", "event_type", "k.date", "k.value")


@query("""SELECT user_id, """ + ", ".join(f"arg_min(value, abs(t - {d}) * 1000 + t) AS value_{d:03d}" for d in (5, 15, 25)) + """ FROM (SELECT user_id, dayofyear(ts) AS t, min(value) AS value FROM events GROUP BY ALL) GROUP BY 1""")
def nearest_values(spark, sf_dir):
    daily = load(spark, sf_dir, "events").groupBy("user_id", F.dayofyear("ts").alias("t")).agg(F.min("value").alias("value"))
    return tables.nearest(daily, ["user_id"], "t", "value", (5, 15, 25))


@query("""SELECT o_custkey, o_totalprice, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def dominant_rows(spark, sf_dir):
    x = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus")
    return tables.dominant(x, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("""WITH c AS (SELECT lang AS class, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight, round(count(*) OVER () / (n + 1) / sum(1 / (n + 1)) OVER (), 6) AS alternative FROM c""")
def class_weights(spark, sf_dir):
    return r6(evaluation.class_weights(load(spark, sf_dir, "documents"), "lang"))


PAIRS = "SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL"


@query(f"""WITH p AS ({PAIRS}), k AS (SELECT a AS c FROM p UNION SELECT b FROM p), n AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT x.c AS reference, y.c AS prediction FROM k x JOIN k y ON true) SELECT reference, prediction, coalesce(n, 0) AS n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY reference), 0), 0), 6) AS share FROM g LEFT JOIN n ON a = reference AND b = prediction""")
def confusion_matrix(spark, sf_dir):
    return r6(evaluation.confusion(load(spark, sf_dir, "labels"), "quality", "toxic"))


SCORES = f"""p AS ({PAIRS}), k AS (SELECT a AS c FROM p UNION SELECT b FROM p), s AS (SELECT c AS class, (SELECT count(*) FROM p WHERE a = c) AS support, (SELECT count(*) FROM p WHERE b = c) AS said, (SELECT count(*) FROM p WHERE a = c AND b = c) AS tp FROM k), pr AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM s), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query(f"""WITH {SCORES} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def per_class_scores(spark, sf_dir):
    return r6(evaluation.per_class(evaluation.confusion(load(spark, sf_dir, "labels"), "quality", "toxic")))


@query(f"""WITH {SCORES}, t AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS oa FROM p), e AS (SELECT sum(support * said) AS ch, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(f1 * support) / sum(support) AS wf FROM f) SELECT n, round(oa, 6) AS accuracy, round((oa - ch / (n * n)) / (1 - ch / (n * n)), 6) AS kappa, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1 FROM t JOIN e ON true""")
def evaluation_scores(spark, sf_dir):
    return r6(evaluation.evaluation(load(spark, sf_dir, "labels"), "quality", "toxic"))


@query("""SELECT p_type AS class, count(*) AS n_pixels, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct, count(*) * 100.0::DOUBLE / 10000 AS area_ha, round(100 * avg(p_size / 50), 6) AS confidence_pct, round(avg(p_retailprice / 10000), 6) AS mean_entropy FROM part WHERE p_type IS NOT NULL GROUP BY 1""")
def map_statistics(spark, sf_dir):
    x = load(spark, sf_dir, "part").withColumns({"c": F.col("p_size") / 50, "e": F.col("p_retailprice") / 10000})
    return r6(evaluation.map_statistics(x, "p_type", "c", "e"), "area_ha")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1""")
def monthly_scenes(spark, sf_dir):
    return evaluation.monthly_counts(load(spark, sf_dir, "orders"), "o_orderdate")


@query("""WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS n_years, round(avg(q), 6) AS quantity, round(avg(d), 6) AS discount, round(stddev_samp(q), 6) AS quantity_sd_interannual FROM y GROUP BY 1""")
def multi_year(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return r6(evaluation.interannual(x, ["l_suppkey"], "year", ["quantity", "discount"], ["quantity"]))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN (SELECT median(l_quantity) FROM lineitem WHERE l_quantity <= 40) ELSE l_quantity END AS q FROM lineitem""")
def imputed(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("q"))
    return tables.impute_median(x, ["q"])


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN hi > lo THEN (l_quantity - lo) / (hi - lo) ELSE 0.5 END, 6) AS minmax, round(CASE WHEN sd > 0 THEN (l_quantity - m) / sd ELSE 0 END, 6) AS zscore FROM lineitem JOIN (SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1) USING (l_suppkey)""")
def normalised(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return r6(tables.normalise(x, "l_quantity", ["l_suppkey"])).select("l_orderkey", "l_linenumber", "minmax", "zscore")


GRID = "SELECT (l_orderkey % 64)::BIGINT AS row, (l_partkey % 64)::BIGINT AS col, avg(l_quantity) AS value FROM lineitem GROUP BY ALL"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "lineitem")
    return x.groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.avg("l_quantity").alias("value"))


@query(f"""WITH g AS ({GRID}) SELECT a.row, a.col, round(avg(b.value), 9) AS focal, round(any_value(a.value) - avg(b.value), 9) AS tpi FROM g a JOIN g b ON b.row BETWEEN a.row - 5 AND a.row + 5 AND b.col BETWEEN a.col - 5 AND a.col + 5 GROUP BY ALL""")
def focal_mean(spark, sf_dir):
    # means of few numbers often end in a 5 at the seventh place, so these keep nine
    return raster.position_index(grid(spark, sf_dir)).select("row", "col", F.round("focal", 9).alias("focal"), F.round("tpi", 9).alias("tpi"))


@query(f"""WITH g AS ({GRID}), n AS (SELECT a.row, a.col, sum(CASE WHEN b.col > a.col THEN w ELSE -w END * b.value) AS dx, count(*) AS k FROM (SELECT *, unnest([1, 2, 1]) AS w, unnest([-1, 0, 1]) AS dr FROM g) a JOIN g b ON b.row = a.row + a.dr AND abs(b.col - a.col) = 1 GROUP BY ALL), m AS (SELECT a.row, a.col, sum(CASE WHEN b.row > a.row THEN w ELSE -w END * b.value) AS dy, count(*) AS k FROM (SELECT *, unnest([1, 2, 1]) AS w, unnest([-1, 0, 1]) AS dc FROM g) a JOIN g b ON b.col = a.col + a.dc AND abs(b.row - a.row) = 1 GROUP BY ALL) SELECT g.row, g.col, round(CASE WHEN n.k = 6 AND m.k = 6 THEN degrees(atan(sqrt(dx * dx + dy * dy) / 80)) END, 5) AS slope FROM g LEFT JOIN n USING (row, col) LEFT JOIN m USING (row, col)""")
def terrain_slope(spark, sf_dir):
    return raster.slope_aspect(grid(spark, sf_dir)).select("row", "col", F.round("slope", 5).alias("slope"))


@query(f"""SELECT floor(row / 4)::BIGINT AS row, floor(col / 4)::BIGINT AS col, round(avg(value), 6) AS value FROM ({GRID}) GROUP BY ALL""")
def block_means(spark, sf_dir):
    return r6(raster.block_aggregate(grid(spark, sf_dir), 4, "value"))


@query(f"""WITH g AS (SELECT row, col, round(value / 10)::BIGINT AS class FROM ({GRID})), n AS (SELECT floor(row / 4)::BIGINT AS row, floor(col / 4)::BIGINT AS col, class, count(*) AS n FROM g GROUP BY ALL) SELECT row, col, class FROM n QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, class) = 1""")
def block_modes(spark, sf_dir):
    return raster.block_aggregate(grid(spark, sf_dir).withColumn("class", F.round(F.col("value") / 10).cast("long")), 4, "class", "mode")


@query(f"""WITH g AS ({GRID}), a AS (SELECT row, col, (value > 25)::INT AS mask FROM g), b AS (SELECT row, col, (value < 30)::INT AS mask FROM g) SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, least(coalesce(a.mask, b.mask), coalesce(b.mask, a.mask)) AS mask FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col""")
def combined_masks(spark, sf_dir):
    g = grid(spark, sf_dir)
    one = lambda test: g.select("row", "col", test.cast("int").alias("mask"))
    return raster.combine_masks(one(F.col("value") > 25), one(F.col("value") < 30), ["row", "col"])


@query(f"""WITH g AS ({GRID}), p AS (SELECT s_suppkey, (s_suppkey % 70) * 10.0::DOUBLE AS x, (s_suppkey % 50) * 10.0::DOUBLE AS y FROM supplier) SELECT s_suppkey, round(value, 6) AS value FROM p LEFT JOIN g ON row = floor((640 - y) / 10) AND col = floor(x / 10)""")
def point_values(spark, sf_dir):
    p = load(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 70) * 10.0).alias("x"), ((F.col("s_suppkey") % 50) * 10.0).alias("y"))
    return r6(raster.at_points(p, grid(spark, sf_dir), 0.0, 640.0, 10.0, "value")).select("s_suppkey", "value")


@query(f"""WITH g AS (SELECT col * 10.0::DOUBLE AS x, row * 10.0::DOUBLE AS y, value FROM ({GRID})), p AS (SELECT s_suppkey AS plot_id, (s_suppkey % 63) * 10.0::DOUBLE + 3 AS px, (s_suppkey % 50) * 10.0::DOUBLE + 4 AS py FROM supplier) SELECT plot_id, round(avg(value), 6) AS value, count(*) AS n_pixels FROM p JOIN g ON pow(x - px, 2) + pow(y - py, 2) <= 225 GROUP BY 1""")
def zonal_means(spark, sf_dir):
    p = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plot_id"), ((F.col("s_suppkey") % 63) * 10.0 + 3).alias("x"), ((F.col("s_suppkey") % 50) * 10.0 + 4).alias("y"))
    g = grid(spark, sf_dir).select((F.col("col") * 10.0).alias("x"), (F.col("row") * 10.0).alias("y"), "value")
    return r6(raster.zonal_mean(p, g, 15.0, "value"))


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' ELSE 'test' END AS split FROM o""")
def stratified_split(spark, sf_dir):
    return learning.split_train_test(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM o""")
def three_way_split(spark, sf_dir):
    return learning.split_three(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM documents""")
def stratified_folds(spark, sf_dir):
    return learning.folds(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"""WITH s AS (SELECT vec_id, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS x FROM ({POINTS})), p AS (SELECT vec_id, i, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM s) SELECT vec_id, (arg_max(i, p * 1000000 - i / 1000000) - 1)::BIGINT AS class_idx, round(max(p), 6) AS confidence, round(-sum(p * ln(p)) / ln(64), 6) AS shannon, sum((p >= 0.1)::INT)::INT AS richness FROM p GROUP BY 1""")
def soft_predictions(spark, sf_dir):
    x = vectors(spark, sf_dir).select("vec_id", indices.softmax(F.col("v")).alias("p"))
    richness = F.aggregate(indices.presence(F.col("p")), F.lit(0), lambda s, k: s + k)
    return r6(x.select("vec_id", indices.argmax(F.col("p")).alias("class_idx"), F.array_max("p").alias("confidence"), indices.shannon(F.col("p")).alias("shannon"), richness.alias("richness")))


@query(f"""WITH m AS (SELECT vec_id, stddev_samp(v) / nullif(avg(v), 0) AS cv, avg(v) FILTER (WHERE t <= 59 OR t >= 335) AS w, avg(v) FILTER (WHERE t BETWEEN 152 AND 243) AS s FROM ({POINTS}) GROUP BY 1), r AS (SELECT *, CASE WHEN w > 0.05 THEN s / w WHEN w IS NOT NULL THEN 'inf'::DOUBLE END AS ratio FROM m) SELECT vec_id, CASE WHEN cv IS NULL OR ratio IS NULL THEN NULL WHEN cv < 0.1 AND ratio < 1.3 THEN 'evergreen' WHEN cv > 0.25 OR ratio > 2 THEN 'deciduous' ELSE 'semi_deciduous' END AS phenotype FROM r""")
def phenotypes(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", series.phenotype(F.col("t"), F.col("v")).alias("phenotype"))


def _case(x: str, steps: list[tuple[float, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {v} THEN '{n}'" for v, n in steps) + f" ELSE '{last}' END"


@query(f"""SELECT p_partkey, {_case("p_size / 50", [(0.9, "excellent"), (0.8, "very good"), (0.7, "good"), (0.6, "moderate"), (0.5, "weak")], "insufficient")} AS oa, {_case("p_size / 50", [(0.81, "almost perfect"), (0.61, "strong"), (0.41, "moderate"), (0.21, "fair"), (0, "slight")], "none")} AS kappa, {_case("p_size / 50", [(0.85, "very good"), (0.7, "good"), (0.55, "moderate")], "weak")} AS f1 FROM part""")
def interpretations(spark, sf_dir):
    x = F.col("p_size") / 50
    return load(spark, sf_dir, "part").select("p_partkey", indices.interpret_oa(x).alias("oa"), indices.interpret_kappa(x).alias("kappa"), indices.interpret_f1(x).alias("f1"))


@query("""SELECT o_orderkey, o_custkey, coalesce(c_acctbal, 0) AS elevation FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def terrain_joined(spark, sf_dir):
    t = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("elevation"))
    return tables.inject_terrain(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), t, "o_custkey")


@query("""SELECT c_custkey, c_mktsegment, coalesce(r_name, 'none') AS zone, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS grp FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_lookup(spark, sf_dir):
    n, r = (load(spark, sf_dir, t) for t in ("nation", "region"))
    zones = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    c = load(spark, sf_dir, "customer")
    c = c.join(tables.small(zones), c.c_nationkey == zones.n_nationkey, "left").withColumn("grp", F.col("c_mktsegment"))
    return tables.remap(c, "grp", {"BUILDING": "B", "MACHINERY": "M"}).select("c_custkey", "c_mktsegment", F.coalesce("r_name", F.lit("none")).alias("zone"), "grp")


@query("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN 'test' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'test' ELSE 'train' END AS split FROM orders""")
def listed_split(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    train, test = (c.filter(f).select(F.col("c_custkey").alias("o_custkey")) for f in ("c_nationkey = 3", "c_acctbal < 0"))
    return tables.split_by_lists(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), train, test, "o_custkey").select("o_orderkey", "split")


@query("""SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer""")
def common_columns(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").toDF("id", "name", "nation", "balance")
    return tables.union_common([s.drop("name"), load(spark, sf_dir, "customer").toDF("id", "title", "nation", "balance", "segment")])


@query("""SELECT p_partkey, metric, value FROM (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) ON size, price INTO NAME metric VALUE value)""")
def long_metrics(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return tables.to_long(x, ["p_partkey"], ["size", "price"])


@query("""SELECT user_id, """ + ", ".join(f"round(avg(CASE WHEN dayofyear(ts) % 5 = {k} THEN value END), 6) AS d{k}" for k in range(5)) + """ FROM events GROUP BY 1""")
def wide_series(spark, sf_dir):
    daily = load(spark, sf_dir, "events").groupBy("user_id", F.concat(F.lit("d"), F.dayofyear("ts") % 5).alias("day")).agg(F.avg("value").alias("value"))
    return r6(tables.to_wide(daily, "user_id", "day", "value", [f"d{k}" for k in range(5)]))


@query("""SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30""")
def top_importance(spark, sf_dir):
    return tables.ranked(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 30)


@query("""SELECT p_partkey, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS number, lpad(p_size::VARCHAR, 3, '0') AS size, upper(left(p_type, 2)) AS code, list_sum(list_transform(string_split(p_brand, ''), lambda c: unicode(c)))::INT AS points FROM part""")
def parsed_names(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", names.extract(F.col("p_brand"), "[0-9]+").alias("number"), names.padded(F.col("p_size"), 3).alias("size"), names.department(F.col("p_type")).alias("code"), names.code_points(F.col("p_brand")).alias("points"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last, sum((value IS NULL)::INT) AS nulls, sum((value <> 0)::INT) AS nonzero FROM events GROUP BY 1""")
def diagnostics(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.col("value") != 0).alias("nonzero"))


@query("""SELECT time_bucket(INTERVAL 5 DAYS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY ALL""")
def windowed(spark, sf_dir):
    return r6(windowed_statistics(load(spark, sf_dir, "events"), "ts", ["event_type"], "value"), "min", "max")


@query()
def spline_series(spark, sf_dir):
    """Natural cubic splines have no SQL form; tests hold them against a dense solve."""
    grid_days = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda d: d.cast("double"))
    return features.regular_series(load(spark, sf_dir, "events"), ["user_id"], "ts", "value", grid_days, "2024-01-01")


@query()
def feature_matrix(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    bands = {b: F.expr(e) for b, e in BANDS.items()} | {"S1_VV": -F.col("l_quantity") / 5, "S1_VH": -F.col("l_quantity") / 4}
    wide = x.filter("l_shipdate >= date'1996-01-01' and l_shipdate < date'1997-01-01'").select(F.col("l_suppkey").alias("plot_id"), F.to_date("l_shipdate").alias("date"), *(c.alias(b) for b, c in bands.items()))
    return features.feature_matrix(wide, list(bands), year=1996)


@query()
def forest_predictions(spark, sf_dir):
    """All components and the operator's own settings; forests have no SQL form."""
    names_ = [f"f{k}" for k in range(64)]
    x = vectors(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("label"), *(F.col("v")[k].alias(c) for k, c in enumerate(names_)))
    split = learning.split_train_test(x, "label", "vec_id")
    model = learning.train_forest(split.filter("split = 'train'"), names_, "label")
    return learning.predict(model, split.filter("split = 'test'"), ["vec_id", "label"]).select("vec_id", "label", "predicted", "confidence")

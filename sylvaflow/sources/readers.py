"""Readers of the input formats, each a lazy DataFrame, and writers of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow.functions import names

LABELS = "map<string,array<array<string>>>"
CATALOGUE = "features array<struct<id:string,properties:struct<datetime:string,`eo:cloud_cover`:double,platform:string,`s2:product_type`:string,`sat:orbit_state`:string>>>"


def read_series(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.parquet(path) if form == "parquet" else reader.csv(path, header=True)


def read_lower(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table with lower-case column names; ValueError if a required one is missing."""
    frame = spark.read.csv(path, header=True)
    frame = frame.toDF(*(c.lower() for c in frame.columns))
    if missing := sorted(set(required) - set(frame.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """patch_id, species, genus, proportion of {file: [[genus, proportion], ...]} files."""
    return exploded_labels(spark.read.text(path, wholetext=True))


def exploded_labels(frame: DataFrame) -> DataFrame:
    whole = frame.select(F.explode(F.from_json("value", LABELS)).alias("patch_id", "pairs"))
    each = whole.select("patch_id", F.explode("pairs").alias("p"))
    species = F.concat_ws("_", names.field(F.col("patch_id"), 1), names.field(F.col("patch_id"), 2))
    return each.select("patch_id", species.alias("species"), F.col("p")[0].alias("genus"), F.col("p")[1].try_cast("double").alias("proportion"))


def read_split(spark: SparkSession, train: str, test: str) -> DataFrame:
    """id, split of one-id-a-line files."""
    one = lambda path, name: spark.read.text(path).select(F.trim("value").alias("id"), F.lit(name).alias("split")).filter("id <> ''")
    return one(train, "train").unionByName(one(test, "test"))


def list_scenes(spark: SparkSession, path: str, band: str | None = None) -> DataFrame:
    """path, date, band of raster files by their names; only metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path).select("path")
    base = F.substring_index("path", "/", -1)
    out = files.select("path", names.date_in(base).alias("date"), names.band_in(base).alias("band")).filter("date is not null")
    return out.filter(F.col("band") == band) if band else out


def read_catalogue(spark: SparkSession, path: str, most_cloud: float | None = None, orbit: str | None = None) -> DataFrame:
    """id, datetime, date, cloud_cover, platform, product_type, orbit of scene catalogues in GeoJSON."""
    items = spark.read.schema(CATALOGUE).json(path, multiLine=True).select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    out = items.select("f.id", p["datetime"].alias("datetime"), F.substring(p["datetime"], 1, 10).try_cast("date").alias("date"), p["eo:cloud_cover"].alias("cloud_cover"), p["platform"].alias("platform"), p["s2:product_type"].alias("product_type"), p["sat:orbit_state"].alias("orbit"))
    if most_cloud is not None:
        out = out.filter(F.col("cloud_cover") <= most_cloud)
    return out.filter(F.lower("orbit") == orbit.lower()) if orbit else out


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """patch_id, x, y of GeoJSON points or polygons (area centroid of the outer ring)."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    p, g = F.col("f.properties"), F.col("f.geometry")
    out = f.select(
        F.coalesce(*(p[c] for c in ("name", "id", "patch_id", "filename", "patch_name"))).alias("patch_id"),
        F.from_json(g["coordinates"], "array<double>").alias("point"),
        F.from_json(g["coordinates"], "array<array<array<double>>>")[0].alias("ring"),
        g["type"].alias("type"),
    )
    edges = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda a, b: F.struct((a[0] * b[1] - b[0] * a[1]).alias("w"), (a[0] + b[0]).alias("x"), (a[1] + b[1]).alias("y")))
    out = out.withColumn("e", F.when(F.col("type") == "Polygon", edges))
    area = F.aggregate("e", F.lit(0.0), lambda s, e: s + e["w"])
    axis = lambda k, i: F.when(F.col("type") == "Point", F.col("point")[i]).otherwise(F.try_divide(F.aggregate("e", F.lit(0.0), lambda s, e: s + e[k] * e["w"]), 3 * area))
    return out.select("patch_id", axis("x", 0).alias("x"), axis("y", 1).alias("y"))


def synthetic(spark: SparkSession, species: list[tuple[int, str, str]], samples: int = 50, year: int = 2024, seed: int = 42) -> DataFrame:
    """plot_id, species_code, species_name, date, NDVI and bands of made-up plots. species: (code, name, type
    evergreen or deciduous). Noise hangs on plot, date and seed, so any cluster makes the same rows."""
    from sylvaflow.functions.indices import clamp, double_logistic
    from sylvaflow.functions.series import date_grid

    kinds = spark.createDataFrame(species, "species_code int, species_name string, type string")
    plots = kinds.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    plots = plots.withColumn("plot_id", F.format_string("sp%02d_%03d", "species_code", "sample"))
    rows = plots.select("*", F.explode(date_grid(year)).alias("date"))
    noise = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "plot_id", "date"), F.lit(2001)) / 1000.0 - 1.0
    doy = F.dayofyear("date").cast("double")
    leafy = double_logistic(doy, F.lit(0.2), F.lit(0.75) + F.col("species_code") * 0.005, F.lit(110.0), F.lit(290.0))
    green = F.lit(0.65) + 0.08 * F.sin(2 * F.lit(3.141592653589793) * (doy - 80) / 365)
    base = F.when(F.col("type") == "evergreen", green).otherwise(leafy)
    rows = rows.withColumn("NDVI", clamp(base + 0.03 * noise("ndvi"), 0.0, 1.0))
    red = clamp(0.08 - 0.05 * F.col("NDVI") + 0.01 * noise("B04"), 0.005, 1.0)
    rows = rows.withColumn("B04", red)
    rows = rows.withColumn("B08", F.col("B04") * (1 + F.col("NDVI")) / (1 - F.least("NDVI", F.lit(0.99))))
    near = {"B02": (0.6, 0.0), "B03": (0.9, 0.01), "B05": (1.4, 0.02), "B11": (1.8, 0.05), "B12": (1.2, 0.02)}
    rows = rows.withColumns({b: clamp(k * F.col("B04") + c + 0.005 * noise(b), 0.001, 1.0) for b, (k, c) in near.items()})
    return rows.drop("sample", "type")


def write_layers(layers: DataFrame, path: str) -> None:
    """(layer, row, col, value) as Parquet, one folder a layer."""
    layers.repartition("layer", F.floor(F.col("row") / 256), F.floor(F.col("col") / 256)).write.mode("overwrite").partitionBy("layer").parquet(path)


def write_report(frame: DataFrame, path: str) -> None:
    """A report table as CSV with header."""
    frame.write.mode("overwrite").option("header", "true").csv(path)

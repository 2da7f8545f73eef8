"""Training sets put together from label files, split lists, series and terrain; cubes of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.operators.learning import split_train_test
from sylvaflow.operators.tables import dominant, inject_terrain, small, split_by_lists, without_classes


def dominant_labels(labels: DataFrame, genera: DataFrame, non_tree: tuple[str, ...] = ()) -> DataFrame:
    """(patch_id, genus, proportion, species_name, species_code): each patch's genus of greatest proportion (ties:
    the first by name) with the name and code of genera(genus, species_name, species_code). A genus that isn't
    there keeps its name and has code 0. Patches of a class in `non_tree`, by either name, are left out."""
    best = dominant(labels.select("patch_id", "genus", "proportion"), ["patch_id"], "proportion", "genus")
    named = best.join(small(genera.select("genus", F.col("species_name").alias("_n"), F.col("species_code").alias("_c")).dropDuplicates(["genus"])), "genus", "left")
    out = named.select("patch_id", "genus", "proportion", F.coalesce("_n", "genus").alias("species_name"), F.coalesce("_c", F.lit(0)).alias("species_code"))
    return without_classes(out, ("species_name", "genus"), non_tree) if non_tree else out


def assembled(labels: DataFrame, genera: DataFrame, series: DataFrame, terrain: DataFrame | None = None, lists: tuple[DataFrame, DataFrame] | None = None, non_tree: tuple[str, ...] = (), ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """series(plot_id, ...) of the labelled patches with class, split and terrain.

    lists are (train, test) tables of ids; a patch in neither is for training. Without lists the split is a
    stratified one of the patches. Terrain comes by plot_id; a patch without has zeros. Series of patches without
    a label are left out, and so are labels without a series.
    """
    own = dominant_labels(labels, genera, non_tree).withColumnRenamed("patch_id", "plot_id")
    if lists is None:
        dealt = split_train_test(own, "species_name", "plot_id", ratio, seed)
    else:
        dealt = split_by_lists(own, *lists, key="plot_id")
    met = series.join(dealt, "plot_id")
    return met if terrain is None else inject_terrain(met, terrain)


def scene_cube(cells: DataFrame, layers: tuple[str, ...], year: int, least: int = 2) -> DataFrame:
    """(row, col, date, one column a layer) of cells(path, date, layer, row, col, value) of a year.

    Of several files of a date and layer the first by path counts; dates with fewer than `least` layers are left
    out. What is asked of the files is known from their paths and dates, a table with a row a file.
    """
    own = cells.filter(F.col("date").between(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))) & F.col("layer").isin(*layers))
    files = own.groupBy("date", "layer").agg(F.min("path").alias("path"))
    dates = files.groupBy("date").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("date")
    chosen = own.join(small(files.join(dates, "date", "leftsemi")), ["date", "layer", "path"], "leftsemi")
    return chosen.groupBy("row", "col", "date").pivot("layer", list(layers)).agg(F.first("value"))


def radar_cube(cells: DataFrame, year: int) -> DataFrame:
    """VV and VH of each cell and date, and their ratio, which is a difference in decibels."""
    return scene_cube(cells, ("VV", "VH"), year, 2).withColumn("VV_VH_ratio", F.col("VV") - F.col("VH"))

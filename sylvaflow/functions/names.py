"""Parsing of file names, ids and codes. No match gives null, never an empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def date_in(text: Column) -> Column:
    """The first run of eight digits as a date."""
    return F.try_to_timestamp(extract(text, r"\d{8}"), F.lit("yyyyMMdd")).cast("date")


def band_in(text: Column) -> Column:
    return extract(text, r"B\d{2}|B8A|SCL")


def polarisation_in(text: Column) -> Column:
    return extract(text, r"VV|VH")


def field(text: Column, k: int) -> Column:
    """The k-th field (from 1) between underscores."""
    return F.try_element_at(F.split(text, "_"), F.lit(k))


def stem(path: Column) -> Column:
    """The file name without folder and extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def code_points(text: Column) -> Column:
    """Sum of the code points."""
    return F.aggregate(F.transform(F.split(text, ""), lambda c: F.coalesce(F.ascii(c), F.lit(0))), F.lit(0), lambda s, x: s + x)


def department(code: Column) -> Column:
    """Department of a French commune code: three characters overseas (97x), else two."""
    return F.when(code.startswith("97"), F.substring(code, 1, 3)).otherwise(F.upper(F.substring(code, 1, 2)))


def feature_type(name: Column) -> Column:
    return (
        F.when(name.rlike("^pheno_"), "phenology")
        .when(name.rlike("fourier"), "harmonic")
        .when(name.rlike("^S1_"), "radar")
        .when(name.rlike("^DEM_"), "terrain")
        .when(name.rlike("^(NDVI|EVI|NDWI|CRI|RENDVI|NBR)_"), "index")
        .otherwise("band")
    )

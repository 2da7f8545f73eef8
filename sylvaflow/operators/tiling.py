"""Grids of cells (row, col, ...) dealt out by tiles, with a margin of their neighbours' cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_tiles(grid: DataFrame, size: int, margin: int, *columns: str) -> DataFrame:
    """Each cell under its own tile and under those in whose margin it lies, at most three more."""
    span = lambda c: F.sequence(F.floor((F.col(c) - margin) / size), F.floor((F.col(c) + margin) / size))
    return grid.withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col"))).select("tr", "tc", "row", "col", *columns)


def tile_array(group: pd.DataFrame, column: str, size: int, margin: int) -> np.ndarray:
    """A tile's column with its margin; absent cells are NaN."""
    out = np.full((size + 2 * margin,) * 2, np.nan)
    r, c = group["row"].to_numpy() - group["tr"].iat[0] * size + margin, group["col"].to_numpy() - group["tc"].iat[0] * size + margin
    out[r, c] = group[column].to_numpy(float)
    return out

"""Embedding whitening: principal components of exactly centred rows, scaled to unit variance.

Entries become whole numbers (x = floor(64 c) + 1000000), so sums and the centring are exact: the mean of a
dimension is q + r / n in whole numbers, and a centred entry is (x - q) - r / n, rounded once. A RowMatrix of the
centred rows gives the Gramian; over n it is the covariance, whose eigenvectors a local eigh finds. Its d x d
entries and the whitening matrix are all that passes the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.tables import stored

#: The fixed grid of the entries: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of which SCALE times is this or more have no whole number in a long; their vectors are dropped.
MOST = float(2**62)
_SUMS = "n long, low array<long>, high array<long>"


def on_grid(frame: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors without null or non-finite entries, on the grid."""
    usable = F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < MOST))
    whole = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return frame.filter(usable).select("vec_id", whole.alias("x"))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as rows of d entries; shorter ones end in the grid's zero."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy()
    if (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.full((len(sizes), d), SHIFT, np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of a partition's vectors and the sums of their entries, in halves that can't overflow."""
    n, low, high = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        d = max(len(low), pa.compute.max(pa.compute.list_value_length(column)).as_py())
        low, high = (np.concatenate([v, np.full(d - len(v), n * s)]) for v, s in ((low, SHIFT & 0xFFFFFFFF), (high, SHIFT >> 32)))
        x = _rows(column, d)
        n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
    if n:
        yield pa.RecordBatch.from_pylist([{"n": n, "low": low.tolist(), "high": high.tolist()}])


def _totals(grid: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension, from one row a task."""
    n, sums = 0, []
    for r in grid.select("x").mapInArrow(_sums, _SUMS).toLocalIterator():
        part = [a + (b << 32) for a, b in zip(r.low, r.high)]
        wide = max(len(sums), len(part))
        sums = [a + b for a, b in zip(sums + [n * SHIFT] * (wide - len(sums)), part + [r.n * SHIFT] * (wide - len(part)))]
        n += r.n
    return n, sums


def _centred(n: int, sums: list[int]) -> Column:
    """The centred entries of x as doubles: whole part first, so that nothing is lost to the size of n."""
    whole = F.array(*(F.lit(s // n) for s in sums))
    rest = F.array(*(F.lit((s % n) / n) for s in sums))
    full = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.greatest(F.lit(0), F.lit(len(sums)) - F.size("x"))))
    return F.transform(F.arrays_zip(full.alias("x"), whole.alias("q"), rest.alias("r")), lambda e: (e["x"] - e["q"]).cast("double") - e["r"])


def _gramian(frame: DataFrame, column: Column) -> np.ndarray:
    """The Gramian of a column of arrays, summed over the tasks by MLlib's tree of partial sums."""
    rows = MLUtils.convertVectorColumnsFromML(frame.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def _deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Sums of (n x - S)^2, exact; null where one doesn't fit a long."""
    gap = x - whole
    if float(np.abs(gap).max(initial=0) + 1) * n * max(1, x.shape[1]) ** 0.5 < 2.0**31:
        return ((n * gap - rest) ** 2).sum(1).tolist()
    exact = [sum((n * int(g) - int(r)) ** 2 for g, r in zip(row, rest)) for row in gap]
    return [v if v < 2**63 else None for v in exact]


def whitened(frame: DataFrame, components: int = 32, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Components are numbered from 1 by falling variance; either sign is possible, the same for all rows. A row
    is usable if its vector is there, without null or non-finite entries, or entries of 2^56 and more. Shorter
    vectors end in zeros up to the longest one's size. Repeated rows and ids count each and are returned each;
    a null id stays null. Components without variance (fewer rows than components, constant dimensions) have a
    null `whitened` and take no part in identity_error. A deviation beyond a long is null. Without usable rows,
    or with empty vectors alone, the result is empty. Other columns are ignored, whatever their names.
    """
    grid = stored(on_grid(frame, column), "grid")
    n, sums = _totals(grid)
    spark = frame.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not sums:
        return spark.createDataFrame([], kind)
    centred = _centred(n, sums)
    covariance = _gramian(grid, centred) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, len(values))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    solid = values[:k] > max(values[0], 0) * len(values) * np.finfo(float).eps
    scaled = np.where(solid, vectors[:, :k] / np.sqrt(np.where(solid, values[:k], 1)), 0)
    explained = np.where(values[:k] > 0, values[:k], 0) / trace if trace > 0 else np.zeros(k)
    whole, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    sent = spark.sparkContext.broadcast((scaled, solid, explained, whole, rest))

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scaled, _, _, whole, rest = sent.value
        x = _rows(column, len(whole))
        return x, ((x - whole) - rest / n) @ scaled

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of products of a partition's whitened values, which are centred: the rows are, exactly."""
        total = np.zeros((k, k))
        for batch in batches:
            z = project(batch.column(0))[1]
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["total"])

    seen = sum(np.array(r.total) for r in grid.select("x").mapInArrow(spread, "total array<double>").toLocalIterator()).reshape(k, k) / n
    kept = np.flatnonzero(solid)
    error = float(np.abs(seen[np.ix_(kept, kept)] - np.eye(len(kept))).max(initial=0))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, solid, explained, whole, rest = sent.value
        for batch in batches:
            if not len(batch):
                continue
            x, z = project(pa.array(batch["x"], pa.list_(pa.int64())))
            z[:, ~solid] = np.nan
            out = pd.DataFrame({"vec_id": np.repeat(batch["vec_id"].astype("Int64").array, k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": n})
            out["deviation"] = np.repeat(pd.array(_deviations(x, n, whole, rest), "Int64"), k)
            out["whitened"], out["explained"], out["identity_error"] = pd.array(z.ravel(), "Float64"), np.tile(explained, len(x)), error
            yield out

    return grid.mapInPandas(rows, kind)

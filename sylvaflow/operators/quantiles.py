"""Exact quantiles without a task that holds a column or a large group.

Of whole columns: each round counts the values of every column in bins between its bounds, and the bins that hold
the wanted ranks, with their least and greatest values, are the next bounds. Only counts leave a task. Of groups:
values are counted, sorted over all tasks, and ranked by running sums that go on from task to task, so a group may
lie over many of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.operators.stages import stored

#: Bins of an interval in one round.
BINS = 512
#: Values between bounds, of all columns together, from which on these are counted one by one.
FEW = 50_000


def _ranks(n: int, share: float) -> tuple[int, float]:
    """Rank from 0 of the value below a quantile, and how far it lies towards the next."""
    at = (n - 1) * share
    return int(at), at - int(at)


def column_quantiles(frame: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column, interpolated between neighbours; null and NaN don't count, infinities count as the
    greatest doubles, and a column without values has nulls. Every round is one pass over all columns; bounds shrink
    BINS-fold or to a bin's own values, so some rounds are enough for any spread, and once few values are left
    between the bounds these are counted one by one. The driver holds bounds, counts of wanted bins and those few."""
    spark, most = frame.sparkSession, float(np.finfo(float).max)
    clean = [F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c).cast("double")))) for c in columns]
    long = frame.select(F.posexplode(F.array(*clean)).alias("j", "v")).filter("v IS NOT NULL")
    stats = {r.j: (r.n, r.low, r.high) for r in long.groupBy("j").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    size = {c: stats[j][0] if j in stats else 0 for j, c in enumerate(columns)}
    found: dict[tuple[str, int], float] = {}
    asked = []  # column, least value, greatest, values below, values within, ranks within
    for j, (n, low, high) in stats.items():
        want = {r for s in shares for r in (_ranks(n, s)[0], min(_ranks(n, s)[0] + 1, n - 1))}
        asked.append((j, low, high, 0, n, sorted(want)))
    while True:
        for j, low, high, _, _, ranks in asked:
            if low == high:
                found.update({(columns[j], r): low for r in ranks})
        asked = [a for a in asked if a[1] < a[2]]
        if not asked:
            break
        few = sum(a[4] for a in asked) <= FEW
        bounds = spark.createDataFrame([(k, j, low, high, high / 2 - low / 2) for k, (j, low, high, _, _, _) in enumerate(asked)], "k int, j int, low double, high double, half double")
        met = long.join(F.broadcast(bounds), "j").filter("v BETWEEN low AND high")
        # halves, as the bounds may be the least and greatest doubles; if these don't differ, no value lies between
        place = F.least(F.lit(BINS - 1), F.coalesce(F.floor((F.col("v") / 2 - F.col("low") / 2) / F.nullif(F.col("half"), F.lit(0.0)) * BINS), F.when(F.col("v") == F.col("low"), 0).otherwise(BINS - 1)))
        group = met.groupBy("k", F.col("v").alias("bin")) if few else met.groupBy("k", place.alias("bin"))
        by: dict[int, list] = {}
        for r in group.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            by.setdefault(r.k, []).append((r.low, r.high, r.n))
        new = []
        for k, (j, _, _, below, _, ranks) in enumerate(asked):
            for low, high, n in sorted(by[k]):
                inside = [r for r in ranks if below <= r < below + n]
                if inside:
                    new.append((j, low, high, below, n, inside))
                below += n
        asked = new

    def quantile(c: str, share: float) -> float | None:
        if not size[c]:
            return None
        r, part = _ranks(size[c], share)
        low = found[c, r]
        return low if not part else low + part * (found[c, r + 1] - low)

    return {c: [quantile(c, s) for s in shares] for c in columns}


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of sorted (group, value) pairs summed up within this task's part of a group; a last row tells the
    task's first and last group and the sum of the latter."""
    part, names = TaskContext.get().partitionId(), ["last", "part", "k", "v", "n", "upto", "first"]
    first, group, total = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, n = batch.column("k"), batch.column("n").to_numpy()
        codes = keys.dictionary_encode().indices.to_numpy()
        first = keys[0].as_py() if first is None else first
        start = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(n))))
        upto = np.cumsum(n)
        before = np.concatenate([[0], upto])[start]
        if keys[0].as_py() == group:
            before[0] -= total
        upto = upto - before[run]
        group, total = keys[-1].as_py(), int(upto[-1])
        size = len(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(size, bool)), pa.array(np.full(size, part, np.int32)), keys, batch.column("v"), pa.array(n), pa.array(upto), pa.nulls(size, pa.string())], names)
    if group is not None:
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([part], pa.int32()), pa.array([group]), pa.array([0.0]), pa.array([0]), pa.array([total]), pa.array([first])], names)


def group_quantiles(frame: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each of `shares`): quantiles of each group, interpolated between neighbours.

    Null and NaN values don't count; a group without others has nulls. Equal values of a group are counted before
    the shuffle, and what is left is dealt out by ranges of (group, value): a group with most of the rows is many
    tasks' work. The driver gets one row a task.
    """
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    v = F.col(value).cast("double")
    groups = frame.select(*keys).distinct().withColumn("k", name)
    pairs = frame.filter(v.isNotNull() & ~F.isnan(v)).groupBy(name.alias("k"), v.alias("v")).agg(F.count("*").alias("n"))
    kind = "last boolean, part int, k string, v double, n long, upto long, first string"
    found = stored(pairs.repartitionByRange("k", "v").sortWithinPartitions("k", "v").mapInArrow(_running, kind), "ranked")
    before, state = {}, ("", 0)
    for r in sorted(found.filter("last").collect(), key=lambda r: r.part):  # a row a task
        own = r.upto
        if state[0] == r.first:
            before[r.part] = state
            own += state[1] if r.k == r.first else 0
        state = (r.k, own)
    at = F.lit(0).cast("long")
    if before:
        carried = F.from_json(F.lit(json.dumps([{"p": p, "g": g, "s": s} for p, (g, s) in before.items()])), "array<struct<p: int, g: string, s: long>>")
        rows = frame.sparkSession.range(1).select(F.explode(carried).alias("e")).select(F.col("e.p").alias("part"), F.col("e.g").alias("k"), F.col("e.s").alias("s"))
        ranked = found.filter("not last").join(F.broadcast(rows), ["part", "k"], "left").withColumn("upto", F.col("upto") + F.coalesce("s", at))
    else:
        ranked = found.filter("not last")
    totals = ranked.groupBy("k").agg(F.max("upto").alias("total"))
    met = ranked.join(totals, "k")
    rank = lambda s: F.floor((F.col("total") - 1) * F.lit(float(s)))
    holds = lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto"))
    picks = [F.max(F.when(holds(rank(s) + d), F.col("v"))).alias(f"_{j}_{d}") for j, s in enumerate(shares.values()) for d in (0, 1)]
    got = met.groupBy("k").agg(F.max("total").alias("total"), *picks)

    def between(j: int, s: float):
        part = (F.col("total") - 1) * F.lit(float(s)) - rank(s)
        low, high = F.col(f"_{j}_0"), F.col(f"_{j}_1")
        return F.when(part == 0, low).otherwise(low + part * (high - low))

    return groups.join(got, "k", "left").select(*keys, *(between(j, s).alias(c) for j, (c, s) in enumerate(shares.items())))

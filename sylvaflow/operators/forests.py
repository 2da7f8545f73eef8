"""Random forests whose trees grow in tasks and lie in a table: the driver holds thresholds and labels, never a tree.

A row is one byte a feature, its place between at most 31 thresholds. A task grows its trees one after another, level by
level, each from all rows: it keeps the rows of a table of up to HELD bytes and reads larger ones again for each level.
Histograms of a level are made for as many nodes at a time as CELLS numbers hold; where rows are fewer than numbers, rows
are sorted instead. Rules are those of pyspark.ml: Poisson bags, ceil(sqrt(p)) features a node, Gini, split while
it gains, siblings of one class merged, probabilities the mean of the leaves' shares."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sylvaflow.operators.stages import written
from sylvaflow.sources.stores import opened

BINS = 32
HELD = 96 << 20  # bytes of rows that a task keeps
CELLS = 1 << 22  # numbers of a histogram
BLOCK = 1 << 19  # rows counted at a time
TINY = 1e-10  # of a node's weight: what rounding leaves

Cuts = dict[str, list[float]]


def _values(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return np.asarray(batch.column("_x").flatten(), dtype=np.float64).reshape(batch.num_rows, p)


def _array(features: list[str]):
    return F.array(*(F.col(c).cast("double") for c in features)).alias("_x")


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _between(low: list[float], high: list[float]) -> list[float]:
    return [a if not a <= (m := a / 2 + b / 2) < b else m for a, b in zip(low, high)]


def _exact(v: np.ndarray) -> list[float]:
    """thresholds() of the values of a feature."""
    v = np.sort(v[~np.isnan(v)])
    if len(u := np.unique(v)) > BINS:
        low = np.unique(v[-(-np.arange(1, BINS) * len(v) // BINS) - 1])
        low = low[low < v[-1]]
        return _between(low.tolist(), v[np.searchsorted(v, low, "right")].tolist())
    return _between(u[:-1].tolist(), u[1:].tolist())


def thresholds(path: str, spark: SparkSession, features: list[str]) -> Cuts:
    """Between all values of a feature of at most 32, else after 31 quantiles; halfway to the next value that occurs.

    `path` has a table of arrays _x. While a feature fits in a task, a task takes some features at a time."""
    p, rows = len(features), spark.read.parquet(path)
    n = rows.count()
    if 8 * n > HELD:
        return _approximate(rows, features)
    wide = max(1, HELD // max(1, 8 * n))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for mine in (ids[k : k + wide] for k in range(0, len(ids), wide)):
                x = np.concatenate([np.empty((0, len(mine))), *(_values(part, p)[:, mine] for part in _parts(path, ["_x"], max(1024, (1 << 20) // p)))])
                yield from (pa.RecordBatch.from_pydict({"c": pa.array([k], pa.int32()), "v": pa.array([_exact(x[:, i])], pa.list_(pa.float64()))}) for i, k in enumerate(mine))

    found = spark.range(0, p, 1, min(p, _cores(spark))).mapInArrow(some, "c int, v array<double>").collect()
    return {features[r.c]: list(r.v) for r in found}


def _approximate(rows: DataFrame, features: list[str]) -> Cuts:
    """thresholds() of features that no task holds: quantiles are within 0.0005 of all rows."""
    p = len(features)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * p
        for batch in batches:
            x = _values(batch, p)
            seen = [s if len(s) > BINS else np.unique(np.concatenate([s, c[~np.isnan(c)]]))[: BINS + 1] for s, c in zip(seen, x.T)]
        yield pa.RecordBatch.from_pydict({"c": pa.array(np.repeat(np.arange(p), [len(s) for s in seen]), pa.int32()), "v": pa.array(np.concatenate(seen), pa.float64())})

    found = rows.select("_x").mapInArrow(few, "c int, v double").groupBy("c").agg(F.array_sort(F.collect_set("v")).alias("v"))
    last = {r.c: r.v for r in found.select("c", F.when(F.size("v") <= BINS, F.col("v")).alias("v")).collect()}
    many = [k for k in range(p) if k in last and last[k] is None]
    chosen = {k: sorted(set(v[:-1])) for k, v in last.items() if v is not None}
    following = {k: v[1:] for k, v in last.items() if v is not None}
    if many:
        asked = [k / BINS for k in range(1, BINS)]
        wide = rows.select(*(F.col("_x")[k].alias(f"_{k}") for k in many))
        chosen |= {k: sorted(set(q)) for k, q in zip(many, wide.approxQuantile([f"_{k}" for k in many], asked, 0.0005))}
        edges = {k: np.array(chosen[k]) for k in many}

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = {k: np.full(len(e) + 1, np.inf) for k, e in edges.items()}
            for batch in batches:
                x = _values(batch, p)
                for k, e in edges.items():
                    known = x[~np.isnan(x[:, k]), k]
                    np.minimum.at(least[k], np.searchsorted(e, known), known)
            yield pa.RecordBatch.from_pydict({"c": pa.array([k for k, v in least.items() for _ in v[1:]], pa.int32()), "i": pa.array([i for v in least.values() for i in range(len(v) - 1)], pa.int32()), "v": pa.array([float(a) for v in least.values() for a in v[1:]], pa.float64())})

        after = {(r.c, r.i): r.v for r in rows.select("_x").mapInArrow(above, "c int, i int, v double").groupBy("c", "i").agg(F.min("v").alias("v")).collect()}
        following |= {k: [after[k, i] for i in range(len(chosen[k]))] for k in many}
    return {c: _between(chosen.get(k, []), following.get(k, [])) for k, c in enumerate(features)}


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for k, c in enumerate(cuts):
        out[:, k] = np.searchsorted(c, x[:, k])
    return out


def _bytes(codes: np.ndarray) -> pa.Array:
    n, p = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * p + 1, p, dtype=np.int32) if p else np.zeros(n + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def values(frame: DataFrame, features: list[str], label: str, weight: str | None) -> DataFrame:
    """_x (all features in one array, so that later plans are narrow), _y, _w."""
    return frame.select(_array(features), F.col(label).cast("string").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))


def _binned(rows: DataFrame, labels: list[str], cuts: list[list[float]]) -> DataFrame:
    """x (a byte a feature), y (place of the label), w from values()."""
    edges, p = [np.array(c) for c in cuts], len(cuts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pa.array(labels, pa.string())
        for batch in batches:
            for part in (batch.slice(k, 1 << 16) for k in range(0, batch.num_rows, 1 << 16)):
                y = pc.index_in(part.column("_y"), value_set=places).cast(pa.int32())
                yield pa.RecordBatch.from_pydict({"x": _bytes(_codes(_values(part, p), edges)), "y": y, "w": part.column("_w")})

    return rows.mapInArrow(code, "x binary, y int, w double")


def _parts(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """A stored table in an order that is always the same."""
    store, root = opened(path)
    names = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".parquet"))
    for name in names:
        with store.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=rows, columns=columns, use_threads=False)


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """All bytes of a column of binaries."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _blocks(path: str, p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for part in _parts(path, ["x", "y", "w"], min(BLOCK, max(1024, (8 << 20) // p))):
        if part.num_rows:
            yield _numbers(part.column("x"), np.uint8), np.asarray(part.column("y")), np.asarray(part.column("w"))


def _held(path: str, p: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    x, y, w = (np.concatenate(v) for v in zip(*_blocks(path, p)))
    return [(x[k * p : (k + BLOCK) * p], y[k : k + BLOCK], w[k : k + BLOCK]) for k in range(0, len(y), BLOCK)]


def _walk(x: np.ndarray, p: int, rows: np.ndarray, tree: dict, levels: int) -> np.ndarray:
    """The node of each of the rows; a leaf is its own child."""
    base, at = rows * p, np.zeros(len(rows), np.int32)
    for _ in range(levels):
        at = tree["left"][at] + (x[base + tree["feature"][at]] > tree["cut"][at])
    return at


def _dense(counts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, j, cut, weights by class left of it) of each node's best split, from counts(j, node, bin, class)."""
    left = counts.cumsum(2)[:, :, :-1]
    n = total.sum(1)
    wl = left.sum(3)
    wr = n[:, None] - wl
    squares = np.einsum("jsbk,jsbk->jsb", left, left)
    others = (total**2).sum(1)[:, None] - 2 * np.einsum("jsbk,sk->jsb", left, total) + squares
    least = n[:, None] * TINY
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((wl > least) & (wr > least), (squares / wl + others / wr) / n[:, None], -1.0)
    flat = gain.transpose(1, 0, 2).reshape(len(n), -1)
    best, every = flat.argmax(1), np.arange(len(n))
    j, cut = np.divmod(best, left.shape[2])
    return flat[every, best] - ((total / n[:, None]) ** 2).sum(1), j, cut, left[j, every, cut]


def _before(v: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums of v before each entry since the last new one."""
    sums = np.cumsum(v) - v
    return sums - sums[np.flatnonzero(new)][np.cumsum(new) - 1]


def _changes(v: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], v[1:] != v[:-1]])


def _sparse(key: np.ndarray, weight: np.ndarray, total: np.ndarray, tried: int) -> tuple[np.ndarray, ...]:
    """_dense() from places (node, j, bin, class) that occur and their weights."""
    nodes, k = total.shape
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(_changes(key))
    key, raw = key[first], np.add.reduceat(weight[order], first)
    spot, c = np.divmod(key, k)
    g, b = np.divmod(spot, BINS)
    s = g // tried
    share = total / total.sum(1)[:, None]
    parent = (share**2).sum(1)
    v = raw / total.sum(1)[s]
    byclass = np.argsort(g * k + c, kind="stable")
    gc = (g * k + c)[byclass]
    seen = np.empty_like(v)
    seen[byclass] = _before(v[byclass], _changes(gc))
    new = _changes(g)
    upto = lambda z: _before(z, new) + z
    end = np.flatnonzero(np.concatenate([spot[1:] != spot[:-1], [True]]))
    end = end[np.concatenate([g[end][1:] == g[end][:-1], [False]])]  # nothing is right of a group's last place
    wl, squares = upto(v)[end], upto(v * (2 * seen + v))[end]
    others = parent[s[end]] - 2 * upto(v * share[s, c])[end] + squares
    score = squares / wl + others / (1 - wl)
    gain, at = np.full(nodes, -1.0), np.zeros(nodes, np.int64)
    np.maximum.at(gain, s[end], score)
    hit = np.flatnonzero(score == gain[s[end]])
    at[s[end[hit[::-1]]]] = spot[end[hit[::-1]]]  # the first of equal ones
    best, cut = np.divmod(at, BINS)
    mine = (g == best[s]) & (b <= cut[s])
    left = np.bincount(s[mine] * k + c[mine], raw[mine], nodes * k).reshape(nodes, k)
    return gain - parent, best % tried, cut, left


def grow(blocks: list | None, path: str, p: int, classes: int, depth: int, seed: list[int], bag: bool) -> dict:
    """One tree: feature, cut, left (child; right is the next), share (of classes in leaves) by node; importance by feature."""
    draw = np.random.default_rng(seed)
    tried = min(p, ceil(sqrt(p)))
    cells = tried * BINS * classes

    def drawn() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for k, (x, y, w) in enumerate(blocks if blocks is not None else _blocks(path, p)):
            times = np.random.default_rng([*seed, k]).poisson(1.0, len(y)) if bag else np.ones(len(y))
            rows = np.flatnonzero(times)
            yield x, rows, y[rows].astype(np.int64), w[rows] * times[rows]

    kept = [[x, rows, y, w, np.zeros(len(rows), np.int64)] for x, rows, y, w in drawn()] if blocks is not None else None
    total = sum((np.bincount(y, w, classes) for _, _, y, w in drawn()), np.zeros(classes))[None]
    tree = {"feature": np.zeros(1, np.int32), "cut": np.full(1, 255, np.uint8), "left": np.zeros(1, np.int32)}
    counts, gains, begins = [total], [np.zeros(1)], [0]
    mixed = lambda t: 1 - ((t / np.maximum(t.sum(1), 1e-300)[:, None]) ** 2).sum(1) > TINY
    nodes = np.flatnonzero(mixed(total))  # those of the last level that may split
    total = total[nodes]
    for level in range(depth):
        if not len(nodes):
            break
        slot = np.full(len(tree["left"]), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        choice = np.argpartition(draw.random((len(nodes), p)), tried - 1, axis=1)[:, :tried] if tried < p else np.tile(np.arange(p), (len(nodes), 1))

        def here() -> Iterator[tuple[np.ndarray, ...]]:
            if kept is not None:
                yield from kept
                return
            for x, rows, y, w in drawn():
                s = slot[_walk(x, p, rows, tree, level)]
                use = np.flatnonzero(s >= 0)
                yield x, rows[use], y[use], w[use], s[use]

        size = sum(len(b[4]) for b in kept) * tried if kept is not None else None
        if size is not None and size <= CELLS // 4 and 4 * size < len(nodes) * cells:
            keys, weights = [], []
            for x, rows, y, w, s in here():
                for j in range(tried):
                    keys.append(((s * tried + j) * BINS + x[rows * p + choice[s, j]]) * classes + y)
                    weights.append(w)
            gain, j, cut, left = _sparse(np.concatenate(keys), np.concatenate(weights), total, tried)
        else:
            found, step = [], max(1, CELLS // cells)
            for a in range(0, len(nodes), step):
                z = min(len(nodes), a + step)
                hist = np.zeros((tried, (z - a) * BINS * classes))
                for x, rows, y, w, s in here():
                    if z - a < len(nodes):
                        use = np.flatnonzero((s >= a) & (s < z))
                        rows, y, w, s = rows[use], y[use], w[use], s[use] - a
                    base = rows * p
                    for j in range(tried):
                        hist[j] += np.bincount((s * BINS + x[base + choice[a:z, j][s]]) * classes + y, w, hist.shape[1])
                found.append(_dense(hist.reshape(tried, z - a, BINS, classes), total[a:z]))
            gain, j, cut, left = (np.concatenate(v) for v in zip(*found))
        split = np.flatnonzero(gain > TINY)
        if not len(split):
            break
        ids, start = nodes[split], len(tree["left"])
        children = start + 2 * np.arange(len(split), dtype=np.int32)
        tree["feature"][ids], tree["cut"][ids], tree["left"][ids] = choice[split, j[split]], cut[split], children
        gains[-1][ids - begins[-1]] = gain[split] * total[split].sum(1)
        born = np.stack([left[split], total[split] - left[split]], 1).reshape(-1, classes)
        born[born < born.sum(1)[:, None] * TINY] = 0.0
        tree = {"feature": np.append(tree["feature"], np.zeros(len(born), np.int32)), "cut": np.append(tree["cut"], np.full(len(born), 255, np.uint8)), "left": np.append(tree["left"], np.arange(start, start + len(born), dtype=np.int32))}
        counts.append(born)
        gains.append(np.zeros(len(born)))
        begins.append(start)
        again = np.flatnonzero(mixed(born))
        if kept is not None:
            to = np.full(len(born) + 1, -1, np.int64)
            to[again] = np.arange(len(again))
            for block in kept:
                x, rows, y, w, s = block
                node = nodes[s]
                child = tree["left"][node] + (x[rows * p + tree["feature"][node]] > tree["cut"][node])
                s = to[np.maximum(child - start, -1)]  # the last is -1
                use = np.flatnonzero(s >= 0)
                block[1:] = rows[use], y[use], w[use], s[use]
        nodes, total = start + again, born[again]
    return _pruned(tree, np.concatenate(counts), np.concatenate(gains), begins, p)


def _pruned(tree: dict, counts: np.ndarray, gains: np.ndarray, begins: list[int], p: int) -> dict:
    """Leaves of the same parent and the same class merge, from the ends up; what is cut off goes."""
    n = len(counts)
    said, itself = counts.argmax(1), np.arange(n)
    left, cut = tree["left"].copy(), tree["cut"].copy()
    for a, z in reversed(list(zip(begins, [*begins[1:], n]))):
        inner = a + np.flatnonzero(left[a:z] != itself[a:z])
        one, two = left[inner], left[inner] + 1
        merged = inner[(left[one] == one) & (left[two] == two) & (said[one] == said[two])]
        left[merged], cut[merged] = merged, 255
    inner = np.flatnonzero(left != itself)
    stays = np.zeros(n, bool)
    stays[0] = stays[left[inner]] = stays[left[inner] + 1] = True
    new = np.cumsum(stays) - 1
    share = counts / np.maximum(counts.sum(1), 1e-300)[:, None]
    share[inner] = 0.0
    value = np.bincount(tree["feature"][inner], gains[inner], p)
    return {"feature": np.where(left != itself, tree["feature"], 0)[stays].astype(np.int32), "cut": cut[stays], "left": new[left[stays]].astype(np.int32), "share": share[stays], "importance": value / value.sum() if value.sum() else value}


class Forest:
    """Trees in the table at `path`, one row each."""

    def __init__(self, spark: SparkSession, path: str, features: list[str], labels: list[str], cuts: Cuts, depth: int):
        self.spark, self.path, self.features, self.labels, self.cuts, self.depth = spark, path, features, labels, cuts, depth

    def importances(self) -> list[float]:
        """Means of the trees' importances, scaled to sum 1."""
        total = np.zeros(len(self.features))
        for part in _parts(self.path, ["importance"], 16):
            for one in part.column("importance"):
                total += np.frombuffer(one.as_py())
        return [float(v) for v in total / (total.sum() or 1.0)]

    def transform(self, frame: DataFrame, keep: list[str]) -> DataFrame:
        """keep and probability, the mean share of each label in the leaves that a row comes to.

        Rows are dealt with in large numbers, so that a task reads the trees once for each 131,072 rows."""
        path, depth, p, k = self.path, self.depth, len(self.features), len(self.labels)
        edges, names = [np.array(self.cuts[c]) for c in self.features], list(dict.fromkeys(keep))

        def scored(rows: list[pa.RecordBatch], x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            codes = np.concatenate(x).reshape(-1)
            n, trees = len(codes) // p, 0
            out, every = np.zeros((n, k)), np.arange(n)
            for part in _parts(path, ["feature", "cut", "left", "share"], 1):
                tree = {c: _numbers(part.column(c), t) for c, t in (("feature", np.int32), ("cut", np.uint8), ("left", np.int32), ("share", np.float64))}
                out += tree["share"].reshape(-1, k)[_walk(codes, p, every, tree, depth)]
                trees += part.num_rows
            start = 0
            for batch in rows:
                own = out[start : start + batch.num_rows] / trees
                start += batch.num_rows
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, k), pa.int32()), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*names, "probability"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, x, n = [], [], 0
            for batch in batches:
                if batch.num_rows:
                    x.append(_codes(_values(batch, p), edges))
                    rows.append(batch.select(names))
                    n += batch.num_rows
                if n >= 1 << 17:
                    yield from scored(rows, x)
                    rows, x, n = [], [], 0
            if n:
                yield from scored(rows, x)

        ready = frame.select(*names, _array(self.features))
        kind = StructType([*ready.select(*names).schema, StructField("probability", ArrayType(DoubleType()))])
        return ready.mapInArrow(score, kind)


def train(frame: DataFrame, features: list[str], label: str, trees: int, depth: int, seed: int, weight: str | None = None, cuts: Cuts | None = None, labels: list[str] | None = None) -> Forest:
    """A forest of rows whose features have values and whose labels aren't null; `cuts` and `labels` if known."""
    if not features:
        raise ValueError("no feature varies")
    spark, p, rows = frame.sparkSession, len(features), values(frame, features, label, weight)
    if cuts is None or labels is None:
        path = written(rows, "values")
        rows = spark.read.schema(rows.schema).parquet(path)
        labels = labels or sorted(r[0] for r in rows.select("_y").distinct().collect())
        cuts = cuts or thresholds(path, spark, features)
    path = written(_binned(rows, labels, [cuts[c] for c in features]), "binned")
    n = spark.read.parquet(path).count()
    if not n:
        raise ValueError("no rows to learn from")
    holds, classes, start = n * p <= HELD, len(labels), seed % 2**63

    def trees_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            for number in batch.column("id").to_pylist():
                blocks = _held(path, p) if holds and blocks is None else blocks
                grown = grow(blocks, path, p, classes, depth, [start, number], trees > 1)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([number], pa.int64()), **{c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in grown.items()}})

    tasks = min(trees, 2 * _cores(spark))
    dealt = spark.range(0, trees, 1, tasks).mapInArrow(trees_of, "tree long, feature binary, cut binary, left binary, share binary, importance binary")
    return Forest(spark, written(dealt, "trees"), features, labels, cuts, depth)

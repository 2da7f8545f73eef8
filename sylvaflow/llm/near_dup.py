"""Near-duplicate classes by an LSH forest.

Each text's set of five-word shingles gets TREES signatures of DEPTH minima, and each tree puts all
sets in the order of their signatures. The REACH entries before and after a set in each order, those of
longest common prefix, are its candidates, at whatever depth they part: deep where sets crowd, shallow
where they don't. Sets that are equal are one node from the start, so copies never meet in pairs. Each
candidate is confirmed on the full sets before it links.

This joins most sets cheaply and leaves pairs out; an exact pass finds the rest. All shingles are in one order, those
that few texts hold before common ones. Sets of at least the similarity share one of the first
n - ceil(n * percent / 100) + 1 shingles of each, their prefix. The sets whose prefixes hold a shingle are a region, of
any size, and regions with the same least and greatest member are one, since near copies share many shingles: each member outside the region's largest class is compared with all members of other classes, in blocks that
are dealt over tasks. Of these pairs those are candidates whose sketches (parities of 64 * LANES classes of shingles)
differ in no more bits than their sets may in shingles, which loses none. So no link is lost, but for what 64-bit
numbers of shingles allow: sketches of sets over LONG shingles are full, so such pairs need `least_bits` equal one-bit
minima besides, as all but one in 10**10 links have.

A neighbour is only read in full if so many of the TREES * DEPTH one-bit minima agree as all but one in
10**5 pairs at the threshold do (the expected number less six deviations, 53 of 72 at 0.85), and if the sketches allow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.graphs import components
from sylvaflow.llm.tables import small, stored
from sylvaflow.llm.text import Words, by_bytes, distinct, list_array, shingles

TREES, DEPTH = 12, 6
#: Neighbours looked at first before each entry of an order; prefixes find what they leave.
REACH = 2
#: Bits of a sketch: lanes of 64.
LANES = 16
#: Shingles beyond which a sketch no longer tells sets apart.
LONG = 2048
#: Bits of a shingle that number its bucket, where texts with it are counted to put common ones last.
BUCKET_BITS = 20
#: Members outside the largest class, and members of all, that meet in one block.
FEW_BLOCK, ALL_BLOCK = 1024, 4096
#: Pairs compared at once, and the members that one meets besides.
STEP = 1 << 14
#: Keys that the pairs of one hot node are spread over.
SALTS = 64
#: Nodes with candidates whose ids are broadcast at most; more are joined with the texts by a shuffle.
FEW_ENDS = 1 << 20

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_bits(percent: int, deviations: int = 6) -> int:
    """One-bit minima that two texts at the threshold share at least, but for one pair in 10**5 (eight deviations: 10**10)."""
    n, p = TREES * DEPTH, (1 + percent / 100) / 2
    return max(int(n * p - deviations * (n * p * (1 - p)) ** 0.5), 0)


def signatures(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minima (rows x TREES * DEPTH, uint32) of each row's shingles; rows have one at least."""
    out = np.zeros((len(start) - 1, TREES * DEPTH), np.uint32)
    if not len(out):
        return out
    with np.errstate(over="ignore"):
        for i, (x, m) in enumerate(zip(_XOR, _MUL)):
            high = ((values ^ x) * m).view(np.uint32)[1::2]
            out[:, i] = np.minimum.reduceat(high, start[:-1])
    return out


def _node(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number for each row's set: the sum of its values, 0 for an empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[start[1:]] - total[start[:-1]]).view(np.int64)


def sketches(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Parities (rows x LANES, uint64) of how many of each row's sorted values fall in each of 64 * LANES classes."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    lane = row * LANES + (values >> np.uint64(60)).astype(np.int64)
    out = np.zeros((len(start) - 1) * LANES, np.uint64)
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        out[lane[first]] = np.bitwise_xor.reduceat(np.uint64(1) << ((values >> np.uint64(54)) & np.uint64(63)), first)
    return out.reshape(-1, LANES)


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets with over twice a task's mean of shingles, and their shingles."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for part in by_bytes(batch, "text"):
            words = Words(part.column("text"))
            values, _ = distinct(*shingles(words.hash, words.first))
            total += np.bincount(_bucket(values), minlength=len(total))
    found = np.flatnonzero(total > 2 * total.mean() + 8)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])


def _levels(rows: DataFrame) -> np.ndarray:
    """How common the shingles of each bucket are, as a power of two: 0 for most. Only the order of shingles depends on
    it, so any numbers give the same links; one byte a bucket, whatever the input, goes to the tasks."""
    found = rows.select("text").mapInArrow(_crowded, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    levels[found.column("bucket").to_numpy()] = np.log2(found.column("n").to_numpy()).astype(np.uint8) + 1
    return levels


def prefixes(values: np.ndarray, start: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(n * percent / 100) + 1 of each row's n values in the order of (level, value), and the first of
    each row. Rows of at least this similarity share one."""
    size = np.diff(start)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((values, levels[_bucket(values)], row))
    length = np.minimum(size, size - -(-size * percent // 100) + 1)
    keep = np.arange(len(values)) - start[row] < length[row]
    return values[order][keep], np.concatenate([[0], np.cumsum(length)])


def _sets(percent: int, levels: np.ndarray):
    """Rows of (doc_id, n, node, m0, m1, keys, sketch, prefix)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                words = Words(part.column("text"))
                values, start = distinct(*shingles(words.hash, words.first))
                size = np.diff(start)
                some = np.flatnonzero(size)
                node = _node(values, start)
                marks = np.zeros((len(size), 2), np.int64)
                keys = [None] * len(size)
                if len(some):
                    first = np.append(start[some], start[-1])
                    minima = signatures(values, first)
                    bits = np.packbits((minima & 1).astype(np.uint8), axis=1)
                    marks[some, 0], marks[some, 1] = bits[:, :8].copy().view(np.int64)[:, 0], bits[:, 8]
                    flat = minima.astype(">u4").tobytes()
                    width = 4 * TREES * DEPTH
                    for k, row in enumerate(some):
                        keys[row] = flat[k * width : (k + 1) * width]
                flat, wide = sketches(values, start).tobytes(), 8 * LANES
                sketch = pa.array([flat[k * wide : (k + 1) * wide] for k in range(len(size))], pa.binary())
                head, at = prefixes(values, start, levels, percent)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(node), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(keys, pa.binary()), sketch, list_array(head.view(np.int64), at, pa.int64())],
                    ["doc_id", "n", "node", "m0", "m1", "keys", "sketch", "prefix"],
                )

    return read


def _neighbours(percent: int):
    """Pairs of entries at most REACH apart in an order, with a common prefix, sizes that allow the
    similarity and enough equal bits. Only the last REACH entries are carried from batch to batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 * DEPTH
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy()
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, width // 4)
            marks = np.stack([batch.column(c).to_numpy() for c in ("m0", "m1")], axis=1)
            here = (tree, node, n, key, marks)
            if left is not None:
                here = tuple(np.concatenate([a, b]) for a, b in zip(left, here))
            tree, node, n, key, marks = here
            found = []
            for d in range(1, REACH + 1):
                if len(node) <= d:
                    break
                a, b = slice(0, -d), slice(d, None)
                small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                same = TREES * DEPTH - np.bitwise_count((marks[a] ^ marks[b]).view(np.uint64)).sum(1, dtype=np.int64)
                ok = (tree[a] == tree[b]) & (key[a][:, 0] == key[b][:, 0]) & (100 * small >= percent * large) & (node[a] != node[b]) & (same >= least_bits(percent))
                found.append((np.minimum(node[a], node[b])[ok], np.maximum(node[a], node[b])[ok], same[ok]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], ["a", "b", "same"])
            left = tuple(x[-REACH:] for x in here)

    return scan


def _confirm(percent: int):
    """Pairs (a, b) of nodes whose texts are similar enough. A text that is not of its node (another row with
    the same id) confirms nothing."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text_a"):
                sides = []
                for c in ("text_a", "text_b"):
                    words = Words(part.column(c))
                    sides.append(distinct(*shingles(words.hash, words.first)))
                (x, sx), (y, sy) = sides
                own = [_node(v, s) == part.column(c).to_numpy() for (v, s), c in zip(sides, ("a", "b"))]
                linked = []
                for i in range(part.num_rows):
                    p, q = x[sx[i] : sx[i + 1]], y[sy[i] : sy[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    linked.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
                keep = pa.array(np.array(linked, bool) & own[0] & own[1])
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return check


def _far_bits(percent: int, n: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of two sets at the threshold differ at most, n being the sum of their sizes."""
    return (100 - percent) / (100 + percent) * n + 1e-9


def _possible(percent: int):
    """Those of pairs (a, b, same) whose sketches allow the similarity; same less the bits in which they differ."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, LANES) for c in ("sketch_a", "sketch_b"))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            ok = apart <= _far_bits(percent, batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy())
            a, b, same = (batch.column(c).to_numpy()[ok] for c in ("a", "b", "same"))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(same - apart[ok])], ["a", "b", "same"])

    return check


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, same) of neighbours whose sketches allow the similarity, so few texts go to be confirmed."""
    key = F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(keys, t * {4 * DEPTH} + 1, {4 * DEPTH}))")
    entries = nodes.select("node", "n", "m0", "m1", F.posexplode(key).alias("tree", "key"))
    order = entries.select("tree", "key", "node", "n", "m0", "m1").repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = order.mapInArrow(_neighbours(percent), "a long, b long, same long").groupBy("a", "b").agg(F.max("same").alias("same"))
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    return stored(found.join(of("a"), "a").join(of("b"), "b").mapInArrow(_possible(percent), "a long, b long, same long"), "pairs")


def _members(known: DataFrame) -> DataFrame:
    """(region, node) of every shingle that the prefixes of two different sets hold, and every set with it. Shingles with
    the same least and greatest set make one region with the sets of all: that adds pairs and leaves out none, and a
    set's sketch goes to one region for all shingles that it shares with the same others."""
    placed = known.select(F.explode("prefix").alias("shingle"), "node")
    shared = placed.groupBy("shingle").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    regions = stored(shared.select("shingle", F.xxhash64("least", "most").alias("region")), "regions")
    return stored(placed.join(small(regions), "shingle").select("region", "node").distinct(), "members")


def _joined(part: DataFrame, links: DataFrame) -> DataFrame:
    """part(node, root) after links(a, b), which join the classes of their ends."""
    of = lambda c: part.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    more = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    upper = components(more.select(F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v")))
    above = upper.select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = part.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return stored(moved.unionByName(upper.join(part, "node", "left_anti").select("node", "root")), "classes")


def _meet(percent: int):
    """Pairs of each run of (region, i, j): its members outside the largest class (first in it) with those of other
    classes, of sizes, bits and sketches that allow the similarity. Runs are met together, STEP pairs at a time."""
    keys, least = ("region", "i", "j"), least_bits(percent, 8)

    def pairs(runs: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, node, root, n = (runs.column(c).to_numpy() for c in ("kind", "node", "root", "n"))
        marks = np.stack([runs.column(c).to_numpy() for c in ("m0", "m1")], axis=1)
        sketch = np.frombuffer(b"".join(runs.column("sketch").to_pylist()), np.uint64).reshape(-1, LANES)
        few = np.add.reduceat((kind == 0).astype(np.int64), cuts[:-1])
        mine, run = np.flatnonzero(kind == 0), np.repeat(np.arange(len(few)), few)
        start, count = (cuts[:-1] + few)[run], (np.diff(cuts) - few)[run]
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(mine):
            end = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
            own = count[at:end]
            k = np.repeat(mine[at:end], own)
            to = np.repeat(start[at:end] - (total[at:end] - total[at]), own) + np.arange(total[end] - total[at])
            at = end
            small, large = np.minimum(n[k], n[to]), np.maximum(n[k], n[to])
            # kind 2 is outside the largest class too and comes to meet this one as well
            ok = (100 * small >= percent * large) & (root[k] != root[to]) & ((kind[to] == 1) | (node[to] > node[k]))
            k, to, small = k[ok], to[ok], small[ok]
            same = TREES * DEPTH - np.bitwise_count((marks[k] ^ marks[to]).view(np.uint64)).sum(1, dtype=np.int64)
            apart = np.bitwise_count(sketch[k] ^ sketch[to]).sum(1, dtype=np.int64)
            ok = (apart <= _far_bits(percent, n[k] + n[to])) & ((same >= least) | (small <= LONG))
            if ok.any():
                a, b = node[k[ok]], node[to[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((same - apart)[ok])], ["a", "b", "same"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            key = np.stack([rows.column(c).to_numpy() for c in keys], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
            if cuts[-1]:
                yield from pairs(rows.slice(0, int(cuts[-1])), cuts)
            held = [rows.slice(int(cuts[-1]))]
        if held:
            yield from pairs(held[0], np.array([0, held[0].num_rows]))

    return scan


def _left(members: DataFrame, nodes: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """(a, b, same) of all pairs of different classes of part that share a region and may be similar enough."""
    now = members.join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = now.groupBy("region", "root").agg(F.count("*").alias("k"))
    state = classes.groupBy("region").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("size"), F.count("*").alias("classes"))
    blocks = [F.ceil((F.col("size") - F.col("most")) / FEW_BLOCK).cast("int").alias("fews"), F.ceil(F.col("size") / ALL_BLOCK).cast("int").alias("alls")]
    state = stored(state.filter("classes > 1").select("region", "main", *blocks), "regions")
    now = now.join(small(state), "region").join(nodes.select("node", "n", "m0", "m1", "sketch"), "node")
    outside, rest = F.col("root") != F.col("main"), ["region", "node", "root", "n", "m0", "m1", "sketch"]
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kind = F.when(outside, 2).otherwise(1)
    first = now.filter(outside).select(*rest, F.lit(0).alias("kind"), mine("fews").alias("i"), every("alls").alias("j"))
    second = now.select(*rest, kind.alias("kind"), every("fews").alias("i"), mine("alls").alias("j"))
    runs = first.unionByName(second).repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "kind")
    found = runs.mapInArrow(_meet(percent), "a long, b long, same long")
    return stored(found.groupBy("a", "b").agg(F.max("same").alias("same")), "pairs")


def _linked(rows: DataFrame, nodes: DataFrame, part: DataFrame | None, pairs: DataFrame, percent: int) -> DataFrame:
    """part after those of pairs(a, b, same) that full sets confirm: the likeliest pair of each node first, then only
    pairs between classes not yet joined."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ends = stored(ends.join(nodes.select("node", "doc_id"), "node"), "ends")
    texts = stored(rows.join(small(ends, FEW_ENDS), "doc_id").select("node", "text"), "texts", "zstd")

    def confirmed(asked: DataFrame) -> DataFrame:
        salt = F.pmod("b", F.lit(SALTS)).alias("salt")
        first = asked.select("a", "b", salt).join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        copies = asked.select("a", salt).distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = first.join(copies, ["a", "salt"]).select("a", "b", "text_a", "text_b")
        return stored(both.mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")

    best = pairs.groupBy("b").agg(F.max(F.struct("same", "a")).alias("s")).select("s.a", "b")
    links = confirmed(best)
    part = _joined(part, links) if part is not None else stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "classes")
    of = lambda c: part.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = stored(rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    return part if rest.isEmpty() else _joined(part, confirmed(rest))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text).

    Two texts link where 100 * intersection >= percent * union of their sets of five-word shingles
    (fewer words: the whole sequence is the set). component_id is the least doc_id reachable, kept
    says that it is the row's own. Null, empty and wordless texts link with nothing. A row without
    doc_id is not linked: component_id null, kept true. Rows that repeat an id stay, each with the
    class of its own text. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = _sets(percent, _levels(rows))
    sets = stored(rows.mapInArrow(read, "doc_id long, n long, node long, m0 long, m1 long, keys binary, sketch binary, prefix array<long>"), "sets")
    known = sets.filter("n > 0 and doc_id is not null")
    nodes = stored(known.groupBy("node").agg(F.min(F.struct("doc_id", "n", "m0", "m1", "keys", "sketch")).alias("s")).select("node", "s.*"), "nodes")
    part = _linked(rows, nodes, None, _candidates(nodes, percent), percent)
    left = _left(_members(known), nodes, part, percent)
    if not left.isEmpty():
        part = _linked(rows, nodes, part, left, percent)
    rooted = nodes.join(part, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.join(least, "root").select("node", "component_id")
    out = sets.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("node")).alias("node")).join(classes, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that represent their class: those with its least doc_id. Of rows that
    repeat an id one stays; rows without id all stay, as do texts without shingles."""
    found = stored(near_duplicates(docs, percent).select("doc_id", "kept"), "verdicts")
    gone = stored(found.filter("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)

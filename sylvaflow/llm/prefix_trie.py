"""Conversation prefix trie: which conversations share their first turns, and what reuse of these saves.

A node is a sequence of turns; its name is a pair of 64-bit polynomial hashes over the turns' MD5 sums. The hash
of a prefix is a running sum, so turns sorted by conversation are hashed piece by piece, whatever task holds them:
a conversation may be of any length and lie over many tasks, and only one row a task passes the driver.

Each task combines its turns into a partial trie, a table of node, members and ends. Partial tries merge by
adding the rows of equal nodes. The rollup runs from the ends up: a member that isn't its node's first adds the
code points from that node down to the last node that it shares with an earlier one. As members meet at every
ancestor, one merge by node gives the sums of whole subtrees, however deep they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.tables import stored

#: Fixed values of the task: conversations of a hundred share the turns of its first, at most LIMIT - 1 of them.
HUNDRED, LIMIT = 100, 6
_R = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BACK = tuple(np.uint64(pow(int(r), -1, 1 << 64)) for r in _R)
#: Rows combined into one partial trie, and ids in one piece of a list of ends.
TRIE_ROWS, PIECE = 500_000, 1_000
_SORTED = "last boolean, part int, conv_id long, n long, p1 long, p2 long, t1 long, t2 long, c long, chars long"
_REBUILT = "conv_id long, depth long, a long, b long, pa long, pb long, c long, chars long, ends boolean"
_NODE = "a long, b long, pa long, pb long, depth long, chars long, n_convs long, conv_id long, n_ends long"


class _Powers:
    """Powers of an odd number modulo 2**64 by two tables, one of the low 16 bits of the exponent."""

    def __init__(self, base: np.uint64):
        self.base, self.low, self.high = base, self._run(base), {}

    @staticmethod
    def _run(base: np.uint64) -> np.ndarray:
        factors = np.full(1 << 16, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    def __call__(self, exponent: np.ndarray) -> np.ndarray:
        top, index = np.unique(exponent >> 16, return_inverse=True)
        large = np.array([pow(int(self.base), int(k) << 16, 1 << 64) for k in top], np.uint64)
        return self.low[exponent & 0xFFFF] * large[index]


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, hash and count the turns of each conversation from where this task begins with it. A last
    row tells the totals of the task's last conversation, and its first one's id as t1."""
    part, powers = TaskContext.get().partitionId(), [_Powers(r) for r in _R]
    first, conv, n, sums, c = None, None, 0, [np.uint64(0)] * 2, 0
    names = [x.split()[0] for x in _SORTED.split(", ")]
    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, chars = (batch.column(k).to_numpy() for k in ("conv_id", "chars"))
            marks = np.frombuffer(b"".join(batch.column("mark").to_pylist()), "<u8").reshape(-1, 2)
            first = int(ids[0]) if first is None else first
            goes_on = conv is not None and ids[0] == conv
            start = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
            number = np.arange(len(ids)) - start[run] + 1 + np.where(run == 0, n if goes_on else 0, 0)

            def running(values, carried):
                total = np.cumsum(values)
                before = np.concatenate([np.zeros(1, values.dtype), total])[start]
                before[0] -= carried if goes_on else values.dtype.type(0)
                return total - before[run]

            terms = [marks[:, k] * powers[k](number - 1) for k in (0, 1)]
            prefix = [running(terms[k], sums[k]) for k in (0, 1)]
            length = running(chars.astype(np.int64), np.int64(c))
            conv, n, sums, c = int(ids[-1]), int(number[-1]), [p[-1] for p in prefix], int(length[-1])
            head = [pa.array(np.zeros(len(ids), bool)), pa.array(np.full(len(ids), part, np.int32))]
            yield pa.RecordBatch.from_arrays([*head, *_longs(ids, number, *prefix, *terms, length, chars)], names)
        if conv is not None:
            tail = _longs(*(np.array([v]) for v in (conv, n, *sums, first, 0, c, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([part], pa.int32()), *tail], names)


def _carried(rows: list) -> dict[int, tuple]:
    """What each task's first conversation has before that task: part to (conv_id, turns, hashes, code points)."""
    out, before = {}, None
    for r in sorted(rows, key=lambda r: r.part):
        n, p, c = r.n, [r.p1 % 2**64, r.p2 % 2**64], r.c
        if before and before[0] == r.t1:
            out[r.part] = before
            if r.conv_id == r.t1:
                p = [(q + pow(int(base), before[1], 2**64) * x) % 2**64 for q, base, x in zip(before[2], _R, p)]
                n, c = n + before[1], c + before[3]
        before = (r.conv_id, n, p, c)
    return out


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2, t1, t2, c, chars) of each turn: its number, the hashes of the turns up to it, its
    own terms of these, the code points up to it and its own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), mark.alias("mark"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), *(F.col(k).asc() for k in ("role", "head", "mark", "at"))]
    pieces = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_hashed, _SORTED), "turns")
    before = _carried(pieces.filter("last").collect())  # a row a task

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids, n, p1, p2, t1, t2, c, chars = (batch.column(k).to_numpy() for k in range(1, 10))
            n, c, lanes = n.copy(), c.copy(), [v.astype(np.uint64) for v in (p1, p2, t1, t2)]
            with np.errstate(over="ignore"):
                for k in set(np.unique(part).tolist()) & before.keys():
                    conv, turns, hashes, length = before[k]
                    rows = np.flatnonzero((part == k) & (ids == conv))
                    n[rows] += turns
                    c[rows] += length
                    for j, v in enumerate(lanes):
                        v[rows] = v[rows] * np.uint64(pow(int(_R[j % 2]), turns, 2**64)) + np.uint64(hashes[j] if j < 2 else 0)
            yield pa.RecordBatch.from_arrays(_longs(ids, n, *lanes, c, chars), ["conv_id", "n", "p1", "p2", "t1", "t2", "c", "chars"])

    return pieces.filter("not last").mapInArrow(whole, "conv_id long, n long, p1 long, p2 long, t1 long, t2 long, c long, chars long")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and parent of each rebuilt turn: the base's hashes before, the own ones shifted to follow them."""
    names = [x.split()[0] for x in _REBUILT.split(", ")]
    for batch in batches:
        get = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
        out, up, shift = [], [], get("shift")
        with np.errstate(over="ignore"):
            for k in (0, 1):
                scale = np.array([pow(int(_BACK[k]), -s, 2**64) if s < 0 else 1 for s in range(1 - LIMIT, 1)], np.uint64)[shift + LIMIT - 1]
                p, t, base, own = (get(f"{v}{k + 1}").astype(np.uint64) for v in ("p", "t", "base", "own"))
                out.append(base + scale * (p - own))
                up.append(out[-1] - scale * t)
        yield pa.RecordBatch.from_arrays([*_longs(get("conv_id"), get("depth"), *out, *up, get("c"), get("chars")), pa.array(get("ends"))], names)


def _rebuilt(turns: DataFrame) -> DataFrame:
    """A row for each depth of each rebuilt conversation, the root's included, with its node and parent."""
    head = F.struct("n", "p1", "p2", "t1", "t2", "c", "chars")
    own = stored(turns.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.sort_array(F.collect_list(F.when(F.col("n") < LIMIT, head))).alias("heads")), "heads")
    h = (F.crc32(F.col("conv_id").cast("string")) % LIMIT).cast("int")
    base = own.filter(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.col("heads").alias("taken"))
    met = own.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % HUNDRED == F.col("base"), "left")
    met = met.withColumn("taken", F.when(F.col("h") == 0, F.array().cast(own.schema["heads"].dataType)).otherwise(F.slice(F.coalesce("taken", F.array()), 1, F.greatest("h", F.lit(1)))))
    met = met.withColumn("k", F.size("taken")).withColumn("total", F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("n_turns") - F.col("h")))

    at = lambda array, number, field: F.coalesce(F.try_element_at(array, F.greatest(number, F.lit(1)))[field] * F.when(number > 0, 1).otherwise(0), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    plain = [zero.alias(k) for k in ("base1", "base2", "own1", "own2")]
    root = met.select("conv_id", zero.alias("depth"), *(zero.alias(k) for k in ("p1", "p2", "t1", "t2", "c", "chars")), *plain, F.lit(0).alias("shift"), (F.col("total") == 0).alias("ends"))
    taken = met.select("conv_id", "total", F.explode("taken").alias("e")).select("conv_id", F.col("e.n").alias("depth"), *(f"e.{k}" for k in ("p1", "p2", "t1", "t2", "c", "chars")), *plain, F.lit(0).alias("shift"), (F.col("e.n") == F.col("total")).alias("ends"))
    each = met.filter("n_turns > h").select("conv_id", "total", F.col("k").alias("k"), F.col("h"), *(at("taken", F.col("k"), f).alias(x) for f, x in (("p1", "base1"), ("p2", "base2"), ("c", "base_c"))), *(at("heads", F.col("h"), f).alias(x) for f, x in (("p1", "own1"), ("p2", "own2"), ("c", "own_c"))))
    after = turns.filter(F.col("n") > h).join(each, "conv_id")
    depth = F.col("n") - F.col("h") + F.col("k")
    rest = after.select("conv_id", depth.alias("depth"), "p1", "p2", "t1", "t2", (F.col("base_c") + F.col("c") - F.col("own_c")).alias("c"), "chars", "base1", "base2", "own1", "own2", (F.col("k") - F.col("h")).alias("shift"), (depth == F.col("total")).alias("ends"))
    return stored(root.union(taken).union(rest).mapInArrow(_named, _REBUILT), "rebuilt")


def _partial_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows as tables of distinct nodes with members, ends and the least member."""

    def combined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        a, b, conv, ends = (table[k].to_numpy() for k in ("a", "b", "conv_id", "ends"))
        order = np.lexsort((conv, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        start = np.flatnonzero(new)
        top = table.select(["a", "b", "pa", "pb", "depth", "chars", "conv_id"]).take(order[start]).combine_chunks()
        counts = [np.diff(np.append(start, len(order))), np.add.reduceat(ends[order].astype(np.int64), start)]
        columns = [top[k].combine_chunks() for k in ("a", "b", "pa", "pb", "depth", "chars")] + [pa.array(counts[0]), top["conv_id"].combine_chunks(), pa.array(counts[1])]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _NODE.split(", ")])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= TRIE_ROWS:
            yield combined(held)
            held, n = [], 0
    if held:
        yield combined(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv_id) as pieces of each node's list of ends, written out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.arange(1, len(a)) % PIECE == 0)) + 1
        start = np.concatenate([[0], cut])
        text = [",".join(map(str, ids[s:e].tolist())).encode() for s, e in zip(start, np.append(cut, len(a)))]
        yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(ids[start]), pa.array(text, pa.binary())], ["a", "b", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order; one piece is held at a time."""
    names, node, state = ["a", "b", "digest"], None, None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)

    for batch in batches:
        done = []
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (a, b) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_buffer())
        yield out(done)
    if node:
        yield out([(*node, state.hexdigest())])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    A conversation's turns are ordered by turn, null first; equal ones by role, then by the first 64 code points
    of the text, then by the MD5 sum of role and text, so that turns of one place that differ have one order, and
    repeated rows are turns of their own. Null roles and texts are empty; rows without a conv_id are left out.
    Texts of any length count whole; only their first 64 code points and sums are shuffled. Conversations of any
    number of turns, and nodes with any number of members, are split over tasks. Only the SHA-256 of one node's
    list of ends runs in one task, in constant memory, as each step needs the one before. Without conversations
    the result is empty. Other columns are ignored, whatever their names.
    """
    rows = _rebuilt(_numbered(conversations.select("conv_id", "turn", "role", "text")))
    partial = rows.mapInArrow(_partial_trie, _NODE)
    key = ["a", "b"]
    merged = partial.groupBy(*key).agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends"))
    nodes = stored(merged, "nodes")
    shared = nodes.filter("n_convs > 1")

    hit = stored(rows.join(shared.select(*key, F.col("conv_id").alias("least")), key), "shared")
    later = hit.filter("conv_id > least").select("conv_id", F.col("c").alias("upto"), F.lit(0).alias("leaf"))
    leaves = nodes.filter("n_ends = n_convs").select("conv_id", F.lit(None).cast("long").alias("upto"), F.lit(1).alias("leaf"))
    member = later.union(leaves).groupBy("conv_id").agg(F.max("upto").alias("upto"), F.max("leaf").alias("leaf"))  # code points never fall with depth
    saved = F.when(F.col("conv_id") > F.col("least"), F.col("upto") - F.col("c") + F.col("chars")).otherwise(F.lit(0).cast("long"))
    given = hit.join(member, "conv_id", "left").select(*key, saved.alias("saved"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"), F.lit(0).cast("long").alias("child"))
    children = nodes.filter("depth > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"), *(F.lit(v).cast("long").alias(k) for k, v in (("saved", 0), ("leaf", 0), ("child", 1))))
    rolled = given.union(children).groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))

    several = nodes.filter("n_ends > 1").select(*key)
    ends = hit.filter("ends").join(several, key, "leftsemi").select(*key, "conv_id")
    order = [*key, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "a long, b long, first long, text binary")
    digests = pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "a long, b long, digest string")
    one_end = hit.filter("ends").join(shared.filter("n_ends = 1").select(*key), key, "leftsemi").select(*key, F.col("conv_id").alias("one"))

    none = F.sha2(F.lit(""), 256)
    alone = nodes.filter("n_convs = 1").select(*key, "pa", "pb", "depth", "conv_id", "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("n_ends") == 1, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    together = shared.join(rolled, key).join(digests, key, "left").join(one_end, key, "left")
    together = together.select(*key, "pa", "pb", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.sha2(F.col("one").cast("string"), 256), none).alias("ends_sha256"))
    parent = shared.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    found = alone.union(together).join(parent, ["pa", "pb"], "left")
    above = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return found.select("conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: DuckDB's form, for tables in which a sequence of turns can be held as one text. It computes CRC-32 bit by bit.
TRIE_SQL = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS j
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base,
           xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT),
               lambda acc, byte: list_reduce([xor(acc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
    FROM ids
), r AS (
    SELECT c.conv_id, 0 AS own, j, role, body FROM c JOIN t ON t.conv_id = c.base AND t.j <= c.h
    UNION ALL SELECT c.conv_id, 1, j, role, body FROM c JOIN t ON t.conv_id = c.conv_id AND t.j > c.h
), d AS (
    SELECT conv_id, row_number() OVER w AS depth, length(body) AS chars,
           md5(string_agg(length(role) || ':' || role || length(body) || ':' || body, '') OVER w) AS node
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, j ROWS UNBOUNDED PRECEDING)
), m AS (SELECT * FROM d UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
last AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS (
    SELECT node, min(m.conv_id) AS conv_id, any_value(m.depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs,
           sha256(coalesce(string_agg(CASE WHEN last.depth = m.depth THEN m.conv_id END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
    FROM m JOIN last USING (conv_id) GROUP BY node
), p AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent),
under AS (
    SELECT m.node, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves
    FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN kids ON kids.node = n.node GROUP BY m.node
)
SELECT p.conv_id, CAST(p.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, p.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, p.ends_sha256
FROM p JOIN under USING (node) LEFT JOIN kids USING (node) LEFT JOIN n AS up ON up.node = p.parent
"""

"""Token ids in patched frame-of-reference blocks.

A segment is one row: the ids of a run of documents, cut into blocks of BLOCK ids. Of
each block the minimum is subtracted and what is left is packed at the width that a
percentile of it needs; wider values keep their low bits there and go, whole, into the
block's exception list. The segment indexes where each block starts in the payload and
where each document starts among the ids, so one document is read without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvaflow.llm.encoding import encoder
from sylvaflow.llm.text import by_bytes

BLOCK = 512
#: Share of a block's values that must fit the packed width.
PERCENTILE = 95
#: Values of a block that are packed side by side: value k stands in lane k % LANES, and each lane fills 32-bit words.
LANES = 16
SEGMENTS = (
    "part int, seq int, doc_ids array<long>, doc_sizes array<int>, n_ids long, "
    "base array<int>, width array<int>, at array<int>, exceptions array<int>, payload binary"
)
READ = "doc_id long, part int, seq int, offset long, n_tokens long, ids_crc32 long"


def _fields(width: int) -> list[tuple[int, int, int]]:
    """(place in a lane, word, shift) of each of a lane's values."""
    return [(j, j * width // 32, j * width % 32) for j in range(BLOCK // LANES)]


def pack(ids: np.ndarray) -> dict:
    """Blocks of uint32 ids: base, width, at (first byte of each block, and the end), exceptions, payload."""
    n = -(-len(ids) // BLOCK)
    grid = np.zeros((n, BLOCK), np.uint32)
    grid.reshape(-1)[: len(ids)] = ids
    if tail := n * BLOCK - len(ids):
        grid[-1, -tail:] = grid[-1, : BLOCK - tail].min()
    base = grid.min(1) if n else np.zeros(0, np.uint32)
    grid -= base[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    cut = np.partition(grid, rank, axis=1)[:, rank] if n else base
    width = np.frexp(cut.astype(np.float64))[1].astype(np.int64)
    chunks: list[bytes] = [b""] * n
    exceptions = np.zeros(n, np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        values = grid[rows]
        wide = values >= np.uint64(1 << w)
        low = (values & np.uint32((1 << w) - 1)).reshape(len(rows), -1, LANES)
        words = np.zeros((len(rows), w, LANES), np.uint32)
        for j, word, shift in _fields(w) if w else ():
            words[:, word] |= low[:, j] << np.uint32(shift)
            if shift + w > 32:
                words[:, word + 1] |= low[:, j] >> np.uint32(32 - shift)
        row, where = np.nonzero(wide)
        number = wide.sum(1)
        exceptions[rows] = number
        where, outside = where.astype("<u2"), values[row, where].astype("<u4")
        ends = np.cumsum(number).tolist()
        for k, (at, begin, end) in enumerate(zip(rows.tolist(), [0, *ends], ends)):
            chunks[at] = words[k].tobytes() + where[begin:end].tobytes() + outside[begin:end].tobytes()
    at = np.zeros(n + 1, np.int64)
    np.cumsum([len(c) for c in chunks], out=at[1:])
    return {"base": base.astype(np.int64), "width": width, "at": at, "exceptions": exceptions, "payload": b"".join(chunks)}


def unpack(n_ids: int, base, width, at, exceptions, payload: bytes) -> np.ndarray:
    """The ids of a segment again."""
    base, width, at, exceptions = (np.asarray(x, np.int64) for x in (base, width, at, exceptions))
    grid = np.zeros((len(base), BLOCK // LANES, LANES), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            words = np.stack([np.frombuffer(payload, "<u4", w * LANES, a) for a in at[rows].tolist()]).reshape(len(rows), w, LANES)
            values, mask = np.zeros((len(rows), BLOCK // LANES, LANES), np.uint32), np.uint32((1 << w) - 1)
            for j, word, shift in _fields(w):
                values[:, j] = words[:, word] >> np.uint32(shift)
                if shift + w > 32:
                    values[:, j] |= words[:, word + 1] << np.uint32(32 - shift)
            grid[rows] = values & mask
    flat = grid.reshape(-1, BLOCK)
    for row in np.flatnonzero(exceptions).tolist():
        k, begin = int(exceptions[row]), int(at[row]) + BLOCK * int(width[row]) // 8
        flat[row, np.frombuffer(payload, "<u2", k, begin)] = np.frombuffer(payload, "<u4", k, begin + 2 * k)
    flat += base.astype(np.uint32)[:, None]
    return flat.reshape(-1)[:n_ids]


def encoded(code, texts: pa.RecordBatch, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with end_id after each, and how many each has; only about SLICE_BYTES of text are encoded at
    once, as the encoder's working arrays are many times their text."""
    ids, sizes = [], []
    for rows in by_bytes(texts, "text"):
        own, start = code.encode(rows.column("text"))
        ids.append(np.insert(own, start[1:], end_id))
        sizes.append(np.diff(start) + 1)
    return np.concatenate(ids), np.concatenate(sizes)


def write_blocks(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, segment_bytes: int = 4 << 20) -> None:
    """Writes docs(doc_id, text) to `path`, in ascending doc_id over files and within them.

    Documents are dealt out by ranges of (doc_id, text), sorted, encoded and packed; a null
    text has the end id alone. Rows are put in order of text where an id repeats; a null id
    comes first. An empty table makes an empty dataset.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ints = pa.list_(pa.int32())
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", ints), ("n_ids", pa.int64()), ("base", ints), ("width", ints), ("at", ints), ("exceptions", ints), ("payload", pa.binary())])
        for batch in batches:
            for rows in by_bytes(batch, "text", segment_bytes):
                ids, sizes = encoded(code, rows, end_id)
                row = {"part": part, "seq": seq, "doc_ids": rows.column("doc_id").to_pylist(), "doc_sizes": sizes.tolist(), "n_ids": len(ids), **pack(ids)}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
                seq += 1
                del ids, sizes, row
                pa.default_memory_pool().release_unused()  # the worker's earlier stages leave some, too

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENTS).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A segment's place follows from the sizes of those before it: of its part's segments, and of the
    parts before. Running sums take two passes for that, so no task sees more than the segments of one
    part or one row a part (as many as the writing job had tasks, whatever the input).
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                field = lambda c: batch.column(c)[k]  # noqa: B023, E731
                listed = lambda c: field(c).values.to_numpy(zero_copy_only=False)
                raw = memoryview(unpack(field("n_ids").as_py(), *map(listed, ("base", "width", "at", "exceptions")), field("payload").as_py()).astype("<u4").tobytes())
                ends = np.cumsum(listed("doc_sizes"), dtype=np.int64)
                begin, n = np.concatenate([[0], ends[:-1]]), len(ends)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                part, seq = (pa.array(np.full(n, field(c).as_py(), np.int32)) for c in ("part", "seq"))
                yield pa.RecordBatch.from_arrays([field("doc_ids").values, part, seq, pa.array(begin), pa.array(ends - begin), pa.array(crc, pa.int64())], ["doc_id", "part", "seq", "offset", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(SEGMENTS).parquet(path)
    sizes = stored.select("part", "seq", "n_ids")
    before = lambda n, line: F.coalesce(F.sum(n).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before("n", Window.orderBy("part")).alias("part_start"))
    places = sizes.select("part", "seq", before("n_ids", Window.partitionBy("part").orderBy("seq")).alias("in_part"))
    places = places.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("segment_start"))
    read = stored.mapInArrow(documents, READ)
    return read.join(places, ["part", "seq"]).select("doc_id", (F.col("segment_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

"""Arrays in .npy files as a data source, `npy`: rows (row, values), the first axis dealt out by ranges.

A task reads a range of rows by its bytes. Writing gives a file for each task's rows and publishes their list, in the
order of the rows, at commit; the folder reads as one array.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sylvaflow.sources.stores import files, publish, read_range, remove, write_bytes

#: Bytes of one task's range of rows, and of one batch of these.
RANGE, BATCH = 64 << 20, 8 << 20


@dataclass
class Header:
    path: str
    dtype: str
    shape: tuple[int, ...]
    at: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


def header(path: str) -> Header:
    """Type, shape and start of the data. Arrays by columns, of objects or without an axis aren't read."""
    head = read_range(path, 0, 12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{path} is not an .npy file")
    long = head[6] > 1
    size = struct.unpack_from("<I" if long else "<H", head, 8)[0]
    at = 12 if long else 10
    found = ast.literal_eval(read_range(path, at, size).decode("utf-8" if head[6] > 2 else "latin-1"))
    kind = np.dtype(found["descr"])
    if found["fortran_order"] and len(found["shape"]) > 1 or kind.kind not in "fiub" or not found["shape"]:
        raise ValueError(f"{path}: only arrays of numbers by rows are read")
    return Header(path, kind.str, tuple(found["shape"]), at + size)


@dataclass
class Rows(InputPartition):
    of: Header
    start: int
    stop: int
    before: int  # rows of the files before


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[Rows]:
        out, before = [], 0
        for path in files(self.path, ".npy"):
            of = header(path)
            step = max(1, self.range // max(1, of.width * np.dtype(of.dtype).itemsize))
            out += [Rows(of, a, min(a + step, of.shape[0]), before) for a in range(0, of.shape[0], step)]
            before += of.shape[0]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        of = partition.of
        size = of.width * np.dtype(of.dtype).itemsize
        step = max(1, BATCH // max(1, size))
        for a in range(partition.start, partition.stop, step):
            b = min(a + step, partition.stop)
            cells = np.frombuffer(read_range(of.path, of.at + a * size, (b - a) * size), of.dtype)
            cells = cells.astype(np.float64 if cells.dtype.kind == "f" else np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * of.width), pa.array(cells))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + partition.before), values], ["row", "values"])


@dataclass
class Part(WriterCommitMessage):
    name: str
    first: int
    rows: int
    width: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dtype, self.overwrite, self.id = options["path"], np.dtype(options["dtype"]), overwrite, uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part | None:
        found, first, last, rows, width = [], None, None, 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            row, values = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(values.offsets.to_numpy())
            width = int(sizes[0]) if width is None else width
            if (sizes != width).any() or values.flatten().null_count:
                raise ValueError("every row of an array needs the same number of values, none of them null")
            if last is not None and row[0] != last + 1 or (np.diff(row) != 1).any():
                raise ValueError("rows of an array must be numbered without gaps or repeats")
            first, last = int(row[0]) if first is None else first, int(row[-1])
            found.append(values.flatten().to_numpy().astype(self.dtype).tobytes())
            rows += len(row)
        if first is None:
            return None
        name = f"{self.id}-{first:012d}.npy"
        head = str({"descr": self.dtype.str, "fortran_order": False, "shape": (rows, width)}).encode()
        head += b" " * (-(len(head) + 11) % 64) + b"\n"
        write_bytes(f"{self.path.rstrip('/')}/{name}", b"\x93NUMPY\1\0" + struct.pack("<H", len(head)) + head + b"".join(found))
        return Part(name, first, rows, width)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.first)
        at = 0
        for p in parts:
            if p.first != at or p.width != parts[0].width:
                remove(self.path, [p.name for p in parts])
                raise ValueError("rows of an array must be numbered from 0 without gaps, all of one width")
            at += p.rows
        try:
            before = [x for x in (y.rpartition("/")[2] for y in files(self.path, ".npy")) if x not in {p.name for p in parts}]
        except FileNotFoundError:
            before = []
        publish(self.path, [p.name for p in parts], shape=[at, parts[0].width if parts else 0], dtype=self.dtype.str)
        remove(self.path, before)

    def abort(self, messages: list[Part | None]) -> None:
        remove(self.path, [m.name for m in messages if m])


class NpySource(DataSource):
    """Registered as `npy`. Values are doubles or longs; further axes are flattened into a row's values."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        found = files(self.options["path"], ".npy")
        kind = "double" if found and np.dtype(header(found[0]).dtype).kind == "f" else "long"
        return f"row long, values array<{kind}>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def write_npy(frame: DataFrame, path: str, dtype: str = "float32", parts: int | None = None) -> None:
    """frame(row, values), rows numbered from 0, as a folder of .npy files in the order of the rows. Rows are dealt
    out by ranges, so a task holds its own file's bytes alone; null, ragged or missing rows are errors."""
    frame.sparkSession.dataSource.register(NpySource)
    rows = frame.select(F.col("row").cast("long").alias("row"), "values")
    dealt = rows.repartitionByRange(parts, "row") if parts else rows.repartitionByRange("row")
    dealt.sortWithinPartitions("row").write.format("npy").option("dtype", dtype).mode("overwrite").save(path)


def read_npy(spark, path: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("range", range_bytes).load(path)

"""Raster files as a data source, `raster`: rows (row, col, x, y, band values) of tiled or stripped TIFF.

A task reads one tile of a file, by its byte range. Comparisons of row, col, x and y with constants are pushed down:
tiles outside them aren't read. Writing takes a grid by tiles, a file each, and publishes their list at commit.

    read_raster(spark, "/maps/2023").filter("row BETWEEN 0 AND 99")
    write_raster(grid, "/maps/new", ["red", "nir"], x_min=0.0, y_max=640.0, resolution=10.0)
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from sylvaflow.sources.stores import files, publish, read_range, remove, write_bytes

#: Fixed values of the format: tags, field sizes by type, and number kinds by sample format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, STRIP_ROWS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 277, 278, 284, 317
STRIP_AT, STRIP_SIZE, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 273, 279, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, NO_DATA = 33550, 33922, 42113
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_KINDS = {1: "u", 2: "i", 3: "f"}
_PLAIN, _DEFLATE, _OLD_DEFLATE = 1, 8, 32946


@dataclass
class Layout:
    """Where a file's tiles are and how to read them; (x_min, y_max) is the outer corner of cell (row0, col0)."""

    path: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    at: tuple[int, ...]
    sizes: tuple[int, ...]
    bands: int
    dtype: str
    planar: bool
    compression: int
    predictor: int
    x_min: float
    y_max: float
    resolution: float
    no_data: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)


def layout(path: str) -> Layout:
    """Reads a file's first directory."""
    head = read_range(path, 0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError(f"{path} is not a TIFF file")
    big = version == 43
    first = struct.unpack_from(f"{order}Q" if big else f"{order}I", head, 8 if big else 4)[0]
    n = struct.unpack(f"{order}Q" if big else f"{order}H", read_range(path, first, 8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    raw = read_range(path, first + (8 if big else 2), n * size)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind = struct.unpack_from(f"{order}HH", raw, k * size)
        count = struct.unpack_from(f"{order}Q" if big else f"{order}I", raw, k * size + 4)[0]
        if kind not in _FIELDS:
            continue
        code, width = _FIELDS[kind]
        at = k * size + (12 if big else 8)
        data = raw[at : at + count * width]
        if count * width > inline:
            data = read_range(path, struct.unpack_from(f"{order}Q" if big else f"{order}I", raw, at)[0], count * width)
        tags[tag] = (data[:count],) if kind == 2 else struct.unpack(f"{order}{code * count}", data)
    one = lambda tag, otherwise: tags.get(tag, (otherwise,))[0]
    compression = one(COMPRESSION, _PLAIN)
    if compression not in (_PLAIN, _DEFLATE, _OLD_DEFLATE):
        raise ValueError(f"{path}: compression {compression} is not read, only none and deflate")
    tiled = TILE_AT in tags
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(TIE_POINT, (0.0,) * 6)
    text = one(NO_DATA, b"").rstrip(b"\0 ").decode() if NO_DATA in tags else ""
    return Layout(
        path, one(WIDTH, 0), one(HEIGHT, 0), one(TILE_WIDTH, 0) if tiled else one(WIDTH, 0), one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, one(HEIGHT, 0)), one(HEIGHT, 0)),
        tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZE if tiled else STRIP_SIZE], one(SAMPLES, 1), f"{order}{_KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}", one(PLANAR, 1) == 2, compression, one(PREDICTOR, 1),
        tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], float(text) if text else None,
    )


def tile(of: Layout, number: int) -> np.ndarray:
    """The cells of a tile as (row, col, band), padding included; a planar file's tile is gathered from its bands."""
    per_band = len(of.at) // of.bands if of.planar else len(of.at)
    parts = [number + b * per_band for b in range(of.bands)] if of.planar else [number]
    depth, found = (1 if of.planar else of.bands), []
    for k in parts:
        raw = read_range(of.path, of.at[k], of.sizes[k])
        raw = raw if of.compression == _PLAIN else zlib.decompress(raw)
        cells = np.frombuffer(raw, of.dtype)
        cells = cells[: len(cells) // (of.tile_width * depth) * of.tile_width * depth].reshape(-1, of.tile_width, depth)
        if of.predictor == 2:
            cells = np.cumsum(cells, 1, dtype=cells.dtype)
        elif of.predictor != 1:
            raise ValueError(f"{of.path}: predictor {of.predictor} is not read")
        found.append(cells)
    return np.concatenate(found, 2)


def encoded(cells: np.ndarray, x_min: float, y_max: float, resolution: float, no_data: float, compress: bool) -> bytes:
    """A file of one tile of (row, col, band) cells."""
    n, m, bands = cells.shape
    data = np.ascontiguousarray(cells, cells.dtype.newbyteorder("<")).tobytes()
    data = zlib.compress(data, 6) if compress else data
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    empty = f"{no_data:.17g}".encode() + b"\0"
    doubles = lambda *v: (12, len(v), struct.pack(f"<{len(v)}d", *v))
    shorts = lambda *v: (3, len(v), struct.pack(f"<{len(v)}H", *v))
    long = lambda v: (4, 1, struct.pack("<I", v))
    tags = {WIDTH: long(m), HEIGHT: long(n), BITS: shorts(*[cells.dtype.itemsize * 8] * bands), COMPRESSION: shorts(_DEFLATE if compress else _PLAIN), PHOTOMETRIC: shorts(1), SAMPLES: shorts(bands), PLANAR: shorts(1), TILE_WIDTH: long(m), TILE_HEIGHT: long(n), TILE_AT: None, TILE_SIZE: long(len(data)), FORMAT: shorts(*[kind] * bands), PIXEL_SCALE: doubles(resolution, resolution, 0.0), TIE_POINT: doubles(0.0, 0.0, 0.0, x_min, y_max, 0.0), NO_DATA: (2, len(empty), empty)}
    rest_at = 8 + 2 + 12 * len(tags) + 4
    rest = b"".join(v[2] + b"\0" * (len(v[2]) % 2) for v in tags.values() if v and len(v[2]) > 4)
    tags[TILE_AT] = long(rest_at + len(rest))
    out, at = [b"II*\0" + struct.pack("<IH", 8, len(tags))], rest_at
    for tag in sorted(tags):
        field, count, value = tags[tag]
        if len(value) > 4:
            out.append(struct.pack("<HHII", tag, field, count, at))
            at += len(value) + len(value) % 2
        else:
            out.append(struct.pack("<HHI", tag, field, count) + value.ljust(4, b"\0"))
    ordered = b"".join(tags[t][2] + b"\0" * (len(tags[t][2]) % 2) for t in sorted(tags) if len(tags[t][2]) > 4)
    return b"".join(out) + struct.pack("<I", 0) + ordered + data


@dataclass
class Tile(InputPartition):
    """A tile of a file, and the cell of the grid that the file begins at."""

    of: Layout
    number: int
    row: int
    col: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict, bands: int):
        self.path, self.bands = options["path"], bands
        self.bounds = {k: [-math.inf, math.inf] for k in ("row", "col", "x", "y")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the bounds; every filter is also left to Spark, as tiles hold more than the bounds."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in self.bounds:
                low, high = self.bounds[f.attribute[0]]
                v = float(f.value)
                self.bounds[f.attribute[0]] = [low if isinstance(f, (LessThan, LessThanOrEqual)) else max(low, v), high if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else min(high, v)]
            yield f

    def partitions(self) -> list[Tile]:
        """The tiles that meet the bounds. Rows and columns count from the upper left of all files."""
        found = [layout(p) for p in files(self.path, ".tif")]
        if not found:
            return []
        res, x0, y0 = found[0].resolution, min(f.x_min for f in found), max(f.y_max for f in found)
        out = []
        for f in found:
            if abs(f.resolution - res) > 1e-9 * res or f.bands != self.bands:
                raise ValueError(f"{f.path} has another resolution or number of bands than {found[0].path}")
            row, col = round((y0 - f.y_max) / res), round((f.x_min - x0) / res)
            for number in range(len(f.at) // (f.bands if f.planar else 1)):
                r, c = row + number // f.across * f.tile_height, col + number % f.across * f.tile_width
                spans = {"row": (r, r + f.tile_height - 1), "col": (c, c + f.tile_width - 1), "x": (x0 + c * res, x0 + (c + f.tile_width) * res), "y": (y0 - (r + f.tile_height) * res, y0 - r * res)}
                if all(spans[k][0] <= high and spans[k][1] >= low for k, (low, high) in self.bounds.items()):
                    out.append(Tile(f, number, row, col))
        return out

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        f = partition.of
        cells = tile(f, partition.number)
        r0, c0 = partition.number // f.across * f.tile_height, partition.number % f.across * f.tile_width
        cells = cells[: f.height - r0, : f.width - c0].astype(float)
        if f.no_data is not None:
            cells[cells == f.no_data] = np.nan
        r, c = np.nonzero(~np.isnan(cells).all(2))
        x, y = f.x_min + (c + c0 + 0.5) * f.resolution, f.y_max - (r + r0 + 0.5) * f.resolution
        values = [pa.array(cells[r, c, b], from_pandas=True) for b in range(f.bands)]
        names = ["row", "col", "x", "y", *(f"band_{b + 1}" for b in range(f.bands))]
        yield pa.RecordBatch.from_arrays([pa.array(r + r0 + partition.row), pa.array(c + c0 + partition.col), pa.array(x), pa.array(y), *values], names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RasterWriter(DataSourceArrowWriter):
    """Rows sorted by tile, as write_raster deals them out: a tile of cells is all that is held."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.id = options["path"], overwrite, uuid4().hex
        self.size, self.x_min, self.y_max, self.resolution = int(options["size"]), float(options["x_min"]), float(options["y_max"]), float(options["resolution"])
        self.dtype, self.no_data, self.compress = np.dtype(options.get("dtype", "float64")), float(options.get("no_data", "nan")), options.get("compress", "true") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        now, cells, names = None, None, []

        def put() -> None:
            if now is not None:
                name = f"{self.id}-r{now[0]}-c{now[1]}.tif"
                corner = self.x_min + now[1] * self.size * self.resolution, self.y_max - now[0] * self.size * self.resolution
                write_bytes(f"{self.path.rstrip('/')}/{name}", encoded(cells, *corner, self.resolution, self.no_data, self.compress))
                names.append(name)

        for batch in iterator:
            if not batch.num_rows:
                continue
            row, col = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = np.stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(2, batch.num_columns)], 1)
            values = np.where(np.isnan(values), self.no_data, values)
            tiles = np.stack([row // self.size, col // self.size], 1)
            start = np.concatenate([[0], np.flatnonzero((tiles[1:] != tiles[:-1]).any(1)) + 1, [len(row)]])
            for a, b in zip(start, start[1:]):
                if tuple(tiles[a]) != now:
                    put()
                    now = tuple(tiles[a].tolist())
                    cells = np.full((self.size, self.size, values.shape[1]), self.no_data).astype(self.dtype)
                cells[row[a:b] % self.size, col[a:b] % self.size] = values[a:b].astype(self.dtype)
        put()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m for n in m.names]
        try:
            before = [x for x in (y.rpartition("/")[2] for y in files(self.path, ".tif")) if x not in names]
        except FileNotFoundError:
            before = []
        publish(self.path, names if self.overwrite else before + names)
        if self.overwrite:
            remove(self.path, before)

    def abort(self, messages: list[Written | None]) -> None:
        remove(self.path, [n for m in messages if m for n in m.names])


class RasterSource(DataSource):
    """Registered as `raster`. All files of a folder are one grid; values are doubles, null where there is no data,
    and cells without data in any band aren't rows."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def _bands(self) -> int:
        found = files(self.options["path"], ".tif")
        return layout(found[0]).bands if found else 1

    def schema(self) -> str:
        return ", ".join(["row long, col long, x double, y double", *(f"band_{b + 1} double" for b in range(self._bands()))])

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options, len(schema) - 4)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)


def write_raster(grid: DataFrame, path: str, values: list[str], x_min: float, y_max: float, resolution: float, size: int = 512, dtype: str = "float64", no_data: float = math.nan, compress: bool = True, mode: str = "overwrite") -> None:
    """grid(row, col, values) as a folder of tiles. Null is no data; of a repeated cell the last one sorted counts.
    Whole-number kinds need a `no_data` that they can hold. Sizes must be multiples of 16, as the format has it."""
    if size % 16 or np.dtype(dtype).kind in "iu" and math.isnan(no_data):
        raise ValueError("sizes are multiples of 16, and whole numbers need a no_data value")
    grid.sparkSession.dataSource.register(RasterSource)
    place = [F.floor(F.col(c) / size) for c in ("row", "col")]
    dealt = grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *(F.col(v).cast("double").alias(v) for v in values)).repartition(*place).sortWithinPartitions(*place, "row", "col", *values)
    options = {"size": size, "x_min": x_min, "y_max": y_max, "resolution": resolution, "dtype": dtype, "no_data": repr(float(no_data)), "compress": str(compress).lower()}
    dealt.write.format("raster").options(**options).mode(mode).save(path)


def read_raster(spark, path: str) -> DataFrame:
    """A folder's grid. Turns on the session's setting that lets Python sources see filters."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("raster").load(path)

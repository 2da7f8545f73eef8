"""Raster and array files: round trips, foreign layouts, and how little a bounded read touches."""

import struct
import zlib

import numpy as np
import pytest

from sylvaflow.sources import rasters
from sylvaflow.sources.arrays import header, read_npy, write_npy
from sylvaflow.sources.rasters import RasterReader, layout, read_raster, tile, write_raster


def cells_of(spark, z, names):
    rows = [(int(r), int(c), *(None if np.isnan(v) else float(v) for v in z[r, c])) for r, c in np.ndindex(z.shape[:2])]
    return spark.createDataFrame(rows, "row long, col long, " + ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize(("dtype", "no_data", "compress"), [("float64", float("nan"), True), ("float32", -9999.0, False), ("int16", -1.0, True), ("uint8", 255.0, False)])
def test_raster_round_trip(spark, tmp_path, dtype, no_data, compress):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 200, (41, 53, 2)).astype(float)
    z[3:9, 4:20] = np.nan
    z[20, 20, 0] = np.nan
    path = str(tmp_path / "map")
    write_raster(cells_of(spark, z, ["a", "b"]), path, ["a", "b"], 1000.0, 5000.0, 10.0, 16, dtype, no_data, compress)
    back = read_raster(spark, path)
    got = {(r.row, r.col): (r.band_1, r.band_2, r.x, r.y) for r in back.collect()}
    clean = lambda v: None if np.isnan(v) else float(v)
    assert got == {(r, c): (clean(z[r, c, 0]), clean(z[r, c, 1]), 1005.0 + 10 * c, 4995.0 - 10 * r) for r, c in np.ndindex(41, 53) if not np.isnan(z[r, c]).all()}


def test_bounded_reads_touch_their_tiles_alone(spark, tmp_path):
    z = np.arange(64 * 64, dtype=float).reshape(64, 64, 1)
    path = str(tmp_path / "map")
    write_raster(cells_of(spark, z, ["a"]), path, ["a"], 0.0, 640.0, 10.0, 16)
    reader = RasterReader({"path": path}, 1)
    assert len(reader.partitions()) == 16
    reader.bounds["row"], reader.bounds["x"] = [17, 30], [-5.0, 200.0]
    assert sorted((t.row, t.col) for t in reader.partitions()) == [(16, 0), (16, 16)]
    few = read_raster(spark, path).filter("row >= 17 AND row < 31 AND col = 5")
    assert few.rdd.getNumPartitions() == 1 and sorted(r.band_1 for r in few.collect()) == [float(r * 64 + 5) for r in range(17, 31)]


def test_overwriting_and_appending(spark, tmp_path):
    path, one = str(tmp_path / "map"), np.ones((16, 16, 1))
    write_raster(cells_of(spark, one, ["a"]), path, ["a"], 0.0, 160.0, 10.0, 16)
    write_raster(cells_of(spark, one * 2, ["a"]), path, ["a"], 0.0, 160.0, 10.0, 16)
    assert {r.band_1 for r in read_raster(spark, path).collect()} == {2.0} and len(list((tmp_path / "map").glob("*.tif"))) == 1
    write_raster(cells_of(spark, one * 3, ["a"]), path, ["a"], 160.0, 160.0, 10.0, 16, mode="append")
    assert {(r.col // 16, r.band_1) for r in read_raster(spark, path).collect()} == {(0, 2.0), (1, 3.0)}
    with pytest.raises(ValueError):
        write_raster(cells_of(spark, one, ["a"]), path, ["a"], 0.0, 160.0, 10.0, 16, "int16")


def foreign(path, z, predictor):
    """A big-endian file in strips of 3 rows, one plane a band, deflated."""
    n, m, bands = z.shape
    strips = [z[a : a + 3, :, b] for b in range(bands) for a in range(0, n, 3)]
    raw = [zlib.compress((np.diff(s, axis=1, prepend=0) if predictor == 2 else s).astype(">i2").tobytes()) for s in strips]
    at, ends = [], 8
    for r in raw:
        at.append(ends)
        ends += len(r)
    entries = [(256, 3, [m]), (257, 3, [n]), (258, 3, [16] * bands), (259, 3, [8]), (273, 4, at), (277, 3, [bands]), (278, 3, [3]), (279, 4, [len(r) for r in raw]), (284, 3, [2]), (317, 3, [predictor]), (339, 3, [2] * bands)]
    body, directory = b"", struct.pack(">H", len(entries))
    for tag, kind, v in entries:
        data = struct.pack(f">{len(v)}{'H' if kind == 3 else 'I'}", *v)
        if len(data) > 4:
            directory += struct.pack(">HHII", tag, kind, len(v), ends + len(body))
            body += data
        else:
            directory += struct.pack(">HHI", tag, kind, len(v)) + data.ljust(4, b"\0")
    path.write_bytes(b"MM\0*" + struct.pack(">I", ends + len(body)) + b"".join(raw) + body + directory + b"\0" * 4)


@pytest.mark.parametrize("predictor", [1, 2])
def test_strips_planes_and_the_other_byte_order(spark, tmp_path, predictor):
    z = np.random.default_rng(2).integers(-300, 300, (10, 7, 2))
    foreign(tmp_path / "a.tif", z, predictor)
    of = layout(str(tmp_path / "a.tif"))
    assert (of.width, of.height, of.tile_height, of.bands) == (7, 10, 3, 2)
    assert (np.concatenate([tile(of, k) for k in range(4)])[:10] == z).all()
    got = {(r.row, r.col): (r.band_1, r.band_2) for r in read_raster(spark, str(tmp_path)).collect()}
    assert got == {(r, c): tuple(map(float, z[r, c])) for r, c in np.ndindex(10, 7)}
    (tmp_path / "b.tif").write_bytes(b"not a raster at all")
    with pytest.raises(ValueError):
        rasters.layout(str(tmp_path / "b.tif"))


@pytest.mark.parametrize("dtype", ["float32", "float64", "int32", "int64", "uint8"])
def test_arrays_round_trip(spark, tmp_path, dtype):
    z = (np.random.default_rng(3).normal(size=(500, 6)) * 50).astype("float32" if dtype[0] == "f" else int) % 100
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(z)], "row long, values array<double>")
    write_npy(frame, path, dtype, parts=4)
    assert len(list((tmp_path / "out").glob("*.npy"))) == 4
    back = read_npy(spark, path, range_bytes=300)
    assert back.rdd.getNumPartitions() > 8
    got = np.array([r["values"] for r in back.orderBy("row").collect()])
    assert (got == z.astype(dtype)).all()
    parts = [np.load(p) for p in sorted((tmp_path / "out").glob("*.npy"), key=lambda p: p.name.split("-")[1])]
    assert (np.concatenate(parts) == z.astype(dtype)).all() and parts[0].dtype == dtype


def test_arrays_of_other_writers(spark, tmp_path):
    z = np.arange(24, dtype=">i2").reshape(4, 3, 2)
    np.save(tmp_path / "z.npy", z)
    assert header(str(tmp_path / "z.npy")).shape == (4, 3, 2)
    assert [r["values"] for r in read_npy(spark, str(tmp_path / "z.npy")).orderBy("row").collect()] == z.reshape(4, 6).tolist()
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(ValueError):
        header(str(tmp_path / "f.npy"))


def test_gaps_and_ragged_rows_are_errors(spark, tmp_path):
    for rows in ([(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (0, [1.0])], [(0, [None])], [(1, [1.0])]):
        with pytest.raises(Exception, match="row"):
            write_npy(spark.createDataFrame(rows, "row long, values array<double>"), str(tmp_path / "bad"), "float64", parts=1)

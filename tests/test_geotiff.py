"""Reading hand-made files of many layouts, and the round trip of the writer."""

import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringContains

from rasterlake.plans.header import Header
from rasterlake.plans.raster import Raster, RasterStack
from rasterlake.sources import geotiff, tiff


def pack_bits(raw):
    out = b""
    for at in range(0, len(raw), 100):
        part = raw[at : at + 100]
        out += bytes([len(part) - 1]) + part
    return out


def pack_lzw(raw):
    """Nine-bit literals with a clear code often enough never to widen."""
    codes = []
    for k, b in enumerate(raw):
        if k % 200 == 0:
            codes.append(256)
        codes.append(b)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


PACK = {"none": (1, lambda b: b), "deflate": (8, zlib.compress), "lzw": (5, pack_lzw), "packbits": (32773, pack_bits), "zstd": (50000, lambda b: zstandard.compress(b))}


def make(path, grid, codec="none", predictor=1, tile=None, planar=False):
    """A classic little-endian TIFF of ``grid`` (bands, rows, columns)."""
    bands, h, w = grid.shape
    kind = grid.dtype
    bw, bh = (tile, tile) if tile else (w, 4)
    blocks = []
    for b in range(bands if planar else 1):
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = grid[b : b + 1, y : y + bh, x : x + bw] if planar else grid[:, y : y + bh, x : x + bw]
                if tile:
                    part = np.pad(part, ((0, 0), (0, bh - part.shape[1]), (0, bw - part.shape[2])))
                cells = np.ascontiguousarray(part.transpose(1, 2, 0))
                if predictor == 2:
                    cells = np.concatenate([cells[:, :1], np.diff(cells, axis=1)], axis=1).astype(kind)
                    raw = cells.tobytes()
                elif predictor == 3:
                    r, c, s = cells.shape
                    planes = cells.astype(kind.newbyteorder(">")).view(np.uint8).reshape(r, c * s, kind.itemsize).transpose(0, 2, 1).reshape(r, -1)
                    steps = planes.copy()
                    steps[:, s:] -= planes[:, :-s]
                    raw = steps.tobytes()
                else:
                    raw = cells.tobytes()
                blocks.append(PACK[codec][1](raw))
    offsets, at = [], 8
    for b in blocks:
        offsets.append(at)
        at += len(b)
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    size_tags = [(322, [tile]), (323, [tile]), (324, offsets), (325, [len(b) for b in blocks])] if tile else [(278, [bh]), (273, offsets), (279, [len(b) for b in blocks])]
    tags = sorted([(256, [w]), (257, [h]), (258, [kind.itemsize * 8] * bands), (259, [PACK[codec][0]]), (277, [bands]), (284, [2 if planar else 1]), (317, [predictor]), (339, [form] * bands), *size_tags])
    head, extra, extra_at = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
    for tag, values in tags:
        body = struct.pack(f"<{len(values)}I", *values)
        head += struct.pack("<HHI", tag, 4, len(values)) + (body if len(body) == 4 else struct.pack("<I", extra_at + len(extra)))
        extra += body if len(body) > 4 else b""
    path.write_bytes(b"II*\0" + struct.pack("<I", at) + b"".join(blocks) + head + b"\0\0\0\0" + extra)
    return str(path)


def stored(grid, layout_path):
    """The grid as the reader's blocks give it, without Spark."""
    layout = geotiff.header_of(layout_path)
    bands = list(range(1, layout.header.bands + 1))
    reader = geotiff.GeoTiffReader([layout_path], bands, [f"b{b}" for b in bands], 512)
    out = np.full(grid.shape, np.nan)
    for part in reader.partitions():
        for batch in reader.read(part):
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for b in range(grid.shape[0]):
                out[b, cols[0], cols[1]] = cols[2 + b]
    return out


@pytest.mark.parametrize("codec", list(PACK))
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize(("dtype", "predictor"), [("u1", 1), ("u2", 2), ("i2", 1), ("f4", 1), ("f4", 3)])
@pytest.mark.parametrize("planar", [False, True])
def test_layouts(tmp_path, codec, tile, dtype, predictor, planar):
    grid = (np.random.default_rng(5).random((2, 21, 19)) * 200).astype(dtype)
    path = make(tmp_path / "a.tif", grid, codec, predictor, tile, planar)
    assert np.array_equal(stored(grid, path), grid.astype(float))


def test_long_lzw_codes():
    # a repeating input, packed by a plain encoder that widens its codes
    raw = bytes(np.random.default_rng(3).integers(0, 4, 6000).astype(np.uint8))
    table, codes, w = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    n, width = 258, 9
    for b in raw:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append((table[w], width))
        table[w + bytes([b])] = n
        n += 1
        if n + 0 >= (1 << width) and width < 12:
            width += 1
        w = bytes([b])
        if n >= 4093:
            codes.append((table[w], width))
            codes.append((256, width))
            table, n, width, w = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if w:
        codes.append((table[w], width))
        n += 1
        if n >= (1 << width) and width < 12:
            width += 1
    codes.append((257, width))
    bits = "".join(f"{c:0{k}b}" for c, k in codes)
    bits += "0" * (-len(bits) % 8)
    assert tiff.unpack_lzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == raw


def test_round_trip(spark, tmp_path):
    grid = np.random.default_rng(8).random((40, 33)).astype(np.float32)
    rows = [(y, x, float(grid[y, x]), None if x == 0 else float(y)) for y in range(40) for x in range(33)]
    header = Header(33, 40, (10.0, 0.5, 0.0, 50.0, 0.0, -0.5), "EPSG:4326", 2, -9999.0)
    path = str(tmp_path / "out.tif")
    Raster(spark.createDataFrame(rows, "y int, x int, b1 double, b2 double"), header).save_local(path)
    back = Raster.open(spark, path)
    assert back.get_info() == header.info() and back.header.nodata == -9999.0
    got = back.to_memory()
    assert np.array_equal(got[0], grid) and (got[1][:, 0] == -9999).all() and got[1][7, 5] == 7
    one = Raster.open(spark, path, bands=[2])
    assert one.header.bands == 1 and one.pixels.columns == ["y", "x", "b1"]


@pytest.mark.parametrize("by_tasks", [True, False])
def test_written_by_tasks_or_through_one_stream(spark, tmp_path, by_tasks):
    """Many tiles and part files, sparse pixels, and nothing left beside the file."""
    y, x = np.mgrid[0:70, 0:50]
    there = (x // 16 + y // 16) % 3 > 0  # tiles without pixels
    rows = [(int(a), int(b), float(a * 100 + b)) for a, b in zip(y[there], x[there])]
    path = str(tmp_path / "out.tif")
    geotiff.write(spark.createDataFrame(rows, "y int, x int, b1 double").repartition(5), Header(50, 70), path, tile=16, by_tasks=by_tasks)
    got = {(r.y, r.x): r.b1 for r in Raster.open(spark, path).pixels.collect()}
    assert len(got) == 70 * 50 and got == {(int(a), int(b)): float(a * 100 + b) if there[a, b] else None for a, b in zip(y.ravel(), x.ravel())}
    assert [p.name for p in tmp_path.iterdir()] == ["out.tif"]


def fetched(reader):
    """The blocks that a reader fetches."""
    seen = []
    plain = reader._fetch
    reader._fetch = lambda f, layout, order, pool: seen.extend(order) or plain(f, layout, order, pool)
    rows = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
    return seen, rows


def test_filters_leave_blocks_out(tmp_path):
    grid = np.random.default_rng(5).random((2, 64, 64)).astype("f4")
    path = make(tmp_path / "a.tif", grid, tile=16, planar=True)
    cases = [
        ([], 16), ([GreaterThanOrEqual(("y",), 20), LessThan(("y",), 32)], 4), ([EqualTo(("x",), 17)], 4), ([In(("y",), (3, 40)), GreaterThan(("x",), 47)], 3), ([LessThanOrEqual(("x",), 15), GreaterThan(("y",), 47)], 1), ([EqualTo(("y",), 99)], 0), ([StringContains(("b1",), "x")], 16),
    ]
    for filters, blocks in cases:
        reader = geotiff.GeoTiffReader([path], [2], ["b2"], 16)
        assert list(reader.pushFilters(filters)) == filters
        seen, rows = fetched(reader)
        assert len(seen) == blocks and rows == blocks * 256 and all(k >= 16 for k in seen)


def test_only_needed_bands_and_blocks_are_read(spark, tmp_path):
    grid = (np.random.default_rng(5).random((3, 64, 48)) * 100).astype("f4")
    path = make(tmp_path / "a.tif", grid, tile=16, planar=True)
    r = Raster.open(spark, path)
    assert r.header.bands == 3
    plan = r.algebra("B3 + 1").pixels._jdf.queryExecution().analyzed().toString()
    assert "b3#" in plan and "b1#" not in plan.split("Relation")[-1] and "b2#" not in plan.split("Relation")[-1]
    assert np.allclose(r.algebra("B3 - B1").to_memory(), grid[2] - grid[0], atol=1e-4)
    assert np.allclose(r.focal("max", 1).to_memory()[5, 5], grid[0, 4:7, 4:7].max())
    some = r.pixels.where((F.col("y") >= 20) & (F.col("y") < 25) & (F.col("x") == 33))
    strips = spark.read.format("geotiff").option("strip", "16").load(path)
    assert strips.rdd.getNumPartitions() == 4 and strips.where("y between 20 and 24").rdd.getNumPartitions() == 1
    assert sorted((p.y, round(p.b2, 3)) for p in some.collect()) == [(y, round(float(grid[1, y, 33]), 3)) for y in range(20, 25)]
    two = Raster.open(spark, path, bands=[3, 2])
    assert np.allclose(two.algebra("B1 * 2").to_memory(), grid[2] * 2, atol=1e-4)


@pytest.mark.parametrize(("tile", "planar"), [(16, True), (None, False), (32, True)])
def test_blocks_straight_from_the_file(spark, tmp_path, tile, planar):
    """Operations on blocks read a file as pieces, and give what they give on its pixels."""
    grid = (np.random.default_rng(9).random((2, 70, 52)) * 100).astype("f4")
    grid[:, 20:23, 10:15] = np.nan
    path = make(tmp_path / "a.tif", grid, tile=tile, planar=planar)
    r = Raster.open(spark, path, bands=[2, 1])
    r.header = r.header.with_(crs="EPSG:4326", transform=(10.0, 0.01, 0.0, 52.0, 0.0, -0.01))
    plain = Raster(r.pixels, r.header)

    def fresh():
        out = Raster.open(spark, path, bands=[2, 1])
        out.header = r.header
        return out

    for op in (lambda a: a.focal("median", 2, "circle"), lambda a: a.terrain(["slope", "tri"]), lambda a: a.reproject("EPSG:3857"), lambda a: a.reproject("EPSG:32632", 500, 500, "nearest", extent=(572000, 5750000, 590000, 5758000))):
        plan = op(fresh()).pixels._jdf.queryExecution().analyzed().toString()
        assert "runs#" in plan.split("Relation")[-1] and "x#" not in plan.split("Relation")[-1]
        a, b = (sorted(str(tuple(p)) for p in op(x).pixels.collect()) for x in (fresh(), plain))
        assert a == b
    assert np.allclose(plain.to_memory()[0], grid[1], equal_nan=True)
    # a small extent reads few rows of blocks
    reader = geotiff.GeoTiffReader([path], [1], ["b1"], 16, np.array([[3, 9, 4, 12], [0, 0, 0, 0]]))
    assert len(reader.partitions()) <= 3


def test_stacks_of_files(spark, tmp_path):
    """Scenes of different layouts, read side by side, without an exchange."""
    rng = np.random.default_rng(6)
    grids = [(rng.random((2, 40, 33)) * 100).astype("f4") for _ in range(3)]
    paths = [make(tmp_path / f"{k}.tif", g, codec, 1, tile, planar) for k, (g, codec, tile, planar) in enumerate(zip(grids, ("none", "zstd", "deflate"), (16, None, 32), (True, False, False)))]
    s = RasterStack.open(spark, paths)
    plan = s.algebra("B2 - B1").temporal("mean").pixels._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert np.allclose(s.algebra("B2 - B1").temporal("mean").to_memory(), np.mean([g[1] - g[0] for g in grids], axis=0), atol=1e-3)
    assert np.allclose(s.temporal("diff").to_memory(), grids[2][0] - grids[0][0], atol=1e-3)
    assert np.allclose(s.scenes[1].algebra("B2").to_memory(), grids[1][1], atol=1e-4)
    with pytest.raises(ValueError):
        RasterStack.open(spark, [*paths, make(tmp_path / "other.tif", grids[0][:, :20])])
    with pytest.raises(ValueError):
        RasterStack.open(spark, [])


def test_errors(spark, tmp_path):
    bad = tmp_path / "bad.tif"
    bad.write_bytes(b"no tiff at all")
    for path in (str(bad), str(tmp_path / "none.tif")):
        with pytest.raises(ValueError, match="cannot open"):
            geotiff.header_of(path)
    with pytest.raises(ValueError):
        Raster(spark.createDataFrame([(0, 0, 1.0)], "y int, x int, b1 double"), Header(1, 1)).save_s3("/tmp/x.tif")
    with pytest.raises(ValueError):
        tiff.unpack_lzw(bytes([0xFF] * 8))


def test_paths():
    assert geotiff.uri_of("/vsis3/b/k.tif") == "s3://b/k.tif" == geotiff.uri_of("s3a://b/k.tif")
    assert geotiff.uri_of("/a/b.tif") == "file:///a/b.tif"

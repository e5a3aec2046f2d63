"""Operators against numpy on small grids, and the decided behaviour where conventions differ."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlake.functions import crs
from rasterlake.operators import blocks, texture, vector, warp
from rasterlake.plans.header import Header
from rasterlake.plans.raster import Raster, RasterStack
from rasterlake.session import shared_folder


def raster(spark, grid, crs_name="", transform=None):
    grid = np.asarray(grid, float)
    h, w = grid.shape
    rows = [(y, x, None if math.isnan(grid[y, x]) else float(grid[y, x])) for y in range(h) for x in range(w)]
    return Raster(spark.createDataFrame(rows, "y int, x int, b1 double"), Header(w, h, transform or (0.0, 1.0, 0.0, float(h), 0.0, -1.0), crs_name))


def array(r):
    return r.to_memory().astype(float)


RANDOM = np.random.default_rng(42).integers(0, 100, (7, 7)).astype(float)


def window(grid, y, x, r, shape="square", clamp=True):
    h, w = grid.shape
    out = []
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if shape == "circle" and dx * dx + dy * dy > r * r:
                continue
            yy, xx = y + dy, x + dx
            if clamp:
                out.append(grid[min(max(yy, 0), h - 1), min(max(xx, 0), w - 1)])
            elif 0 <= yy < h and 0 <= xx < w:
                out.append(grid[yy, xx])
    return np.array(out)


STATS = {
    "mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "range": np.ptp, "std": lambda v: np.std(v, ddof=1) if len(v) > 1 else 0.0, "variance": lambda v: np.var(v, ddof=1) if len(v) > 1 else 0.0,
    "median": lambda v: np.sort(v)[(len(v) - 1) // 2],
}


@pytest.mark.parametrize("stat", STATS)
@pytest.mark.parametrize(("shape", "radius", "clamp"), [("square", 1, True), ("circle", 2, True), ("square", 2, False)])
def test_focal(spark, stat, shape, radius, clamp):
    got = array(raster(spark, RANDOM).focal(stat, radius, shape, clamp))
    want = [[STATS[stat](window(RANDOM, y, x, radius, shape, clamp)) for x in range(7)] for y in range(7)]
    assert np.allclose(got, want, atol=1e-3)


@pytest.mark.parametrize("grid", [[[5.0]], [[1.0, 2.0, 3.0]], [[1.0], [2.0]]])
def test_focal_on_thin_grids(spark, grid):
    grid = np.array(grid)
    got = array(raster(spark, grid).focal("mean", 2))
    assert np.allclose(got, [[window(grid, y, x, 2).mean() for x in range(grid.shape[1])] for y in range(grid.shape[0])])


def test_blocks_give_what_one_block_gives(spark):
    from rasterlake.operators.focal import focal
    from rasterlake.operators.terrain import terrain

    r = raster(spark, np.random.default_rng(1).random((23, 17)))
    for f in (lambda b: focal(r.pixels, r.header, "max", 3, block=b), lambda b: focal(r.pixels, r.header, "median", 2, "circle", block=b), lambda b: terrain(r.pixels, r.header, ("tri",), block=b)):
        assert sorted(map(tuple, f(5).collect())) == sorted(map(tuple, f(256).collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbourhoods_take_one_exchange(spark):
    r = raster(spark, RANDOM)
    big = Raster(r.pixels, r.header.with_(width=5000, height=5000))
    for out in (big.focal("median", 2), big.terrain(["slope"]), big.texture(["asm"], window=3, levels=4, val_max=9)):
        assert plan_of(out.pixels).count("Exchange ") == 1


def with_gaps(shape, seed, share=0.2):
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 50, shape).astype(float)
    grid[rng.random(shape) < share] = np.nan
    return grid


@pytest.mark.parametrize("stat", STATS)
@pytest.mark.parametrize(("shape", "radius", "clamp"), [("square", 1, True), ("circle", 3, False), ("square", 3, True)])
def test_focal_leaves_nulls_out(spark, stat, shape, radius, clamp):
    grid = with_gaps((11, 9), 3)
    grid[:6, :5] = np.nan  # windows without values
    got = {(r.y, r.x): r.b1 for r in raster(spark, grid).focal(stat, radius, shape, clamp).pixels.collect()}
    for y in range(11):
        for x in range(9):
            v = window(grid, y, x, radius, shape, clamp)
            v = v[~np.isnan(v)]
            assert got[y, x] is None if not len(v) else got[y, x] == pytest.approx(STATS[stat](v), abs=1e-9), (y, x)


def test_blocks_of_sparse_pixels(spark):
    """Places without a pixel give none, and count as null to their neighbours; pixels beyond the raster are left out."""
    rows = [(0, 0, 1.0), (0, 2, 5.0), (6, 6, 2.0), (9, 0, 7.0), (-1, 0, 9.0), (3, 12, 9.0)]
    r = Raster(spark.createDataFrame(rows, "y int, x int, b1 double"), Header(10, 10))
    from rasterlake.operators.focal import focal

    for block in (3, 512):
        got = sorted(map(tuple, focal(r.pixels, r.header, "sum", 2, clamp_border=False, block=block).collect()))
        assert got == [(0, 0, 6.0), (0, 2, 6.0), (6, 6, 2.0), (9, 0, 7.0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 12), st.integers(0, 6), st.integers(0, 1000))
def test_pieces_rebuild_the_windows(height, width, block, halo, seed):
    """Every block gets its own pixels and its halo, in whatever order and batches pixels come."""
    import pyarrow as pa

    tiling = blocks.Tiling.of(Header(width, height), halo, block)
    ys, xs = (a.ravel() for a in np.mgrid[0:height, 0:width])
    order = np.random.default_rng(seed).permutation(len(ys)) if seed % 2 else np.arange(len(ys))
    v = (ys * 1000 + xs).astype(float)
    batches = [pa.RecordBatch.from_arrays([pa.array(a[part]) for a in (ys * width + xs, v)], names=["place", "b"]) for part in np.array_split(order, 3)]
    held = {}
    for batch in blocks.pack(tiling)(iter(batches)):
        for number, runs, cells in zip(*(batch.column(k).to_pylist() for k in range(3))):
            held.setdefault(number, []).append((blocks.places_of(runs), np.frombuffer(cells)))
    assert sorted(held) == list(range(tiling.down * tiling.across))
    for number, found in held.items():
        y0, y1, x0, x1 = tiling.window(number)
        grid = np.full((y1 - y0) * (x1 - x0), np.nan)
        for at, cells in found:
            assert np.isnan(grid[at]).all()
            grid[at] = cells
        assert np.array_equal(grid.reshape(y1 - y0, x1 - x0), np.arange(y0, y1)[:, None] * 1000.0 + np.arange(x0, x1))


def test_focal_errors(spark):
    r = raster(spark, RANDOM)
    for bad in ({"stat": "mode"}, {"shape": "hexagon"}, {"radius": 0}):
        with pytest.raises(ValueError):
            r.focal(**bad)


def test_terrain_of_a_plane(spark):
    y, x = np.mgrid[0:5, 0:5]
    out = array(raster(spark, 2.0 * x + 1.0 * y).terrain(["slope", "tpi", "total_curv"]))[:, 1:4, 1:4]
    assert np.allclose(out[0], math.degrees(math.atan(math.sqrt(5))), atol=1e-4)
    assert np.allclose(out[1:], 0, atol=1e-6)


def test_terrain_of_flat_ground(spark):
    out = array(raster(spark, np.full((5, 5), 7.0)).terrain(["slope", "aspect", "tri", "roughness", "prof_curv", "plan_curv"]))
    assert np.allclose(out[0], 0) and np.allclose(out[1], -9999) and np.allclose(out[2:], 0)


def test_terrain_is_null_beside_nulls(spark):
    grid = with_gaps((9, 9), 5, 0.05)
    near = np.array([[np.isnan(window(grid, y, x, 1)).any() for x in range(9)] for y in range(9)])
    rows = raster(spark, grid).terrain(list(terrain_metrics())).pixels.collect()
    assert near.any() and not near.all()
    for r in rows:
        assert {v is None for v in tuple(r)[2:]} == {bool(near[r.y, r.x])}


def terrain_metrics():
    from rasterlake.operators.terrain import METRICS

    return METRICS


def test_terrain_order_and_errors(spark):
    r = raster(spark, RANDOM)
    a, b = array(r.terrain(["tri", "slope"])), array(r.terrain(["slope", "tri"]))
    assert np.allclose(a, b[::-1])
    for bad in ({"metrics": ["height"]}, {"unit": "gradians"}, {"method": "sobel"}):
        with pytest.raises(ValueError):
            r.terrain(**bad)


def test_geographic_cells():
    h = Header(10, 10, (10.0, 0.01, 0.0, 52.0, 0.0, -0.01), "EPSG:4326")
    x, y = h.cell_size()
    assert y == pytest.approx(1113.2) and x == pytest.approx(1113.2 * math.cos(math.radians(51.95)))


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]})


def ring(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_clip_keeps_inside_and_is_idempotent(spark):
    r = raster(spark, np.ones((8, 8)))
    once = r.clip(polygon(ring(2, 2, 6, 6)))
    got = array(once)
    assert got.sum() == 4 * 5 and got[2:6, 2:7].all()  # rows 2 to 5; columns 2 to 6, both ends
    assert np.array_equal(got, array(once.clip(polygon(ring(2, 2, 6, 6)))))


def test_clips_in_a_row_intersect(spark):
    r = raster(spark, np.ones((8, 8))).clip(polygon(ring(0, 0, 4, 8))).clip(polygon(ring(3, 0, 8, 8)))
    assert set(np.nonzero(array(r))[1]) == {3, 4}


def test_holes_only_on_demand(spark):
    shape = polygon(ring(0, 0, 8, 8), ring(2, 2, 6, 6))
    r = raster(spark, np.ones((8, 8)))
    assert array(r.clip(shape)).all()
    assert not array(r.clip(shape, holes=True))[3, 4]


def test_bad_and_outside_polygons(spark):
    r = raster(spark, np.ones((4, 4)))
    with pytest.raises(ValueError):
        r.clip("{not json")
    assert not array(r.clip(json.dumps({"type": "Point", "coordinates": [1, 1]}))).any()
    assert not array(r.clip(polygon(ring(50, 50, 60, 60)))).any()


def test_masks_leave_pixels_where_they_are(spark):
    """The polygons' spans are broadcast; pixels are neither broadcast nor exchanged before they are summed up."""
    r = raster(spark, np.ones((8, 8)))
    plan = plan_of(r.clip(polygon(ring(2, 2, 6, 6))).pixels)
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "Exchange hash" not in plan and "Sort " not in plan
    zonal = plan_of(r.zonal_stats(polygon(ring(2, 2, 6, 6))))
    assert zonal.count("BroadcastHashJoin") == 2 == zonal.count("BuildRight") and zonal.count("Exchange hashpartitioning(zone") == 1 == zonal.count("Exchange hash")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 2), st.integers(0, 12), st.integers(0, 6)), max_size=12))
def test_swept_spans_are_the_largest_zones(spans):
    spans = [(z, y, a, a + n) for z, y, a, n in spans]
    got = {}
    for z, y, a, b in vector.swept(np.array(spans, np.int64).reshape(-1, 4)).tolist():
        for x in range(a, b + 1):
            assert (y, x) not in got
            got[y, x] = z
    want = {}
    for z, y, a, b in spans:
        for x in range(a, b + 1):
            want[y, x] = max(want.get((y, x), 0), z)
    assert got == want


def test_large_covers_are_made_by_tasks(spark, monkeypatch):
    """Beyond the limit tasks make the spans, by bands of rows, and the join shuffles: the same pixels."""
    rng = np.random.default_rng(8)
    header = Header(40, 200, (0.0, 1.0, 0.0, 200.0, 0.0, -1.0))
    shapes = [[[(float(a), float(b)) for a, b in rng.uniform(0, 40, (5, 2)) * (1, 5)]] for _ in range(12)]
    few = vector.cover(spark, shapes, header)
    monkeypatch.setattr(vector, "SPANS", 10)
    many = vector.cover(spark, shapes, header)
    assert few.few and not many.few and sorted(map(tuple, few.spans.collect())) == sorted(map(tuple, many.spans.collect()))
    pixels = spark.range(40 * 200).selectExpr("cast(id / 40 as int) y", "cast(id % 40 as int) x", "cast(id as double) b1")
    text = json.dumps({"type": "MultiPolygon", "coordinates": [[[list(header.to_geo(*p)) for p in ring_]] for (ring_,) in shapes]})
    r = Raster(pixels, header)
    large = sorted(map(str, r.zonal_stats(text).collect()))
    monkeypatch.undo()
    assert large == sorted(map(str, r.zonal_stats(text).collect()))
    monkeypatch.setattr(vector, "STEP", 7)
    assert large == sorted(map(str, r.zonal_stats(text).collect()))


def test_rotated_transform_inverts():
    h = Header(5, 5, (3.0, 1.0, 0.2, 9.0, 0.1, -1.0))
    assert np.allclose(h.to_pixel(*h.to_geo(2.5, 3.25)), (2.5, 3.25))


def test_zonal(spark):
    r = raster(spark, np.arange(64.0).reshape(8, 8))
    shapes = json.dumps({"type": "GeometryCollection", "geometries": [json.loads(polygon(ring(0, 4, 3, 8))), json.loads(polygon(ring(2, 4, 7, 8))), json.loads(polygon(ring(90, 90, 95, 95)))]})
    rows = {z.zone_id: z for z in r.zonal_stats(shapes).collect()}
    # rows 0 to 3; of columns 0 to 3 the last two belong to the second zone
    a, b = np.arange(64.0).reshape(8, 8)[0:4, 0:2], np.arange(64.0).reshape(8, 8)[0:4, 2:8]
    assert (rows[1]["count"], rows[1]["sum"], rows[1]["min"], rows[1]["max"]) == (a.size, a.sum(), a.min(), a.max())
    assert rows[2]["count"] == b.size and rows[2].std_dev == pytest.approx(b.std())
    assert (rows[3]["count"], rows[3]["sum"], rows[3]["min"], rows[3]["mean"]) == (0, 0.0, None, None)
    assert r.zonal_stats(shapes, ["mean", "count"]).columns == ["zone_id", "mean", "count"]
    with pytest.raises(ValueError):
        r.zonal_stats(shapes, band=2)
    with pytest.raises(ValueError):
        r.zonal_stats(shapes, ["mode"])


def stack(spark, grids):
    return RasterStack([raster(spark, g) for g in grids])


def test_temporal(spark):
    y, x = np.mgrid[0:3, 0:4]
    grids = [x + 10.0 * y + (x - y) * t for t in range(4)]
    s = stack(spark, grids)
    cube = np.stack(grids)
    want = {
        "diff": cube[3] - cube[0], "anomaly_mean": cube[0] - cube.mean(0), "anomaly_baseline": cube[0] - cube[3], "trend": (x - y).astype(float), "mean": cube.mean(0), "std": cube.std(0), "min": cube.min(0), "max": cube.max(0),
        "ratio": cube[3] / (cube[0] + 1e-6),
    }
    for op, grid in want.items():
        assert np.allclose(array(s.temporal(op)), grid, rtol=1e-5, atol=1e-4), op
    assert np.allclose(array(s.temporal("diff", 0, 2)), -array(s.temporal("diff", 2, 0)))
    assert np.allclose(array(s.temporal("trend", time_values=[1, 1, 1, 1])), 0)
    with pytest.raises(ValueError):
        s.temporal("mode")
    with pytest.raises(ValueError):
        s.temporal("diff", 0, 9)
    with pytest.raises(ValueError):
        s.to_memory()


def test_a_stack_of_one_table(spark):
    """One table of scenes is scanned once, and gives what single scenes give."""
    grids = [with_gaps((4, 5), k) for k in range(3)]
    scenes = stack(spark, grids)
    rows = None
    for k, r in enumerate(scenes.scenes):
        part = r.pixels.selectExpr(f"{k} as scene", "y", "x", "b1")
        rows = part if rows is None else rows.unionByName(part)
    path = f"{shared_folder(spark)}/one-table"
    rows.write.mode("overwrite").parquet(path)
    one = RasterStack.of(spark.read.parquet(path), 3, scenes.header)
    assert plan_of(one.algebra("B1 * 2").temporal("mean").pixels).count("FileScan") == 1
    for op in ("mean", "diff", "trend", "std"):
        a, b = (sorted((r.y, r.x, None if r.b1 is None else round(r.b1, 9)) for r in s.algebra("B1 * 2").temporal(op).pixels.collect()) for s in (one, scenes))
        assert a == b
    flat = one.header.with_(crs="EPSG:3857")
    both = (RasterStack.of(spark.read.parquet(path), 3, flat), RasterStack([Raster(r.pixels, flat) for r in scenes.scenes]))
    a, b = (sorted(map(str, s.reproject("EPSG:3857", 2.0, 2.0, "nearest").temporal("max").pixels.collect())) for s in both)
    assert a == b


@pytest.mark.parametrize("op", ["diff", "ratio", "anomaly_mean", "anomaly_baseline", "trend", "mean", "std", "min", "max"])
def test_scenes_side_by_side(spark, op):
    """A column a scene gives what single scenes give, without an exchange."""
    grids = [with_gaps((5, 6), k, 0.4) for k in range(3)]
    scenes = stack(spark, grids)
    rows = [(y, x, *[None if math.isnan(g[y, x]) else float(g[y, x]) for g in grids]) for y in range(5) for x in range(6)]
    wide = RasterStack.wide(spark.createDataFrame(rows, "y int, x int, s0b1 double, s1b1 double, s2b1 double"), 3, scenes.header)
    got = wide.algebra("B1 + 1").temporal(op, time_values=[0, 1, 5])
    assert "Exchange" not in plan_of(got.pixels)
    a, b = (sorted((r.y, r.x, None if r.b1 is None else round(r.b1, 9)) for r in s.pixels.collect()) for s in (got, scenes.algebra("B1 + 1").temporal(op, time_values=[0, 1, 5])))
    assert a == b
    assert sorted(map(str, wide.scenes[1].pixels.collect())) == sorted(map(str, scenes.scenes[1].pixels.collect()))


def test_stacks_need_equal_grids(spark):
    with pytest.raises(ValueError):
        RasterStack([])
    with pytest.raises(ValueError):
        stack(spark, [np.ones((2, 2)), np.ones((2, 3))])


@settings(max_examples=60, deadline=None)
@given(st.floats(-179, 179), st.floats(-80, 80))
def test_systems_invert(lon, lat):
    for name in ("EPSG:3857", "EPSG:3395", "EPSG:6933", "+proj=merc +lon_0=20 +ellps=clrk66"):
        assert np.allclose(crs.transform(name, "EPSG:4326", *crs.transform("EPSG:4326", name, lon, lat)), (lon, lat), atol=1e-8)
    for name, east, north in (
        ("EPSG:32632", 9, 0), ("EPSG:32732", 9, 0), ("EPSG:25832", 9, 0), ("EPSG:2154", 3, 46), ("EPSG:3034", 10, 45), ("EPSG:3035", 10, 50), ("EPSG:5070", -96, 40), ("EPSG:3577", 132, -30), ("EPSG:3413", -45, 75), ("EPSG:3031", 10, -75),
        ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996 +x_0=400000 +y_0=-100000", -2, 52), ("+proj=lcc +lat_1=40 +lon_0=0", 0, 40), ("+proj=laea +lat_0=-30 +lon_0=25 +ellps=sphere", 25, -30),
    ):
        at = east + lon / 30, north + lat / 12
        assert np.allclose(crs.transform(name, "EPSG:4326", *crs.transform("EPSG:4326", name, *at)), at, atol=1e-7), name


def test_known_places():
    """Worked examples of the projections' descriptions."""
    assert crs.transform("EPSG:4326", "EPSG:32632", 9.0, 0.0) == pytest.approx((500000, 0), abs=1e-6)
    assert crs.transform("EPSG:4326", "EPSG:3857", 180, 0)[0] == pytest.approx(20037508.342789244)
    assert crs.transform("EPSG:4258", "EPSG:3035", 5.0, 50.0) == pytest.approx((3962799.45, 2999718.85), abs=0.01)
    assert crs.transform("EPSG:4326", "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", 120, -75) == pytest.approx((7255380.79, 7053389.56), abs=0.02)
    assert crs.transform("EPSG:4326", "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75, 35) == pytest.approx((1885472.7, 1535925.0), abs=0.1)
    assert crs.transform("EPSG:4326", "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75, 35) == pytest.approx((1894410.9, 1564649.5), abs=0.1)
    assert crs.transform("EPSG:4326", "+proj=merc +lon_0=-180 +ellps=clrk66", -75, 35) == pytest.approx((11688673.7, 4139145.6), abs=0.1)
    texas = "+proj=lcc +lat_1=28.383333333333333 +lat_2=30.283333333333333 +lat_0=27.833333333333332 +lon_0=-99 +x_0=2000000 +a=20925832.16 +rf=294.97870"
    assert crs.transform("EPSG:4326", texas, -96, 28.5) == pytest.approx((2963503.91, 254759.80), abs=0.02)
    for bad in ("EPSG:99999", "nonsense", "+proj=robin", "+proj=lcc", "+proj=stere +lat_0=10"):
        with pytest.raises(ValueError):
            crs.system(bad)


def test_equal_areas():
    """Small squares have the same area wherever they lie."""
    for name in ("EPSG:6933", "EPSG:3035", "EPSG:5070", "EPSG:3577"):
        sizes = []
        for lon, lat in ((12.0, 40.0), (20.0, 55.0), (5.0, 65.0)):
            d = 1e-4
            (xa, ya), (xb, yb), (xc, yc) = (crs.transform("EPSG:4326", name, lon + a * d, lat + b * d) for a, b in ((0, 0), (1, 0), (0, 1)))
            s = crs.system(name)
            q = s.q(math.radians(lat + d)) - s.q(math.radians(lat))
            sizes.append(abs((xb - xa) * (yc - ya) - (xc - xa) * (yb - ya)) / q)
        assert np.allclose(sizes, sizes[0], rtol=1e-4), name


def test_mercator_comes_round_beyond_a_pole():
    """Every half turn of latitude has the same places; on a sphere these are the SQL's ``asinh(tan(lat))``."""
    lat = np.array([-89.0, -37.5, 0.0, 12.25, 88.0])
    for name in ("EPSG:3857", "EPSG:3395"):
        _, there = crs.transform("EPSG:4326", name, 10.0, lat)
        for turns in (-4, -1, 1, 3):
            assert np.allclose(crs.transform("EPSG:4326", name, 10.0, lat + 180 * turns)[1], there, rtol=1e-9, atol=1e-3)
    assert np.allclose(crs.transform("EPSG:4326", "EPSG:3857", 0.0, lat)[1], 6378137.0 * np.arcsinh(np.tan(np.radians(lat))), rtol=1e-12)
    assert np.isfinite(crs.transform("EPSG:4326", "EPSG:3857", 0.0, np.array([-548.0, -90.0, 90.0]))[1]).all()


def test_target_of_a_box_beyond_a_pole():
    """Rows that go on to a place north of the first give northward steps; boxes without a height or coordinates are an error."""
    north = Header(20, 100, (10.0, 0.01, 0.0, 52.0, 0.0, -1.5), "EPSG:4326")
    to = warp.target_header(north, "EPSG:3857")
    assert (to.width, to.height) == (20, 100) and to.transform[5] > 0
    assert to.transform[3] == crs.transform("EPSG:4326", "EPSG:3857", 10.0, 52.0)[1]
    within = warp.target_header(north.with_(height=60), "EPSG:3857")
    assert within.transform[5] < 0 and within.transform[3] == to.transform[3]
    for h in (north.with_(crs="EPSG:3857", transform=(0.0, 1.0, 0.0, math.nan, 0.0, -1.0)), north.with_(height=0)):
        with pytest.raises(ValueError, match="empty or has no coordinates"):
            warp.target_header(h, "EPSG:3857")
    assert warp.target_header(north, "EPSG:3857", 10, 10, (0.0, 0.0, 100.0, 0.0)).height == 1


def test_reproject_to_itself_changes_nothing(spark):
    r = raster(spark, RANDOM, "EPSG:3857")
    for kind in ("nearest", "bilinear"):
        assert np.allclose(array(r.reproject("EPSG:3857", resampling=kind)), RANDOM, atol=1e-4)


@pytest.mark.parametrize("kind", ["nearest", "bilinear"])
@pytest.mark.parametrize("target", ["EPSG:3857", "EPSG:32632", "EPSG:3035", "EPSG:4326"])
def test_reproject_by_hand(spark, kind, target):
    """Every pixel from its own coordinates, over many blocks, with nulls; scattered input in any order."""
    grid = with_gaps((23, 31), 6, 0.1)
    header = Header(31, 23, (9.5, 0.02, 0.0, 52.0, 0.0, -0.03), "EPSG:4326")
    r = raster(spark, grid, header.crs, header.transform)
    to = warp.target_header(header, target, *((0.013, 0.017) if target == "EPSG:4326" else (1400.0, 1900.0)))
    got = {(p.y, p.x): p.b1 for p in warp.reproject(r.pixels.repartition(5), header, to, kind, fill=False, block=8).collect()}
    assert len(got) == to.width * to.height
    seen = 0
    for (y, x), v in got.items():
        fx, fy = header.to_pixel(*crs.transform(target, header.crs, *to.to_geo(x, y)))
        want = None
        if -1e-6 <= fx < 31 - 1e-6 and -1e-6 <= fy < 23 - 1e-6:
            at = lambda c, d: grid[min(max(int(d), 0), 22), min(max(int(c), 0), 30)]
            a, b = math.floor(fx), math.floor(fy)
            wx, wy = fx - a, fy - b
            if kind == "nearest":
                want = at(math.floor(fx + 0.5), math.floor(fy + 0.5))
            else:
                parts = [(wx * wy, at(a + 1, b + 1)), (wx * (1 - wy), at(a + 1, b)), ((1 - wx) * wy, at(a, b + 1)), ((1 - wx) * (1 - wy), at(a, b))]
                want = sum(w * p for w, p in parts if w)
            want = None if math.isnan(want) else want
            seen += want is not None
        assert v is None if want is None else v == pytest.approx(want, abs=1e-6), (y, x)
    assert seen > 100


def test_reprojection_reads_what_it_needs(spark):
    """A small extent leaves most of the source unread, by a filter on its rows and columns."""
    r = raster(spark, RANDOM, "EPSG:3857")
    big = Raster(r.pixels, r.header.with_(width=7000, height=7000, transform=(0.0, 1.0, 0.0, 7000.0, 0.0, -1.0)))
    plan = plan_of(big.reproject("EPSG:3857", 1, 1, extent=(3000, 3000, 3100, 3100)).pixels)
    low, high = (int(v) for v in __import__("re").search(r"\(y#\d+ >= (\d+)\) AND \(y#\d+ <= (\d+)\)", plan).groups())
    assert 3880 < low <= 3900 and 4000 <= high < 4020


def test_nodata_passes_through_algebra(spark):
    r = raster(spark, RANDOM, "EPSG:3857").reproject("EPSG:3857", 1, 1, extent=(-2, 0, 7, 7)).algebra("B1 * 2 + 1")
    got = array(r)
    assert (got[:, :2] == -9999).all() and np.allclose(got[:, 2:], RANDOM * 2 + 1, atol=1e-3)


def test_texture_of_constant_ground(spark):
    out = array(raster(spark, np.full((5, 5), 3.0)).texture(["asm", "entropy", "contrast"], window=3, levels=4))
    assert np.allclose(out[0], 1) and np.allclose(out[1:], 0)


def brute_texture(levels_of, n, radius):
    """All features of each pixel by the definitions, over dense matrices; nulls are -1; the mean of the directions that have pairs."""
    h, w = levels_of.shape
    i, j = np.mgrid[0:n, 0:n]
    at = lambda y, x: levels_of[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    log = lambda v: np.log2(v + 1e-10)
    ent = lambda v: -sum(q * math.log2(q) for q in v.ravel() if q > 1e-10)
    out = {}
    for y in range(h):
        for x in range(w):
            found = []
            for dx, dy in texture.DIRECTIONS:
                m = np.zeros((n, n))
                for oy in range(-radius, radius + 1):
                    for ox in range(-radius, radius + 1):
                        a, b = at(y + oy, x + ox), at(y + oy + dy, x + ox + dx)
                        if a >= 0 and b >= 0:
                            m[a, b] += 1
                            m[b, a] += 1
                if not m.sum():
                    continue
                p = m / m.sum()
                px = p.sum(1)
                mu = (i * p).sum()
                var = max(((i - mu) ** 2 * p).sum(), 1e-10)
                sums = np.array([p[i + j == k].sum() for k in range(2 * n - 1)])
                diffs = np.array([p[abs(i - j) == k].sum() for k in range(n)])
                k = np.arange(2 * n - 1)
                hx, hxy = -(px * log(px)).sum(), ent(p)
                outer = px[:, None] * px[None, :]
                h1, h2 = -(p * log(outer)).sum(), -(outer * log(outer)).sum()
                found.append([
                    (p * p).sum(), ((i - j) ** 2 * p).sum(), ((i * j * p).sum() - mu * mu) / var if var > 2e-10 else 0.0, ((i - mu) ** 2 * p).sum(), (p / (1 + (i - j) ** 2)).sum(), (k * sums).sum(), ((k - (k * sums).sum()) ** 2 * sums).sum(), ent(sums), hxy,
                    (np.arange(n) ** 2 * diffs).sum(), ent(diffs), (abs(i - j) * p).sum(), (i * j * p).sum(), p.max(), ((i + j - 2 * mu) ** 3 * p).sum(), ((i + j - 2 * mu) ** 4 * p).sum(), (hxy - h1) / hx if hx > 1e-10 else 0.0, math.sqrt(max(0.0, 1 - math.exp(-2 * (h2 - hxy)))),
                ])
            out[y, x] = np.mean(found, axis=0) if found and levels_of[y, x] >= 0 else None
    return out


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_texture_by_hand(spark, gaps):
    grid = with_gaps((9, 8), 2, gaps)
    if gaps:
        grid[:5, :5] = np.nan
        grid[1, 1] = 7.0  # a pixel without pairs
    low, high = np.nanmin(grid), np.nanmax(grid)
    q = np.where(np.isnan(grid), -1, np.clip((np.nan_to_num(grid) - low) / (high - low) * 4, 0, 3).astype(int))
    want = brute_texture(q, 4, 1)
    r = raster(spark, grid)
    for block in (4, 64):
        rows = texture.texture(r.pixels, r.header, (), 3, 4, block=block).collect()
        assert len(rows) == 72
        for p in rows:
            v = want[p.y, p.x]
            assert tuple(p)[2:] == (None,) * 18 if v is None else np.allclose(np.array(tuple(p)[2:], float), v, atol=2e-5), (p.y, p.x)


def test_texture_on_a_log_scale(spark):
    grid = 10.0 ** np.random.default_rng(7).uniform(-2, 3, (7, 7))
    grid[0, 0], grid[3, 3] = 0.0, -5.0
    logs = np.where(grid > 0, 10 * np.log10(np.maximum(grid, 1e-300)), -100.0)
    a, b = (array(r.texture(["contrast", "asm"], window=3, levels=8, log_scale=k)) for r, k in ((raster(spark, grid), True), (raster(spark, logs), False)))
    assert np.allclose(a, b)


def test_texture_options(spark):
    r = raster(spark, RANDOM - 50)
    assert len(r.texture(["asm"], window=3, levels=4, direction_mode="separate").pixels.columns) == 6
    assert np.allclose(array(r.texture(["asm"], window=2, levels=4)), array(r.texture(["asm"], window=3, levels=4)))
    assert array(r.texture(["asm"], window=3, levels=4, log_scale=True)).shape == (7, 7)
    for bad in ({"features": ["blur"]}, {"levels": 1}, {"direction_mode": "all"}):
        with pytest.raises(ValueError):
            r.texture(**bad)


def test_chain_composes(spark):
    r = raster(spark, RANDOM)
    a = array(r.algebra("B1 * 2").focal("max", 1).algebra("B1 + 1"))
    assert np.allclose(a, 2 * array(r.focal("max", 1)) + 1)
    with pytest.raises(ValueError):
        r.algebra("B2")


def test_chunks_come_in_order(spark):
    r = raster(spark, RANDOM)
    got = list(r.iter_begin(rows=2))
    assert [c["y_offset"] for c in got] == [0, 2, 4, 6] and got[-1]["height"] == 1
    assert np.allclose(np.concatenate([c["data"] for c in got]), RANDOM)
    stream = r.iter_begin(rows=7)
    assert stream.next() is not None and stream.next() is None


def test_queue_holds_the_producer_back():
    import threading

    from rasterlake.streaming.chunks import ChunkQueue

    q = ChunkQueue(2)
    assert q.push(1) and q.push(2) and not q.push(3, timeout=0.05) and (q.size, q.utilization, q.finished) == (2, 1.0, False)
    late = threading.Timer(0.1, lambda: q.push(3))
    late.start()
    assert [q.pop(), q.pop(), q.pop(timeout=5)] == [1, 2, 3]
    with pytest.raises(TimeoutError):
        q.pop(timeout=0.05)
    q.finish(ValueError("broken"))
    with pytest.raises(ValueError, match="broken"):
        q.pop()
    assert q.pop() is None and q.finished
    q = ChunkQueue(1)
    q.push(1)
    q.close()
    assert not q.push(2) and q.pop() is None and q.size == 0
    with pytest.raises(ValueError):
        ChunkQueue(0)


def test_stream_raises_errors_of_tasks_and_stops(spark):
    r = raster(spark, RANDOM)
    broken = Raster(r.pixels.selectExpr("y", "x", "if(y = 6, raise_error('bad pixel'), b1) as b1"), r.header)
    with pytest.raises(Exception, match="bad pixel"):
        list(broken.iter_begin(rows=1))
    stream = r.iter_begin(rows=1, buffered=1)
    assert stream.next()["y_offset"] == 0 and stream.queue.capacity == 1
    stream.close()
    stream._thread.join(20)
    assert not stream._thread.is_alive() and stream.next() is None


def test_progress(spark):
    import io

    from rasterlake.streaming.progress import line, progress

    assert line(1, 4, 8) == "[==      ]  25%" and line(0, 0, 2) == "[==] 100%"
    out = io.StringIO()
    with progress(spark, out=out, every=0.01):
        spark.range(0, 100, 1, 4).selectExpr("sum(id)").collect()
    assert out.getvalue().endswith("100%\n")
    assert raster(spark, RANDOM).to_memory(verbose=True).shape == (7, 7)


def test_memory_guard(spark):
    with pytest.raises(MemoryError):
        raster(spark, RANDOM).to_memory(limit=10)
    assert raster(spark, RANDOM).get_info()["width"] == 7


def test_streaming_reduction(spark, tmp_path):
    from rasterlake.streaming.chunks import arriving

    for k, g in enumerate((RANDOM, RANDOM + 2)):
        raster(spark, g).pixels.write.parquet(str(tmp_path / f"scenes/{k}"))
    stream = spark.readStream.schema("y int, x int, b1 double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "scenes"))
    q = arriving(stream, "mean").writeStream.outputMode("complete").format("memory").queryName("scene_means").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scene_means").where("y = 0 and x = 0").first().b1 == pytest.approx(RANDOM[0, 0] + 1)
    with pytest.raises(ValueError):
        arriving(stream, "median")

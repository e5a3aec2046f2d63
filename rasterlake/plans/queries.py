"""The raster queries by name, each with DuckDB SQL that says the same."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import focal as focals
from ..operators import temporal as temporals
from ..operators import terrain as terrains
from ..operators import texture as textures
from ..session import shared_folder
from ..streaming.chunks import strips
from . import fixtures as fx
from .raster import Raster, RasterStack

QUERIES: dict = {}
SQL: dict[str, str] = {}

BASE = {
    "orders": "SELECT (o_orderkey // 50)::INT AS y, (o_orderkey % 50)::INT AS x, o_totalprice AS b1, o_custkey::DOUBLE AS b2 FROM orders",
    "parts": "SELECT (p_partkey // 20)::INT AS y, (p_partkey % 20)::INT AS x, p_retailprice AS b1, p_size::DOUBLE AS b2 FROM part",
    "embeddings": "SELECT vec_id::INT AS y, (generate_subscripts(embedding, 1) - 1)::INT AS x, unnest(embedding)::DOUBLE AS b1 FROM embeddings",
}
WIDTH = {"orders": 50, "parts": 20, "embeddings": 64}
EVENTS = "n AS (SELECT count(*) // 5 AS n FROM events), s AS (SELECT (event_id // n)::INT AS scene, ((event_id % n) // 20)::INT AS y, ((event_id % n) % 20)::INT AS x, value AS b1 FROM events, n), k AS (SELECT max(scene) AS last FROM s)"


def _raster(name: str, spark, sf_dir: str) -> Raster:
    return {"orders": fx.orders, "parts": fx.parts, "embeddings": fx.embeddings}[name](spark, sf_dir)


def _rounded(pixels: DataFrame, digits: int = 4) -> DataFrame:
    bands = [c for c in pixels.columns if c not in ("y", "x")]
    return pixels.select("y", "x", *[F.round(b, digits).alias(b) for b in bands])


def _with(base: str) -> str:
    return f"WITH r AS ({BASE[base]}), g AS (SELECT max(y) + 1 AS h, {WIDTH[base]} AS w FROM r)"


def _add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        SQL[name] = sql


def _algebra(name: str, base: str, expression: str, sql: str) -> None:
    # the same operations on the same doubles: no rounding is needed
    _add(name, lambda spark, d: _raster(base, spark, d).algebra(expression).pixels, f"{_with(base)} SELECT y, x, ({sql})::DOUBLE AS b1 FROM r")


_algebra("algebra_ndvi", "orders", "(B1 - B2) / (B1 + B2)", "(b1 - b2) / nullif(b1 + b2 + 1e-6, 0)")
_algebra("algebra_arith", "orders", "B1 * 2 + B2 / 3 - (B1 - B2) * 0.5 - -1.5e0", "b1 * 2 + b2 / (3::DOUBLE + 1e-6::DOUBLE) - (b1 - b2) * 0.5 - (-1.5)")
_algebra("algebra_compare", "parts", "(B1 > 1200) + 2 * (B2 <= 25) + 4 * (B1 >= 1500) + 8 * (B2 < 10) + 16 * (B2 == 7) + 32 * (B2 != 7)", "(b1 > 1200)::INT + 2.0 * (b2 <= 25)::INT + 4 * (b1 >= 1500)::INT + 8 * (b2 < 10)::INT + 16 * (b2 = 7)::INT + 32 * (b2 <> 7)::INT")
_algebra("algebra_logic", "parts", "and(B2 > 10, B2 < 40) + 2 * or(B2 < 5, B2 > 45) + 4 * not(B2 == 20)", "(b2 > 10 AND b2 < 40)::INT + 2.0 * (b2 < 5 OR b2 > 45)::INT + 4 * (b2 <> 20)::INT")
_algebra("algebra_if_between_clamp", "parts", "if(between(B2, 10, 30), clamp(B1, 1000, 1500), B2)", "CASE WHEN b2 BETWEEN 10 AND 30 THEN greatest(1000.0, least(b1, 1500.0)) ELSE b2 END")
_algebra("algebra_minmax", "parts", "min(B1, B2 * 40) + max(B2, 25)", "least(b1, b2 * 40) + greatest(b2, 25.0)")
_algebra("algebra_div_eps", "parts", "B1 / (B2 - B2) + 1 / 4", "b1 / 1e-6::DOUBLE + 1::DOUBLE / (4::DOUBLE + 1e-6::DOUBLE)")


def _spans(rings: list, g: str = "g") -> str:
    """CTEs from rings to spans: edges in pixels of the grid ``g``, crossings, even-odd pairs."""
    rows = []
    for zone, ring in enumerate(rings, 1):
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if y0 != y1:
                rows.append(f"({zone}, {x0!r}::DOUBLE, {y0!r}::DOUBLE, {x1!r}::DOUBLE, {y1!r}::DOUBLE)")
    return f"""f(zone, fx0, fy0, fx1, fy1) AS (VALUES {', '.join(rows)}),
e AS (SELECT zone, fx0 * w AS x0, fy0 * h AS y0, fx1 * w AS x1, fy1 * h AS y1 FROM f, {g}),
k AS (SELECT zone, t.y, x0 + (t.y - y0) * (x1 - x0) / (y1 - y0) AS c FROM e, range(0, (SELECT h FROM {g})) AS t(y) WHERE (y0 <= t.y AND t.y < y1) OR (y1 <= t.y AND t.y < y0)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY zone, y ORDER BY c) - 1 AS i FROM k),
p AS (SELECT zone, y, greatest(trunc(min(c)), 0) AS c0, least(trunc(max(c)), (SELECT w FROM {g}) - 1) AS c1 FROM n2 GROUP BY zone, y, i // 2 HAVING count(*) = 2 AND max(c) >= 0)"""


def _clip(name: str, base: str, rings: list) -> None:
    def make(spark, d):
        r = _raster(base, spark, d)
        return _rounded(r.clip(fx.geojson(rings, r.header)).pixels)

    bands = "b1" if base == "embeddings" else "b1, b2"
    cols = ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.y = r.y AND r.x BETWEEN c0 AND c1) THEN round({b}, 4) ELSE 0.0 END AS {b}" for b in bands.split(", "))
    _add(name, make, f"{_with(base)}, {_spans(rings)} SELECT y, x, {cols} FROM r")


_clip("clip_polygon", "orders", fx.TRIANGLE)
_clip("clip_concave", "parts", fx.CONCAVE)
_clip("clip_multipolygon", "orders", fx.MULTI)


def _zonal(name: str, base: str, rings: list, kind: str = "MultiPolygon", expression: str = "B1", sql: str = "b1") -> None:
    def make(spark, d):
        r = _raster(base, spark, d)
        z = r.algebra(expression).zonal_stats(fx.geojson(rings, r.header, kind))
        return z.select("zone_id", "count", *[F.round(c, 4).alias(c) for c in ("sum", "min", "max", "mean", "std_dev")])

    _add(name, make, f"""{_with(base)}, {_spans(rings)},
v AS (SELECT r.y, r.x, max(zone) AS zone, any_value({sql}) AS v FROM r JOIN p ON p.y = r.y AND r.x BETWEEN c0 AND c1 GROUP BY r.y, r.x),
z AS (SELECT DISTINCT zone AS zone_id FROM f)
SELECT zone_id::INT AS zone_id, count(v) AS count, round(coalesce(sum(v), 0), 4) AS sum, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std_dev FROM z LEFT JOIN v ON zone = zone_id GROUP BY zone_id""")


_zonal("zonal_stats", "parts", fx.QUADRANTS, "GeometryCollection")
_zonal("zonal_overlap", "parts", fx.OVERLAP)
_zonal("zonal_empty_zone", "parts", fx.OUTSIDE)
_zonal("zonal_of_algebra", "orders", fx.TRIANGLE, expression="(B1 - B2) / (B1 + B2)", sql="(b1 - b2) / (b1 + b2 + 1e-6)")


def _around(radius: int, shape: str) -> str:
    keep = f"WHERE dx * dx + dy * dy <= {radius * radius}" if shape == "circle" else ""
    return f"""o AS (SELECT dy, dx FROM range({-radius}, {radius + 1}) AS a(dy), range({-radius}, {radius + 1}) AS b(dx) {keep}),
c AS (SELECT r.y, r.x, greatest(0, least(h - 1, r.y + dy)) AS ny, greatest(0, least(w - 1, r.x + dx)) AS nx FROM r, g, o),
n AS (SELECT c.y, c.x, q.b1 AS v FROM c JOIN r q ON q.y = ny AND q.x = nx)"""


_FOCAL_SQL = {"mean": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_samp(v)", "variance": "var_samp(v)", "median": "quantile_disc(v, 0.5)", "range": "max(v) - min(v)"}
for _stat in focals.STATS:
    for _shape, _radius in (("square", 1), ("circle", 2)):
        _add(
            f"focal_{_stat}_{_shape}",
            lambda spark, d, s=_stat, h=_shape, r=_radius: _rounded(_raster("parts", spark, d).focal(s, r, h).pixels),
            f"{_with('parts')}, {_around(_radius, _shape)} SELECT y, x, round({_FOCAL_SQL[_stat]}, 4) AS b1 FROM n GROUP BY y, x",
        )
_CUT = "o AS (SELECT dy, dx FROM range(-2, 3) AS a(dy), range(-2, 3) AS b(dx)), n AS (SELECT r.y, r.x, q.b1 AS v FROM r, o JOIN r q ON q.y = r.y + dy AND q.x = r.x + dx)"
_add("focal_mean_cut_border", lambda spark, d: _rounded(_raster("parts", spark, d).focal("mean", 2, clamp_border=False).pixels), f"{_with('parts')}, {_CUT} SELECT y, x, round(avg(v), 4) AS b1 FROM n GROUP BY y, x")
_add("focal_median_square_r3", lambda spark, d: _rounded(_raster("parts", spark, d).focal("median", 3).pixels), f"{_with('parts')}, {_around(3, 'square')} SELECT y, x, round({_FOCAL_SQL['median']}, 4) AS b1 FROM n GROUP BY y, x")

_Z = ", ".join(f"max(q.b1) FILTER (WHERE dy = {k // 3 - 1} AND dx = {k % 3 - 1}) AS z{k + 1}" for k in range(9))
_CELLS = f"""o AS (SELECT dy, dx FROM range(-1, 2) AS a(dy), range(-1, 2) AS b(dx)),
c AS (SELECT r.y, r.x, dy, dx, greatest(0, least(h - 1, r.y + dy)) AS ny, greatest(0, least(w - 1, r.x + dx)) AS nx FROM r, g, o),
z AS (SELECT c.y, c.x, {_Z} FROM c JOIN r q ON q.y = ny AND q.x = nx GROUP BY c.y, c.x),
m AS (SELECT *, ((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) / 8 AS p, ((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3)) / 8 AS q, ((z1 + z3 + z4 + z6 + z7 + z9) / 2 - (z2 + z5 + z8)) / 3 AS a,
  ((z1 + z2 + z3 + z7 + z8 + z9) / 2 - (z4 + z5 + z6)) / 3 AS c, (-z1 + z3 + z7 - z9) / 4 AS b, (-z1 - z4 - z7 + z3 + z6 + z9) / 6 AS d, (z7 + z8 + z9 - z1 - z2 - z3) / 6 AS e FROM z),
s AS (SELECT *, atan(sqrt(p * p + q * q)) AS slope, CASE WHEN atan2(-q, p) < 0 THEN atan2(-q, p) + 2 * pi() ELSE atan2(-q, p) END AS angle, d * d + e * e AS g2 FROM m)"""
_TERRAIN_SQL = {
    "slope": "degrees(slope)", "aspect": "CASE WHEN slope < 1e-6 THEN -9999.0 WHEN 90 - degrees(angle) < 0 THEN 450 - degrees(angle) ELSE 90 - degrees(angle) END",
    "hillshade": f"greatest(0.0, 255 * ({math.cos(math.pi / 4)!r} * cos(slope) + {math.sin(math.pi / 4)!r} * sin(slope) * cos({math.radians(315)!r} - angle)))",
    "tri": "sqrt(" + " + ".join(f"(z{k} - z5) * (z{k} - z5)" for k in (1, 2, 3, 4, 6, 7, 8, 9)) + ")", "tpi": "z5 - (z1 + z2 + z3 + z4 + z6 + z7 + z8 + z9) / 8",
    "roughness": "greatest(z1, z2, z3, z4, z5, z6, z7, z8, z9) - least(z1, z2, z3, z4, z5, z6, z7, z8, z9)", "prof_curv": "CASE WHEN g2 > 1e-10 THEN -2 * (a * d * d + c * e * e + b * d * e) / (g2 * g2) ELSE 0.0 END",
    "plan_curv": "CASE WHEN g2 > 1e-10 THEN -2 * (a * e * e - b * d * e + c * d * d) / g2 ELSE 0.0 END", "total_curv": "2 * (a + c)",
}
for _metric in terrains.METRICS:
    _add(f"terrain_{_metric}", lambda spark, d, m=_metric: _rounded(_raster("parts", spark, d).terrain([m]).pixels), f"{_with('parts')}, {_CELLS} SELECT y, x, round({_TERRAIN_SQL[_metric]}, 4) AS b1 FROM s")
_add("terrain_slope_percent", lambda spark, d: _rounded(_raster("embeddings", spark, d).terrain(["slope"], unit="percent").pixels), f"{_with('embeddings')}, {_CELLS} SELECT y, x, round(100 * tan(slope), 4) AS b1 FROM s")
_add("terrain_slope_radians", lambda spark, d: _rounded(_raster("embeddings", spark, d).terrain(["slope"], unit="radians").pixels), f"{_with('embeddings')}, {_CELLS} SELECT y, x, round(slope, 4) AS b1 FROM s")
_add("terrain_slope_zevenbergen", lambda spark, d: _rounded(_raster("embeddings", spark, d).terrain(["slope"], method="zevenbergen").pixels), f"{_with('embeddings')}, {_CELLS} SELECT y, x, round(degrees(atan(sqrt(((z6 - z4) / 2) ** 2 + ((z8 - z2) / 2) ** 2))), 4) AS b1 FROM s")
_add("terrain_multi", lambda spark, d: _rounded(_raster("parts", spark, d).terrain(["tpi", "slope", "roughness"]).pixels), f"{_with('parts')}, {_CELLS} SELECT y, x, round({_TERRAIN_SQL['tpi']}, 4) AS b1, round({_TERRAIN_SQL['slope']}, 4) AS b2, round({_TERRAIN_SQL['roughness']}, 4) AS b3 FROM s")

_AT = "max(b1) FILTER (WHERE scene = {})"
_LAST = "(SELECT last FROM k)"
_TEMPORAL_SQL = {
    "diff": f"{_AT.format(_LAST)} - {_AT.format(0)}", "ratio": f"{_AT.format(_LAST)} / nullif({_AT.format(0)} + 1e-6, 0)", "anomaly_mean": f"{_AT.format(0)} - avg(b1)", "anomaly_baseline": f"{_AT.format(0)} - {_AT.format(_LAST)}",
    "trend": "regr_slope(b1, scene)", "mean": "avg(b1)", "std": "stddev_pop(b1)", "min": "min(b1)", "max": "max(b1)",
}
for _op in temporals.OPS:
    _add(f"temporal_{_op}", lambda spark, d, o=_op: _rounded(fx.events(spark, d).temporal(o).pixels), f"WITH {EVENTS} SELECT y, x, round({_TEMPORAL_SQL[_op]}, 4) AS b1 FROM s GROUP BY y, x")
_add("stack_algebra_temporal", lambda spark, d: _rounded(fx.events(spark, d).algebra("(B1 - 10) / (B1 + 10)").temporal("mean").pixels), f"WITH {EVENTS} SELECT y, x, round(avg((b1 - 10) / nullif(b1 + 10 + 1e-6, 0)), 4) AS b1 FROM s GROUP BY y, x")

GEOGRAPHIC = (10.0, 0.01, 0.0, 52.0, 0.0, -0.01)


def _geographic(spark, d) -> Raster:
    r = _raster("parts", spark, d)
    return Raster(r.pixels.select("y", "x", "b1"), r.header.with_(transform=GEOGRAPHIC, crs="EPSG:4326"))


def _reprojected(resampling: str, extent: tuple | None = None, res: float = 0.0):
    return lambda spark, d: _rounded(_geographic(spark, d).reproject("EPSG:3857", res, res, resampling, extent=extent).filled())


def _target(extent: tuple | None = None, res: float = 0.0) -> str:
    """CTEs of the target's grid (``dim``) and its places (``u``: ``y, x, h, w, gx, gy``), from the source's size ``g``."""
    rad = repr(math.pi / 180 * 6378137.0)
    north = f"asinh(tan(52.0::DOUBLE * {math.pi / 180!r}::DOUBLE)) * 6378137.0"
    south = f"asinh(tan((52.0::DOUBLE + h * -0.01::DOUBLE) * {math.pi / 180!r}::DOUBLE)) * 6378137.0"
    box = f"10.0::DOUBLE * {rad}::DOUBLE AS x0, (10.0::DOUBLE + w * 0.01::DOUBLE) * {rad}::DOUBLE AS x1, ({south})::DOUBLE AS y0, ({north})::DOUBLE AS y1" if extent is None else f"{extent[0]!r}::DOUBLE AS x0, {extent[2]!r}::DOUBLE AS x1, {extent[1]!r}::DOUBLE AS y0, {extent[3]!r}::DOUBLE AS y1"
    step = f"{res!r}::DOUBLE AS rx, {res!r}::DOUBLE AS ry" if res else "(x1 - x0) / w AS rx, (y1 - y0) / h AS ry"
    return f"""box AS (SELECT {box}, h, w FROM g), st AS (SELECT *, {step} FROM box), dim AS (SELECT *, greatest(1, round_even((x1 - x0) / rx, 0))::INT AS dw, greatest(1, round_even((y1 - y0) / ry, 0))::INT AS dh FROM st),
u AS (SELECT a.y::INT AS y, b.x::INT AS x, dim.h, dim.w, x0 + b.x * rx AS gx, y1 - a.y * ry AS gy FROM dim, range(0, (SELECT dh FROM dim)) AS a(y), range(0, (SELECT dw FROM dim)) AS b(x))"""


def _mercator() -> str:
    """Degrees of ``u`` in EPSG:3857."""
    return f"SELECT y, x, h, w, gx * {180 / math.pi / 6378137.0!r}::DOUBLE AS lon, atan(sinh(gy * {1 / 6378137.0!r}::DOUBLE)) * {180 / math.pi!r}::DOUBLE AS lat FROM u"


def _utm(zone: int) -> str:
    """Degrees of ``u`` in a northern UTM zone, by Krueger's series of the third flattening."""
    n = 1 / (2 * 298.257223563 - 1)
    radius = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi, eta, lat = "xi", "eta", "chi"
    for j, b in ((2, n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96), (4, n**2 / 48 + n**3 / 15), (6, 17 * n**3 / 480)):
        xi += f" - {b!r}::DOUBLE * sin({j} * xi) * cosh({j} * eta)"
        eta += f" - {b!r}::DOUBLE * cos({j} * xi) * sinh({j} * eta)"
    for j, d in ((2, 2 * n - 2 * n**2 / 3 - 2 * n**3), (4, 7 * n**2 / 3 - 8 * n**3 / 5), (6, 56 * n**3 / 15)):
        lat += f" + {d!r}::DOUBLE * sin({j} * chi)"
    return f"""SELECT y, x, h, w, degrees(atan2(sinh(eta1), cos(xi1))) + {zone * 6 - 183.0!r} AS lon, degrees({lat}) AS lat FROM (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM (SELECT *, {xi} AS xi1, {eta} AS eta1
FROM (SELECT *, gy / {radius!r}::DOUBLE AS xi, (gx - 500000.0) / {radius!r}::DOUBLE AS eta FROM u)))"""


def _looked(degrees: str) -> str:
    """CTEs from the target's places to the source's (``t``)."""
    return f"""l AS ({degrees}), q AS (SELECT y, x, h, w, (lon - 10.0::DOUBLE) / 0.01::DOUBLE AS fx, (lat - 52.0::DOUBLE) / -0.01::DOUBLE AS fy FROM l),
t AS (SELECT *, fx >= -1e-6 AND fx < w - 1e-6 AND fy >= -1e-6 AND fy < h - 1e-6 AS inside FROM q)"""


_NEAREST = "inside AND r.x = greatest(0, least(w - 1, floor(fx + 0.5))) AND r.y = greatest(0, least(h - 1, floor(fy + 0.5)))"
_FOUR = """four AS (SELECT t.*, i, j, CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS wt FROM t, range(0, 2) AS a(i), range(0, 2) AS b(j))
SELECT four.y, four.x, round(coalesce(sum(wt * r.b1), -9999.0), 4) AS b1 FROM four LEFT JOIN r ON inside AND r.x = greatest(0, least(w - 1, floor(fx) + i)) AND r.y = greatest(0, least(h - 1, floor(fy) + j)) GROUP BY four.y, four.x"""


def _reproject_sql(resampling: str, extent: tuple | None = None, res: float = 0.0, degrees: str | None = None) -> str:
    pick = f" SELECT t.y, t.x, round(coalesce(r.b1, -9999.0), 4) AS b1 FROM t LEFT JOIN r ON {_NEAREST}" if resampling == "nearest" else f", {_FOUR}"
    return f"{_with('parts')}, {_target(extent, res)}, {_looked(degrees or _mercator())}{pick}"


_EXTENT = (1113000.0, 6780000.0, 1125000.0, 6801000.0)
for _kind in ("nearest", "bilinear"):
    _add(f"reproject_{_kind}", _reprojected(_kind), None)
_add("reproject_extent", _reprojected("bilinear", _EXTENT, 700.0), _reproject_sql("bilinear", _EXTENT, 700.0))
_add("reproject_nodata", _reprojected("nearest", _EXTENT, 900.0), _reproject_sql("nearest", _EXTENT, 900.0))
SQL["reproject_bilinear"] = _reproject_sql("bilinear")
SQL["reproject_nearest"] = _reproject_sql("nearest")

_ZONE = (568000.0, 5740000.0, 583000.0, 5764000.0)
_add("reproject_utm", lambda spark, d: _rounded(_geographic(spark, d).reproject("EPSG:32632", 700.0, 700.0, extent=_ZONE).filled()), _reproject_sql("bilinear", _ZONE, 700.0, _utm(32)))


def _stacked(spark, d) -> DataFrame:
    s = fx.events(spark, d)
    scenes = [Raster(r.pixels, r.header.with_(transform=GEOGRAPHIC, crs="EPSG:4326")) for r in s.scenes]
    return _rounded(RasterStack(scenes).reproject("EPSG:3857", 900.0, 900.0, "nearest", extent=_EXTENT).temporal("mean").filled())


_add(
    "stack_reproject_temporal", _stacked,
    f"""WITH {EVENTS}, g AS (SELECT (n - 1) // 20 + 1 AS h, 20 AS w FROM n), {_target(_EXTENT, 900.0)}, {_looked(_mercator())}
SELECT t.y, t.x, round(coalesce(avg(r.b1), -9999.0), 4) AS b1 FROM t LEFT JOIN s AS r ON {_NEAREST} GROUP BY t.y, t.x""",
)

_LEVELS, _WINDOW = 8, 5


def _matrices(window: int, value: str = "b2") -> str:
    """CTEs to the cells ``p`` of each pixel's matrix in each direction ``k``."""
    r = window // 2
    return f"""{_with('parts')}, val AS (SELECT y, x, {value} AS v FROM r), mm AS (SELECT min(v) AS lo, CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1.0 END AS span FROM val),
l AS (SELECT y, x, trunc(greatest(0.0, least({_LEVELS - 1}.0, (v - lo) / span * {_LEVELS})))::INT AS q FROM val, mm),
d(k, dx, dy) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1)),
o AS (SELECT oy, ox FROM range({-r}, {r + 1}) AS a(oy), range({-r}, {r + 1}) AS b(ox)),
c AS (SELECT l.y, l.x, k, greatest(0, least(h - 1, l.y + oy)) AS ay, greatest(0, least(w - 1, l.x + ox)) AS ax, greatest(0, least(h - 1, l.y + oy + dy)) AS cy, greatest(0, least(w - 1, l.x + ox + dx)) AS cx FROM l, g, o, d),
t AS (SELECT c.y, c.x, k, m.q AS a, n.q AS b FROM c JOIN l m ON m.y = ay AND m.x = ax JOIN l n ON n.y = cy AND n.x = cx),
s AS (SELECT y, x, k, a AS i, b AS j FROM t UNION ALL SELECT y, x, k, b, a FROM t),
p AS (SELECT y, x, k, i, j, count(*) / {2.0 * window * window} AS p FROM s GROUP BY ALL)"""


_PLOGP = "-sum(CASE WHEN {0} > 1e-10 THEN {0} * log2({0}) ELSE 0 END)"
_OF_CELLS = {
    "asm": "sum(p * p)", "contrast": "sum((i - j) ** 2 * p)", "homogeneity": "sum(p / (1 + (i - j) ** 2))", "entropy": _PLOGP.format("p"),
    "dissimilarity": "sum(abs(i - j) * p)", "autocorrelation": "sum(i * j * p)", "max_probability": "max(p)",
}


def _glcm_sql(feature: str, value: str = "b2") -> str:
    return f"""{_matrices(_WINDOW, value)}, e AS (SELECT y, x, k, {_OF_CELLS[feature]} AS v FROM p GROUP BY y, x, k)
SELECT y, x, round(avg(v), 4) AS b1 FROM e GROUP BY y, x"""


def _glcm_all_sql() -> str:
    """All features: from cells, from sums' and differences' shares, from marginals, and from cells with both marginals."""
    own = ", ".join(f"{v} AS {k}" for k, v in _OF_CELLS.items())
    final = {
        **{k: k for k in _OF_CELLS}, "correlation": "CASE WHEN greatest(variance, 1e-10) > 2e-10 THEN (autocorrelation - mu * mu) / greatest(variance, 1e-10) ELSE 0 END",
        "imc1": "CASE WHEN hx > 1e-10 THEN (entropy - hxy1) / hx ELSE 0 END", "imc2": "sqrt(greatest(0.0, 1 - exp(-2 * (hxy2 - entropy))))",
    }
    bands = ", ".join(f"round(avg({final.get(f, f)}), 4) AS b{n}" for n, f in enumerate(textures.FEATURES, 1))
    return f"""{_matrices(_WINDOW)}, m AS (SELECT y, x, k, sum(i * p) AS mu FROM p GROUP BY y, x, k),
cells AS (SELECT y, x, k, any_value(mu) AS mu, {own}, sum((i - mu) ** 2 * p) AS variance, sum((i + j - 2 * mu) ** 3 * p) AS cluster_shade, sum((i + j - 2 * mu) ** 4 * p) AS cluster_prominence FROM p JOIN m USING (y, x, k) GROUP BY y, x, k),
sums AS (SELECT y, x, k, sum(v * z) AS sum_average, {_PLOGP.format('v')} AS sum_entropy, sum(v * z * z) - sum(v * z) ** 2 AS sum_variance FROM (SELECT y, x, k, i + j AS z, sum(p) AS v FROM p GROUP BY ALL) GROUP BY y, x, k),
diffs AS (SELECT y, x, k, sum(v * z * z) AS diff_variance, {_PLOGP.format('v')} AS diff_entropy FROM (SELECT y, x, k, abs(i - j) AS z, sum(p) AS v FROM p GROUP BY ALL) GROUP BY y, x, k),
px AS (SELECT y, x, k, i, sum(p) AS v FROM p GROUP BY ALL), hx AS (SELECT y, x, k, -sum(v * log2(v + 1e-10)) AS hx FROM px GROUP BY y, x, k),
h1 AS (SELECT p.y, p.x, p.k, -sum(p.p * log2(a.v * b.v + 1e-10)) AS hxy1 FROM p JOIN px a ON (a.y, a.x, a.k, a.i) = (p.y, p.x, p.k, p.i) JOIN px b ON (b.y, b.x, b.k, b.i) = (p.y, p.x, p.k, p.j) GROUP BY ALL),
h2 AS (SELECT y, x, k, -sum(a.v * b.v * log2(a.v * b.v + 1e-10)) AS hxy2 FROM px a JOIN px b USING (y, x, k) GROUP BY y, x, k)
SELECT y, x, {bands} FROM cells JOIN sums USING (y, x, k) JOIN diffs USING (y, x, k) JOIN hx USING (y, x, k) JOIN h1 USING (y, x, k) JOIN h2 USING (y, x, k) GROUP BY y, x"""


def _glcm_separate_sql(features: tuple[str, ...], window: int) -> str:
    bands = ", ".join(f"round(max({f}) FILTER (WHERE k = {k}), 4) AS b{k * len(features) + n}" for k in range(4) for n, f in enumerate(features, 1))
    return f"{_matrices(window)}, e AS (SELECT y, x, k, {', '.join(f'{_OF_CELLS[f]} AS {f}' for f in features)} FROM p GROUP BY y, x, k) SELECT y, x, {bands} FROM e GROUP BY y, x"


def _sizes(spark, d) -> Raster:
    return _raster("parts", spark, d).algebra("B2")


for _feature in ("asm", "contrast", "homogeneity", "entropy", "dissimilarity", "autocorrelation", "max_probability"):
    _add(f"glcm_{_feature}", lambda spark, d, f=_feature: _rounded(_sizes(spark, d).texture([f], window=_WINDOW, levels=_LEVELS).pixels), _glcm_sql(_feature))
_add("glcm_full18", lambda spark, d: _rounded(_sizes(spark, d).texture(window=_WINDOW, levels=_LEVELS).pixels), _glcm_all_sql())
_add("glcm_log_scale", lambda spark, d: _rounded(_sizes(spark, d).texture(["contrast"], window=_WINDOW, levels=_LEVELS, log_scale=True).pixels), _glcm_sql("contrast", "CASE WHEN b2 > 0 THEN 10 * log10(b2) ELSE -100.0 END"))
_add("glcm_separate", lambda spark, d: _rounded(_sizes(spark, d).texture(["asm", "contrast"], window=3, levels=_LEVELS, direction_mode="separate").pixels), _glcm_separate_sql(("asm", "contrast"), 3))


def _chained(spark, d) -> DataFrame:
    r = _raster("parts", spark, d).algebra("B1 + B2")
    return _rounded(r.clip(fx.geojson(fx.BOX, r.header)).terrain(["slope"]).pixels)


_add(
    "chain_algebra_clip_terrain", _chained,
    f"WITH r0 AS ({BASE['parts']}), g AS (SELECT max(y) + 1 AS h, 20 AS w FROM r0), {_spans(fx.BOX)}, r AS (SELECT y, x, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.y = r0.y AND r0.x BETWEEN c0 AND c1) THEN b1 + b2 ELSE 0.0 END AS b1 FROM r0), {_CELLS.replace('m AS (', 'm2 AS (', 1).replace('FROM m)', 'FROM m2)')} SELECT y, x, round(degrees(slope), 4) AS b1 FROM s",
)


def _warped(spark, d) -> DataFrame:
    r = _geographic(spark, d).reproject("EPSG:3857", resampling="nearest").algebra("B1 * 2")
    return _rounded(r.clip(fx.geojson(fx.BOX, r.header)).filled())


_add(
    "chain_reproject_algebra_clip", _warped,
    f"""{_with('parts')}, {_target()}, {_looked(_mercator())}, g2 AS (SELECT dh AS h, dw AS w FROM dim), {_spans(fx.BOX, "g2")},
v AS (SELECT t.y, t.x, r.b1 FROM t LEFT JOIN r ON {_NEAREST})
SELECT y, x, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.y = v.y AND v.x BETWEEN c0 AND c1) THEN round(coalesce(b1 * 2, -9999.0), 4) ELSE 0.0 END AS b1 FROM v""",
)


def _histogram(spark, d) -> DataFrame:
    """Counts of ten equal bins, strip by strip."""
    r = _raster("parts", spark, d)
    parts = strips(r.pixels.select("y", "x", "b1"), r.header, 16)

    @F.pandas_udf("array<long>")
    def bins(data):
        return data.map(lambda raw: np.histogram(np.frombuffer(raw, np.float32), bins=10, range=(0, 4000))[0].tolist())

    return parts.select(F.posexplode(bins("data")).alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n"))


_add("chunk_histogram", _histogram, f"{_with('parts')}, v AS (SELECT least(9, floor(b1::FLOAT / 400))::INT AS bin FROM r WHERE b1 BETWEEN 0 AND 4000) SELECT b.bin::INT AS bin, count(v.bin)::HUGEINT::BIGINT AS n FROM range(0, 10) AS b(bin) LEFT JOIN v ON v.bin = b.bin GROUP BY b.bin")


def _written(spark, d) -> DataFrame:
    r = _raster("parts", spark, d)
    path = f"{shared_folder(spark)}/raster-{uuid.uuid4().hex}.tif"
    r.save_local(path)
    return _rounded(Raster.open(spark, path).pixels, 2)


_add("geotiff_roundtrip", _written, f"{_with('parts')} SELECT y, x, round(b1, 2) AS b1, round(b2, 2) AS b2 FROM r")

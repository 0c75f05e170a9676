"""Queries of the scalar functions (F series) and of predicates and projections (P series)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skylattice.functions import estimates, features, geo, raster, sky
from skylattice.plans.base import r, scalars
from skylattice.registry import query
from skylattice.sources import domain
from skylattice.sources.domain import raw, with_tables

c = lambda name: F.col(name)
LAT0, LON0 = 43.32, 11.33
D = lambda x: f"CAST({x!r} AS DOUBLE)"
KX = D(111320.0 * math.cos(math.radians(LAT0)))

_c30, _s30 = math.cos(math.radians(30)), math.sin(math.radians(30))
scalars(
    "F01_sim_enu", "captures", "id",
    lambda: dict(zip(("e", "n", "u", "x", "y", "z"), geo.sim_to_enu(c("e"), c("u"), c("n"), 30) + geo.enu_to_sim(c("e"), c("n"), c("u"), 30))),
    {"e": f"{D(_c30)} * e + {D(_s30)} * n", "n": f"-{D(_s30)} * e + {D(_c30)} * n", "u": "u", "x": f"{D(_c30)} * e - {D(_s30)} * n", "y": "u", "z": f"{D(_s30)} * e + {D(_c30)} * n"},
)
HEADING = "(degrees(atan2({e}, {n})) + 360) % 360"
scalars("F02_heading", "captures", "id", lambda: {"heading": geo.heading_deg(c("e"), c("n"))}, {"heading": HEADING.format(e="e", n="n")})
scalars(
    "F03_quaternion_heading", "captures", "id",
    lambda: {"heading": geo.quaternion_heading(c("e") / 500, c("n") / 700, c("u") / 40, F.lit(0.6), 0)},
    {"heading": HEADING.format(e="2 * (e / 500 * u / 40 + n / 700 * CAST(0.6 AS DOUBLE))", n="CAST(0.36 AS DOUBLE) + u / 40 * u / 40 - e / 500 * e / 500 - n / 700 * n / 700")},
)
scalars(
    "F04_quaternion_yaw", "captures", "id", lambda: {"yaw": geo.quaternion_yaw(F.sin(F.radians(c("heading") / 2)), F.cos(F.radians(c("heading") / 2)))},
    {"yaw": "(degrees(2 * atan2(sin(radians(heading / 2)), cos(radians(heading / 2)))) + 360) % 360"},
)
WRAP = "CASE WHEN ((({a}) + 180) % 360 + 360) % 360 - 180 = -180 THEN CAST(180 AS DOUBLE) ELSE ((({a}) + 180) % 360 + 360) % 360 - 180 END"
scalars("F05_wrap", "frames", "frame_id", lambda: {"d": geo.wrap_deg(c("est_heading") - c("truth_heading"))}, {"d": WRAP.format(a="est_heading - truth_heading")})
A, E2 = geo.WGS84_A, geo._E2
B = geo._B
_ll = f"SELECT id, lat, lon, radians(lat) AS p, radians(lon) AS l, {D(A)} / sqrt(1 - {D(E2)} * sin(radians(lat)) * sin(radians(lat))) AS w FROM buildings"
_x0, _y0, _z0 = geo._ecef(LAT0, LON0, 100.0, math)
_sp, _cp, _sl, _cl = math.sin(math.radians(LAT0)), math.cos(math.radians(LAT0)), math.sin(math.radians(LON0)), math.cos(math.radians(LON0))


@query(
    "F06_geodetic_enu",
    with_tables("buildings", f""", a AS ({_ll}),
d AS (SELECT id, w * cos(p) * cos(l) - {D(_x0)} AS dx, w * cos(p) * sin(l) - {D(_y0)} AS dy, w * {D(1 - E2)} * sin(p) - {D(_z0)} AS dz, lat, lon FROM a)
SELECT id, round({D(-_sl)} * dx + {D(_cl)} * dy, 3) AS e, round({D(-_sp * _cl)} * dx - {D(_sp * _sl)} * dy + {D(_cp)} * dz, 3) AS n,
  round({D(_cp * _cl)} * dx + {D(_cp * _sl)} * dy + {D(_sp)} * dz, 3) AS u, round(lat, 7) AS lat, round(lon, 7) AS lon FROM d"""),
)
def geodetic_enu(spark, sf_dir):
    """There and back again: the latitude and longitude are those of the inverse."""
    df = domain.buildings(spark, sf_dir)
    e, n, u = geo.geodetic_to_enu(c("lat"), c("lon"), F.lit(0.0), LAT0, LON0, 100.0)
    df = df.select("id", e.alias("e"), n.alias("n"), u.alias("u"))
    lat, lon, _ = geo.enu_to_geodetic(c("e"), c("n"), c("u"), LAT0, LON0, 100.0)
    return df.select("id", r(c("e"), 3).alias("e"), r(c("n"), 3).alias("n"), r(c("u"), 3).alias("u"), r(lat, 7).alias("lat"), r(lon, 7).alias("lon"))


scalars(
    "F07_small_area_geodetic", "captures", "id", lambda: dict(zip(("lat", "lon"), [x * 1000 for x in geo.enu_to_geodetic_small(c("e"), c("n"), LAT0, LON0)])),
    {"lat": f"({D(LAT0)} + n / {D(111320.0)}) * 1000", "lon": f"({D(LON0)} + e / {KX}) * 1000"},
)
scalars(
    "F08_plane_distance", "frames", "frame_id", lambda: {"d": geo.distance(c("est_e"), c("est_n"), c("truth_e"), c("truth_n"))},
    {"d": "sqrt((est_e - truth_e) * (est_e - truth_e) + (est_n - truth_n) * (est_n - truth_n))"},
)


def rings(df, side=3e-4):
    """Closed square rings (lon, lat) around the buildings' corners."""
    points = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return df.withColumn("ring", F.array(*[F.struct((c("lon") + a * side).alias("lon"), (c("lat") + b * side).alias("lat")) for a, b in points]))


@query(
    "F09_ring_to_plane",
    with_tables("buildings", f"""SELECT id, k, round((lon + dx * CAST(0.0003 AS DOUBLE) - {D(LON0)}) * {KX}, 3) AS e, round((lat + dy * CAST(0.0003 AS DOUBLE) - {D(LAT0)}) * {D(111320.0)}, 3) AS n
FROM buildings CROSS JOIN (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) v(k, dx, dy)"""),
)
def ring_to_plane(spark, sf_dir):
    flat = rings(domain.buildings(spark, sf_dir)).withColumn(
        "ring", F.transform("ring", lambda p: F.struct(*[x.alias(k) for k, x in zip("en", geo.lonlat_to_plane(p["lon"], p["lat"], LON0, LAT0))]))
    )
    return flat.select("id", F.posexplode("ring").alias("k", "p")).select("id", "k", r(c("p.e"), 3).alias("e"), r(c("p.n"), 3).alias("n"))


scalars(
    "F10_bbox", "buildings", "id",
    lambda: dict(zip(("south", "west", "north", "east"), geo.parse_bbox(F.concat_ws(",", c("lat") + 0.01, c("lon"), c("lat"), c("lon") + 0.01), 0.005))),
    {"south": "lat - CAST(0.005 AS DOUBLE)", "west": "lon - CAST(0.005 AS DOUBLE)", "north": "lat + CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE)", "east": "lon + CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE)"},
    places=7,
)
STEP = D(500.0 / 111320.0)


def _cells():
    i, j = geo.cell_index(c("lat"), c("lon"))
    south, west, north, east = geo.cell_bbox(i, j)
    return {"cell": geo.cell_id(i, j), "ilat": i, "ilon": j, "south": south, "east": east}


scalars(
    "F11_cell_key", "buildings", "id", _cells,
    {
        "cell": f"'c500_' || CAST(floor(lat / {STEP}) AS BIGINT) || '_' || CAST(floor(lon / {STEP}) AS BIGINT)", "ilat": f"CAST(floor(lat / {STEP}) AS BIGINT)", "ilon": f"CAST(floor(lon / {STEP}) AS BIGINT)",
        "south": f"floor(lat / {STEP}) * {STEP}", "east": f"(floor(lon / {STEP}) + 1) * {STEP}",
    },
    exact="cell ilat ilon",
)
scalars("F12_plane_cell", "captures", "id", lambda: dict(zip(("ce", "cn"), geo.plane_cell(c("e"), c("n"), 150.0))), {"ce": "CAST(floor(e / 150) AS BIGINT)", "cn": "CAST(floor(n / 150) AS BIGINT)"}, exact="ce cn")
scalars(
    "F13_dem_tile", "captures", "id", lambda: {"tile": geo.dem_tile(F.floor(c("e") / 20), F.floor(c("n") / 10))},
    {"tile": """'Copernicus_DSM_COG_10_' || CASE WHEN floor(e / 20) >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(CAST(abs(floor(e / 20)) AS BIGINT) AS VARCHAR), 2, '0') || '_00_'
      || CASE WHEN floor(n / 10) >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(abs(floor(n / 10)) AS BIGINT) AS VARCHAR), 3, '0') || '_00_DEM'"""},
    exact="tile",
)
_e1, _e2 = E2, E2 / (1 - E2)


@query(
    "F14_mgrs",
    with_tables("captures", f""", p AS (SELECT id, n / 13 AS lat, e / 6 AS lon FROM captures),
z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, radians(lat) AS phi FROM p),
t AS (SELECT *, radians(lon - (zone * 6 - 183)) * cos(phi) AS a, tan(phi) * tan(phi) AS t, {D(_e2)} * cos(phi) * cos(phi) AS c, {D(A)} / sqrt(1 - {D(_e1)} * sin(phi) * sin(phi)) AS w FROM z),
m AS (SELECT *, CAST(0.9996 AS DOUBLE) * w * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {D(_e2)}) * a ** 5 / 120) + 500000 AS easting,
  CAST(0.9996 AS DOUBLE) * ({D(A)} * ({D(1 - _e1 / 4 - 3 * _e1**2 / 64 - 5 * _e1**3 / 256)} * phi - {D(3 * _e1 / 8 + 3 * _e1**2 / 32 + 45 * _e1**3 / 1024)} * sin(2 * phi)
    + {D(15 * _e1**2 / 256 + 45 * _e1**3 / 1024)} * sin(4 * phi) - {D(35 * _e1**3 / 3072)} * sin(6 * phi))
    + w * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {D(_e2)}) * a ** 6 / 720))
    + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS northing FROM t)
SELECT id, zone, substr('{geo.BAND_LETTERS}', greatest(0, least(19, CAST(floor((lat + 80) / 8) AS INTEGER))) + 1, 1) AS band,
  substr(CASE (zone - 1) % 3 WHEN 0 THEN 'ABCDEFGH' WHEN 1 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END, CAST(floor(easting / 100000) AS INTEGER), 1)
  || substr('{geo.ROW_LETTERS}', (CAST(floor(northing / 100000) AS INTEGER) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1, 1) AS square FROM m"""),
)
def mgrs_square(spark, sf_dir):
    zone, band, square = geo.mgrs(c("lat"), c("lon"))
    return domain.captures(spark, sf_dir).select("id", (c("n") / 13).alias("lat"), (c("e") / 6).alias("lon")).select("id", zone.alias("zone"), band.alias("band"), square.alias("square"))


def _tiles():
    x, y = geo.web_tile(c("lat"), c("lon"), F.lit(15))
    lon, lat = geo.web_tile_corner(x, y, F.lit(15))
    return {"x": x, "y": y, "west": lon, "north": lat}


_X, _Y = "CAST(trunc((lon + 180) / 360 * 32768) AS BIGINT)", "CAST(trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * 32768) AS BIGINT)"
scalars(
    "F15_web_tile", "buildings", "id", _tiles,
    {"x": _X, "y": _Y, "west": f"{_X} / CAST(32768 AS DOUBLE) * 360 - 180", "north": f"degrees(atan(sinh(pi() * (1 - 2 * {_Y} / CAST(32768 AS DOUBLE)))))"},
    exact="x y",
)
scalars(
    "F16_texel", "captures", "id", lambda: dict(zip(("row", "col"), geo.texel(c("e"), c("n"), -900.0, -900.0, 2.5, 700, 700))),
    {"row": "greatest(0, least(699, CAST(floor((n + 900) / CAST(2.5 AS DOUBLE)) AS BIGINT)))", "col": "greatest(0, least(699, CAST(floor((e + 900) / CAST(2.5 AS DOUBLE)) AS BIGINT)))"},
    exact="row col",
)
scalars("F17_julian_day", "captures", "id", lambda: {"jd": sky.julian_day(c("t") + c("id") * 86400)}, {"jd": "(t + id * 86400) / 86400 + CAST(2440587.5 AS DOUBLE)"})

_T = "t + id * 40000"
SUN_SQL = f""", a AS (SELECT id, {_T} AS s, (({_T}) / 86400 + CAST(2440587.5 AS DOUBLE) - 2451545) / 36525 AS t, n / 20 AS lat, e / 10 AS lon, heading FROM captures),
b AS (SELECT *, (CAST(280.46646 AS DOUBLE) + t * (CAST(36000.76983 AS DOUBLE) + t * CAST(0.0003032 AS DOUBLE))) % 360 AS l0,
  radians(CAST(357.52911 AS DOUBLE) + t * (CAST(35999.05029 AS DOUBLE) - t * CAST(0.0001537 AS DOUBLE))) AS m, CAST(0.016708634 AS DOUBLE) - t * (CAST(0.000042037 AS DOUBLE) + t * CAST(0.0000001267 AS DOUBLE)) AS x,
  radians(CAST(125.04 AS DOUBLE) - CAST(1934.136 AS DOUBLE) * t) AS o FROM a),
g AS (SELECT *, l0 + sin(m) * (CAST(1.914602 AS DOUBLE) - t * (CAST(0.004817 AS DOUBLE) + t * CAST(0.000014 AS DOUBLE))) + sin(2 * m) * (CAST(0.019993 AS DOUBLE) - CAST(0.000101 AS DOUBLE) * t)
  + sin(3 * m) * CAST(0.000289 AS DOUBLE) - CAST(0.00569 AS DOUBLE) - CAST(0.00478 AS DOUBLE) * sin(o) AS app,
  23 + (26 + (CAST(21.448 AS DOUBLE) - t * (CAST(46.815 AS DOUBLE) + t * (CAST(0.00059 AS DOUBLE) - t * CAST(0.001813 AS DOUBLE)))) / 60) / 60 + CAST(0.00256 AS DOUBLE) * cos(o) AS tilt FROM b),
d AS (SELECT *, asin(sin(radians(tilt)) * sin(radians(app))) AS dec, tan(radians(tilt / 2)) ** 2 AS y, radians(l0) AS lr FROM g),
q AS (SELECT *, 4 * degrees(y * sin(2 * lr) - 2 * x * sin(m) + 4 * x * y * sin(m) * cos(2 * lr) - y * y * sin(4 * lr) / 2 - CAST(1.25 AS DOUBLE) * x * x * sin(2 * m)) AS eq FROM d),
h AS (SELECT *, (((s % 86400) / 60 + eq + 4 * lon) % 1440 + 1440) % 1440 / 4 - 180 AS ha, radians(lat) AS la FROM q),
z AS (SELECT *, greatest(-1, least(1, sin(la) * sin(dec) + cos(la) * cos(dec) * cos(radians(ha)))) AS cz FROM h),
w AS (SELECT *, acos(cz) AS zen, 90 - degrees(acos(cz)) AS el0 FROM z),
v AS (SELECT *, degrees(acos(greatest(-1, least(1, (sin(la) * cz - sin(dec)) / (cos(la) * sin(zen)))))) AS turn, tan(radians(greatest(el0, CAST(-0.99 AS DOUBLE)))) AS te FROM w),
sun AS (SELECT id, heading, CASE WHEN abs(sin(zen)) < 1e-9 THEN 0 WHEN ha > 0 THEN (turn + 180) % 360 ELSE (540 - turn) % 360 END AS az,
  el0 + CASE WHEN el0 >= 85 THEN 0 WHEN el0 > 5 THEN CAST(58.1 AS DOUBLE) / te - CAST(0.07 AS DOUBLE) / te ** 3 + CAST(0.000086 AS DOUBLE) / te ** 5
  WHEN el0 > CAST(-0.575 AS DOUBLE) THEN 1735 + el0 * (CAST(-518.2 AS DOUBLE) + el0 * (CAST(103.4 AS DOUBLE) + el0 * (CAST(-12.79 AS DOUBLE) + el0 * CAST(0.711 AS DOUBLE)))) ELSE CAST(-20.772 AS DOUBLE) / te END / 3600 AS el FROM v)
"""


def _sky(spark, sf_dir, of):
    df = domain.captures(spark, sf_dir)
    az, el = of(c("t") + c("id") * 40000, c("n") / 20, c("e") / 10)
    return df.select("id", "heading", az.alias("az"), el.alias("el"))


@query("F18_sun", with_tables("captures", SUN_SQL + "SELECT id, round(az, 4) AS azimuth, round(el, 4) AS elevation FROM sun"))
def sun_position(spark, sf_dir):
    return _sky(spark, sf_dir, sky.sun).select("id", r(c("az")).alias("azimuth"), r(c("el")).alias("elevation"))


@query(
    "F19_moon",
    with_tables("captures", f""", a AS (SELECT id, ({_T}) / 86400 + CAST(2440587.5 AS DOUBLE) AS jd, n / 20 AS lat, e / 10 AS lon FROM captures),
b AS (SELECT *, (jd - 2451545) / 36525 AS t FROM a),
g AS (SELECT *, radians(CAST(218.32 AS DOUBLE) + CAST(481267.881 AS DOUBLE) * t + CAST(6.29 AS DOUBLE) * sin(radians(135 + CAST(477198.87 AS DOUBLE) * t)) - CAST(1.27 AS DOUBLE) * sin(radians(CAST(259.3 AS DOUBLE) - CAST(413335.36 AS DOUBLE) * t))
  + CAST(0.66 AS DOUBLE) * sin(radians(CAST(235.7 AS DOUBLE) + CAST(890534.22 AS DOUBLE) * t)) + CAST(0.21 AS DOUBLE) * sin(radians(CAST(269.9 AS DOUBLE) + CAST(954397.74 AS DOUBLE) * t))
  - CAST(0.19 AS DOUBLE) * sin(radians(CAST(357.5 AS DOUBLE) + CAST(35999.05 AS DOUBLE) * t)) - CAST(0.11 AS DOUBLE) * sin(radians(CAST(186.5 AS DOUBLE) + CAST(966404.03 AS DOUBLE) * t))) AS lam,
  radians(CAST(5.13 AS DOUBLE) * sin(radians(CAST(93.3 AS DOUBLE) + CAST(483202.02 AS DOUBLE) * t)) + CAST(0.28 AS DOUBLE) * sin(radians(CAST(228.2 AS DOUBLE) + CAST(960400.89 AS DOUBLE) * t))
  - CAST(0.28 AS DOUBLE) * sin(radians(CAST(318.3 AS DOUBLE) + CAST(6003.15 AS DOUBLE) * t)) - CAST(0.17 AS DOUBLE) * sin(radians(CAST(217.6 AS DOUBLE) - CAST(407332.21 AS DOUBLE) * t))) AS beta,
  radians(CAST(23.4393 AS DOUBLE) - CAST(0.013 AS DOUBLE) * t) AS o, radians(lat) AS la FROM b),
d AS (SELECT *, asin(sin(beta) * cos(o) + cos(beta) * sin(o) * sin(lam)) AS dec, atan2(sin(lam) * cos(o) - tan(beta) * sin(o), cos(lam)) AS ra FROM g),
h AS (SELECT *, radians(CAST(280.46061837 AS DOUBLE) + CAST(360.98564736629 AS DOUBLE) * (jd - 2451545) + lon - degrees(ra)) AS ha FROM d)
SELECT id, round((degrees(atan2(-cos(dec) * sin(ha), sin(dec) * cos(la) - cos(dec) * cos(ha) * sin(la))) + 360) % 360, 3) AS azimuth,
  round(degrees(asin(greatest(-1, least(1, sin(la) * sin(dec) + cos(la) * cos(dec) * cos(ha))))), 3) AS elevation FROM h"""),
)
def moon_position(spark, sf_dir):
    return _sky(spark, sf_dir, sky.moon).select("id", r(c("az"), 3).alias("azimuth"), r(c("el"), 3).alias("elevation"))


@query("F20_sun_direction", with_tables("captures", SUN_SQL + "SELECT id, round(sin(radians(az)) * cos(radians(el)), 4) AS e, round(cos(radians(az)) * cos(radians(el)), 4) AS n, round(sin(radians(el)), 4) AS u FROM sun"))
def sun_direction(spark, sf_dir):
    df = _sky(spark, sf_dir, sky.sun)
    return df.select("id", *[r(x).alias(k) for k, x in zip("enu", sky.direction(c("az"), c("el")))])


@query(
    "F21_sun_heading",
    with_tables("captures", SUN_SQL + "SELECT id, round(CASE WHEN el >= 5 AND abs(el - (id % 60)) <= 12 THEN ((az - heading) % 360 + 360) % 360 END, 4) AS heading FROM sun"),
)
def sun_heading(spark, sf_dir):
    return _sky(spark, sf_dir, sky.sun).select("id", r(sky.sun_heading(c("az"), c("el"), c("heading"), (c("id") % 60).cast("double"))).alias("heading"))


@query(
    "F22_split_bucket",
    with_tables("captures", """, k AS (SELECT id, CAST(floor(e / 150) AS BIGINT) || ':' || CAST(floor(n / 150) AS BIGINT) || ':7' AS key FROM captures),
b AS (SELECT id, key, CAST('0x' || substr(sha1(key), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS bucket FROM k)
SELECT id, round(bucket, 6) AS bucket, CASE WHEN bucket < CAST(0.2 AS DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM b"""),
)
def split_bucket(spark, sf_dir):
    from skylattice.operators.evaluate import spatial_split

    return spatial_split(domain.captures(spark, sf_dir), 150.0, 7, 0.2).select("id", r(c("bucket"), 6).alias("bucket"), "split")


scalars("F23_texel_hash", "texels", "row", lambda: {"col": c("col"), "noise": raster.texel_hash(c("row"), c("col"))}, {"col": "col", "noise": "(xor(row * 73856093, col * 19349663) & 65535) / CAST(65535 AS DOUBLE)"}, exact="col")
_WALL = "(xor(row // 8 * 40503, col // 8 * 30011) % 4)"
scalars("F24_wall_tone", "texels", "row", lambda: {"col": c("col"), "tone": raster.wall_index(c("row"), c("col"), 2.0)}, {"col": "col", "tone": _WALL}, exact="col tone")


def _case(key, table, default):
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {D(v)}" for k, v in table.items()) + f" ELSE {'NULL' if default is None else D(default)} END"


def _colour_sql(k):
    base = _case("class_id", {i: v[k] for i, v in raster.CLASS_COLOURS.items()}, None)
    wall = _case(_WALL, {i: v[k] for i, v in enumerate(raster.WALLS)}, None)
    share = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), build_h / 6))"
    noise = f"((xor(row * 73856093, col * 19349663) & 65535) / CAST(65535 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * {_case('class_id', raster.SPECKLE, raster.SPECKLE_ELSE)}"
    return f"greatest(CAST(0.03 AS DOUBLE), least(CAST(0.97 AS DOUBLE), {base} * (1 - {share}) + {wall} * CAST(0.92 AS DOUBLE) * {share} + {noise}))"


scalars(
    "F25_texel_colour", "texels", "row",
    lambda: {"col": c("col")} | dict(zip("rgb", raster.texel_colour(c("row"), c("col"), c("class_id"), c("build_h"), 2.0))),
    {"col": "col"} | {k: _colour_sql(i) for i, k in enumerate("rgb")},
    exact="col",
)


def _tags(df):
    """Raw tag columns of the part table."""
    return df.selectExpr(
        "p_partkey AS id", "CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'tall' ELSE concat(p_size, ' m') END AS height", "CASE WHEN p_size % 7 = 3 THEN NULL ELSE concat(p_size % 7, '') END AS levels",
        "concat('#', lpad(hex(p_partkey * 4099 % 16777216), 6, '0')) AS colour", "lower(split(p_type, ' ')[0]) AS kind", "lower(split(p_name, ' ')[0]) AS word", "CAST(p_size AS BIGINT) AS size",
    )


TAGS_SQL = """WITH tags AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'tall' ELSE concat(p_size, ' m') END AS height,
  CASE WHEN p_size % 7 = 3 THEN NULL ELSE concat(p_size % 7, '') END AS levels, concat('#', lpad(upper(to_hex(p_partkey * 4099 % 16777216)), 6, '0')) AS colour,
  lower(split_part(p_type, ' ', 1)) AS kind, lower(split_part(p_name, ' ', 1)) AS word, CAST(p_size AS BIGINT) AS size FROM part)
"""


def tag_query(name, sql, columns):
    query(name, TAGS_SQL + sql)(lambda spark, sf_dir: _tags(raw(spark, sf_dir, "part")).select("id", *[v.alias(k) for k, v in columns().items()]))


_NUM = r"TRY_CAST(regexp_extract({0}, '^\s*([\d.]+)', 1) AS DOUBLE)"
tag_query(
    "F26_tag_height",
    f"""SELECT id, coalesce({_NUM.format('height')}, {_NUM.format('levels')} * 3) AS height_m,
  CASE WHEN {_NUM.format('height')} IS NOT NULL THEN 'tag_height' WHEN {_NUM.format('levels')} IS NOT NULL THEN 'tag_levels' ELSE 'none' END AS source FROM tags""",
    lambda: dict(zip(("height_m", "source"), features.tag_height(c("height"), F.lit(None).cast("string"), c("levels")))),
)
tag_query(
    "F27_roof_height", "SELECT id, coalesce(TRY_CAST(split_part(trim(height), ' ', 1) AS DOUBLE), TRY_CAST(trim(levels) AS DOUBLE) * CAST(2.5 AS DOUBLE)) AS roof_m FROM tags",
    lambda: {"roof_m": features.roof_height(c("height"), c("levels"))},
)
_KIND = "CASE size % 6 WHEN 0 THEN 'house' WHEN 1 THEN 'factory' WHEN 2 THEN 'Office' WHEN 3 THEN 'campanile' WHEN 4 THEN 'yes' END"
_MADE = "CASE WHEN size % 5 = 0 THEN 'chimney' WHEN size % 5 = 1 THEN 'pier' END"
tag_query(
    "F28_building_class",
    f"""SELECT id, CASE {_KIND} WHEN 'house' THEN 'residential' WHEN 'factory' THEN 'industrial' WHEN 'Office' THEN 'commercial' WHEN 'campanile' THEN 'landmark'
  ELSE CASE WHEN {_MADE} = 'chimney' THEN 'landmark' ELSE 'generic' END END AS class FROM tags""",
    lambda: {"class": features.building_class(F.expr(_KIND), F.expr(_MADE))},
)
tag_query(
    "F29_open_height",
    """SELECT id, CASE WHEN size % 5 > 0 THEN size % 5 WHEN size % 3 <> 0 THEN size % 3 * CAST(3 AS DOUBLE) END AS height_m,
  CASE WHEN size % 5 > 0 THEN 'tag_height' WHEN size % 3 <> 0 THEN 'tag_levels' ELSE 'none' END AS source FROM tags""",
    lambda: dict(zip(("height_m", "source"), features.open_height((c("size") % 5).cast("double"), c("size") % 3))),
)
_ROAD = "CASE size % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'service' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'track' WHEN 4 THEN 'unknown' END"
tag_query(
    "F30_road_width",
    f"""SELECT id, CASE {_ROAD} WHEN 'motorway' THEN 16.0::DOUBLE WHEN 'service' THEN 4.0::DOUBLE WHEN 'tertiary' THEN 7.0::DOUBLE ELSE 4.0::DOUBLE END AS road_m,
  CASE {_ROAD} WHEN 'motorway' THEN 16.0::DOUBLE WHEN 'tertiary' THEN 7.0::DOUBLE WHEN 'unknown' THEN 5.0::DOUBLE ELSE 4.0::DOUBLE END AS segment_m FROM tags""",
    lambda: {"road_m": features.lookup(F.expr(_ROAD), features.ROAD_WIDTHS, 4.0), "segment_m": features.lookup(F.expr(_ROAD), features.SEGMENT_WIDTHS, 4.0)},
)
_MM, _HI, _BU = (
    "CASE size % 4 WHEN 0 THEN 'tower' WHEN 1 THEN 'water_tower' WHEN 2 THEN 'pier' ELSE '' END",
    "CASE size % 3 WHEN 0 THEN 'castle' WHEN 1 THEN 'ruins' ELSE '' END",
    "CASE size % 5 WHEN 0 THEN 'church' WHEN 1 THEN 'tower' ELSE 'yes' END",
)
tag_query(
    "F31_archetype",
    f"""SELECT id, CASE WHEN {_MM} = 'tower' THEN 'spire_tower' WHEN {_MM} = 'water_tower' THEN 'cap_tower' WHEN {_HI} = 'castle' THEN 'crenellated'
  WHEN {_BU} = 'church' THEN 'dome' WHEN {_BU} = 'tower' THEN 'spire_tower' END AS archetype FROM tags""",
    lambda: {"archetype": features.archetype_of_tags(F.create_map(F.lit("man_made"), F.expr(_MM), F.lit("historic"), F.expr(_HI), F.lit("building"), F.expr(_BU)))},
)
_PRIM = "CASE size % 4 WHEN 0 THEN 'Old_Lighthouse' WHEN 1 THEN 'bakery' WHEN 2 THEN 'city_hall' ELSE 'fort' END"
_ALT = "CASE WHEN size % 3 = 0 THEN 'cathedral_square' ELSE 'shop' END"
tag_query(
    "F32_category_archetype",
    f"""SELECT id, {_PRIM} <> 'bakery' OR {_ALT} <> 'shop' AS relevant,
  CASE WHEN {_PRIM} = 'fort' THEN 'crenellated' WHEN {_ALT} = 'cathedral_square' THEN 'dome' WHEN {_PRIM} = 'Old_Lighthouse' THEN 'spire_tower' END AS archetype FROM tags""",
    lambda: dict(zip(("relevant", "archetype"), features.archetype_of_category(F.expr(_PRIM), F.array(F.expr(_ALT))))),
)
_HEX = "CASE WHEN id % 9 = 0 THEN '#12345' WHEN id % 9 = 1 THEN ' #zz0000' ELSE colour END"
tag_query(
    "F33_hex_colour",
    "SELECT id, " + ", ".join(f"CASE WHEN id % 9 > 1 THEN round(CAST('0x' || substr(colour, {k}, 2) AS INTEGER) / CAST(255 AS DOUBLE), 4) END AS {n}" for k, n in ((2, "r"), (4, "g"), (6, "b"))) + " FROM tags",
    lambda: {k: r(v) for k, v in zip("rgb", features.hex_colour(F.expr(_HEX)))},
)


@query("F34_ring_key", with_tables("buildings", "SELECT id, printf('5:%.6f,%.6f:%.6f,%.6f', lon, lat, lon, lat) AS key FROM buildings"))
def ring_key(spark, sf_dir):
    return rings(domain.buildings(spark, sf_dir)).select("id", features.ring_key(c("ring")).alias("key"))


_MSG = "CASE size % 5 WHEN 0 THEN 'server said 502' WHEN 1 THEN 'read timed out' WHEN 2 THEN 'Connection reset' WHEN 3 THEN 'HTTP 429 after timeout' ELSE 'bad' END"
tag_query(
    "F35_error_signature", "SELECT id, CASE size % 5 WHEN 0 THEN '502' WHEN 1 THEN 'timed out' WHEN 2 THEN 'Connection' WHEN 3 THEN '429' ELSE 'ValueError' END AS signature FROM tags",
    lambda: {"signature": features.error_signature(F.expr(_MSG), F.lit("ValueError"))},
)
_POL = "CASE size % 5 WHEN 0 THEN 'defer' WHEN 1 THEN 'skip' WHEN 2 THEN 'abort' WHEN 3 THEN 'fallback' ELSE 'other' END"
tag_query("F36_failure_policy", f"SELECT id, CASE WHEN size % 5 < 4 THEN upper({_POL}) END AS action FROM tags", lambda: {"action": features.failure_action(F.expr(_POL))})
_SCENE = "CASE WHEN size % 6 = 0 THEN 'S2A_x' ELSE concat('S2A_34TCT_2026', lpad(concat(size % 12 + 1, ''), 2, '0'), lpad(concat(size % 28 + 1, ''), 2, '0'), '_0_L2A') END"
tag_query(
    "F39_scene_name",
    "SELECT id, CASE WHEN size % 6 = 0 THEN 'x' ELSE '34TCT' END AS tile, CASE WHEN size % 6 <> 0 THEN make_date(2026, size % 12 + 1, size % 28 + 1) END AS day FROM tags",
    lambda: dict(zip(("tile", "day"), features.scene_of(F.expr(_SCENE)))),
)
_ST = "CAST(CASE size % 6 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 200 WHEN 4 THEN 504 ELSE 500 END AS INT)"
_BODY = "CASE WHEN size % 4 = 0 THEN 'Too Many Requests, later' WHEN size % 4 = 1 THEN 'runtime error' WHEN size % 4 = 2 THEN 'rate_limited' END"
tag_query(
    "F62_rate_limited", "SELECT id, size % 6 IN (0, 1) OR (size % 6 IN (2, 4, 5) AND size % 4 IN (0, 2)) AS limited FROM tags", lambda: {"limited": features.rate_limited(F.expr(_ST), F.expr(_BODY))}
)

PX = "CAST({0} AS DOUBLE)"
scalars(
    "F40_luminance", "ortho_px", "scene", lambda: {"row": c("row"), "col": c("col"), "y": raster.luminance(c("r"), c("g"), c("b"))},
    {"row": "row", "col": "col", "y": "CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b"}, exact="row col",
)


def _hsv_columns():
    h, s, v = raster.hsv(c("r"), c("g"), c("b"))
    return {"row": c("row"), "col": c("col"), "h": h, "s": s, "v": v, "wall": raster.wall_candidate(c("r"), c("g"), c("b")), "roof": raster.roof_candidate(c("r"), c("g"), c("b"))}


_TOP, _LOW = "greatest(r, g, b)", "least(r, g, b)"
_SPAN = f"({_TOP} - {_LOW})"
_HUE = f"CASE WHEN {_SPAN} = 0 THEN 0 WHEN {_TOP} = r THEN (60 * (g - b) / {_SPAN} + 360) % 360 WHEN {_TOP} = g THEN 60 * (b - r) / {_SPAN} + 120 ELSE 60 * (r - g) / {_SPAN} + 240 END"
_H, _S, _V = (f"round({x}, 6)" for x in (f"({_HUE}) / 360", f"{_SPAN} / {_TOP}", _TOP))
WALL = f"{_S} < 0.38 AND {_V} > 0.42 AND {_V} < 0.97 AND NOT ({_H} > 0.52 AND {_H} < 0.72 AND {_S} > 0.15) AND NOT ({_H} > 0.18 AND {_H} < 0.45 AND {_S} > 0.22)"
ROOF = f"({_H} < 0.12 OR {_H} > 0.93) AND {_S} > 0.25 AND {_V} > 0.20 AND {_V} < 0.95"
scalars(
    "F41_hsv_rules", "ortho_px", "scene", _hsv_columns,
    {
        "row": "row", "col": "col", "h": _HUE, "s": f"{_SPAN} / {_TOP}", "v": _TOP, "wall": WALL, "roof": ROOF,
    },
    exact="row col wall roof",
)


@query(
    "F42_colour_bytes",
    with_tables("ortho_px", """, m AS (SELECT scene, max(greatest(r, g, b)) AS top FROM ortho_px GROUP BY scene)
SELECT scene, row, col, """ + ", ".join(f"CAST(round_even(greatest(0, least(255, CASE WHEN top <= 1.5 THEN {k} * 255 ELSE {k} END)), 0) AS INTEGER) AS {k}" for k in "rgb") + " FROM ortho_px JOIN m USING (scene)"),
)
def colour_bytes(spark, sf_dir):
    px = domain.ortho_px(spark, sf_dir)
    top = px.groupBy("scene").agg(F.max(F.greatest("r", "g", "b")).alias("top"))  # one row a scene
    return px.join(F.broadcast(top), "scene").select("scene", "row", "col", *[raster.to_byte(c(k), c("top")).alias(k) for k in "rgb"])


scalars(
    "F44_splat_weights", "texels", "row", lambda: {"col": c("col")} | dict(zip(("base", "green", "hard", "water"), raster.splat_weights(c("class_id")))),
    {
        "col": "col", "base": "CASE WHEN class_id IN (1, 2, 3, 4, 5, 6, 7) THEN 0 ELSE 255 END", "green": "CASE WHEN class_id IN (1, 6, 7) THEN 255 ELSE 0 END",
        "hard": "CASE WHEN class_id IN (3, 4, 5) THEN 255 ELSE 0 END", "water": "CASE WHEN class_id = 2 THEN 255 ELSE 0 END",
    },
    exact="col base green hard water",
)


@query(
    "F45_terrain_resample",
    with_tables("texels", """, s AS (SELECT min(ground) AS low, greatest(max(ground) - min(ground), 1) AS span, max(row) AS last FROM texels),
g AS (SELECT i, CAST(trunc(i * (SELECT last FROM s) / CAST(32 AS DOUBLE)) AS BIGINT) AS row FROM range(33) t(i)),
k AS (SELECT i AS j, CAST(trunc(i * 119 / CAST(32 AS DOUBLE)) AS BIGINT) AS col FROM range(33) t(i))
SELECT g.i, k.j, CAST(trunc((t.ground - s.low) / s.span * 65535) AS INTEGER) AS height FROM texels t JOIN g ON t.row = g.row JOIN k ON t.col = k.col CROSS JOIN s"""),
)
def terrain_resample(spark, sf_dir):
    from skylattice.operators.rasters import resample

    return resample(domain.texels(spark, sf_dir), 33, 120)


_ARCH = "CASE h % 5 WHEN 0 THEN 'spire_tower' WHEN 1 THEN 'cap_tower' WHEN 2 THEN 'dome' WHEN 3 THEN 'crenellated' ELSE 'other' END"
_RAD, _ANG = "CAST(h % 30 AS DOUBLE)", "(h % 628 / CAST(100 AS DOUBLE) - CAST(3.14 AS DOUBLE))"
scalars(
    "F46_archetype_height", "texels", "row",
    lambda: {"col": c("col"), "top": raster.archetype_height(F.expr(_ARCH), F.lit(20.0), F.expr(_RAD), F.lit(29.0), F.expr(_ANG.replace("CAST(100 AS DOUBLE)", "100D")), 2.0)},
    {
        "col": "col",
        "top": f"""CASE {_ARCH} WHEN 'spire_tower' THEN 20 * (1 + CAST(0.45 AS DOUBLE) * (1 - {_RAD} / 29)) WHEN 'cap_tower' THEN 20 * (1 + CAST(0.2 AS DOUBLE) * sqrt(1 - ({_RAD} / 29) ** 2))
      WHEN 'dome' THEN 20 + 10 * sqrt(greatest(0, 1 - ({_RAD} / CAST(17.4 AS DOUBLE)) ** 2))
      WHEN 'crenellated' THEN CASE WHEN floor({_ANG} * 29 / 2 / 4) % 2 = 0 AND {_RAD} > 29 * CAST(0.72 AS DOUBLE) THEN 23 ELSE 20 END END""",
    },
    exact="col",
)
_SHAPE = "CASE size % 5 WHEN 0 THEN 'Hipped' WHEN 1 THEN 'unknown' WHEN 2 THEN '' WHEN 3 THEN 'flat' END"
scalars(
    "F47_roof_shape", "buildings", "id",
    lambda: dict(zip(("shape", "roof_m"), raster.roof(F.expr(_SHAPE), F.expr("CASE WHEN size % 7 = 0 THEN 3D END"), c("cls"), F.expr("CAST(size % 30 AS DOUBLE)"), F.expr("CAST(size * 20 AS DOUBLE)"), F.expr("size % 11 div 10"), F.expr("0.6D + size % 40 / 100D"), F.coalesce(c("height_m"), F.lit(6.0))))),
    {
        "shape": f"""CASE WHEN CAST(0.6 AS DOUBLE) + size % 40 / CAST(100 AS DOUBLE) < CAST(0.8 AS DOUBLE) OR size % 11 // 10 > 0 OR size % 30 < 4 THEN 'flat'
      WHEN coalesce(lower({_SHAPE}), '') IN ('', 'unknown') THEN CASE WHEN cls IN ('residential', 'generic') AND size % 30 < 20 AND size * 20 < 650 THEN 'gabled' ELSE 'flat' END ELSE lower({_SHAPE}) END""",
        "roof_m": f"""CASE WHEN CAST(0.6 AS DOUBLE) + size % 40 / CAST(100 AS DOUBLE) < CAST(0.8 AS DOUBLE) OR size % 11 // 10 > 0 OR size % 30 < 4 THEN 0
      WHEN coalesce(lower({_SHAPE}), '') IN ('', 'unknown') AND NOT (cls IN ('residential', 'generic') AND size % 30 < 20 AND size * 20 < 650) OR lower({_SHAPE}) = 'flat' THEN 0
      ELSE least(CASE WHEN size % 7 = 0 THEN 3 ELSE greatest(2, least(7, CAST(0.3 AS DOUBLE) * (size % 30))) END, greatest(coalesce(height_m, 6) - 2, 0)) END""",
    },
    exact="shape",
)


def _guide():
    g = estimates.guidance([c("e"), c("n"), c("u")], [c("pe"), c("pn"), c("pu")], c("ph"), 6.0, 2.5, 2.0)
    return {k: g[k] for k in ("goal_e", "goal_n", "goal_u", "bearing", "goal_dist", "alt_delta", "target_dist", "at_goal", "violation")}


_FAR = "sqrt((pe - e) * (pe - e) + (pn - n) * (pn - n))"
_GX = f"(pe + CASE WHEN {_FAR} > 1e-6 THEN (e - pe) / {_FAR} ELSE sin(radians((ph + 180) % 360)) END * 6)"
_GY = f"(pn + CASE WHEN {_FAR} > 1e-6 THEN (n - pn) / {_FAR} ELSE cos(radians((ph + 180) % 360)) END * 6)"
_LEFT = f"sqrt(({_GX} - e) ** 2 + ({_GY} - n) ** 2)"
scalars(
    "F48_guidance", "preds", "id", _guide,
    {
        "goal_e": _GX, "goal_n": _GY, "goal_u": "pu", "bearing": f"CASE WHEN {_LEFT} > 1e-6 THEN (degrees(atan2({_GX} - e, {_GY} - n)) + 360) % 360 ELSE ph END", "goal_dist": _LEFT, "alt_delta": "pu - u",
        "target_dist": _FAR, "at_goal": f"{_LEFT} < CAST(2.5 AS DOUBLE) AND abs(pu - u) < 2", "violation": f"{_FAR} < 6 * CAST(0.98 AS DOUBLE)",
    },
    exact="at_goal violation",
)
scalars(
    "F50_confidence", "frames", "frame_id", lambda: {"conf": estimates.confidence(c("initialized"), F.lit(2.0) + c("frame_id") % 20, c("confidence"), 12.0, 3.0)},
    {"conf": "CASE WHEN initialized THEN (1 - exp(-144 / (2 * greatest(2 + frame_id % 20, 3) ** 2))) * (CAST(0.3 AS DOUBLE) + CAST(0.7 AS DOUBLE) * confidence) ELSE 0 END"},
)
scalars(
    "F51_sigma_floor", "frames", "frame_id", lambda: {"floor": estimates.sigma_floor(F.when(c("initialized"), c("confidence") * 50), c("confidence") * 70 - 5)},
    {"floor": "greatest(3, coalesce(CAST(0.35 AS DOUBLE) * CASE WHEN initialized THEN least(confidence * 50, confidence * 70 - 5) ELSE confidence * 70 - 5 END, 3))"},
)


def _fused():
    return estimates.fuse([c("e"), c("n"), c("u")], c("sigma"), [c("pe"), c("pn"), c("pu")], c("sigma") / 2, 12.0)


_SA, _SB = "greatest(sigma, 2)", "greatest(sigma / 2, 2)"
_WA, _WB = f"(1 / ({_SA} * {_SA}))", f"(1 / ({_SB} * {_SB}))"
_AG = f"exp(CAST(-0.5 AS DOUBLE) * ((e - pe) ** 2 + (n - pn) ** 2) / ({_SA} * {_SA} + {_SB} * {_SB}))"
_SE = f"(sqrt(1 / ({_WA} + {_WB})) / greatest({_AG}, CAST(0.05 AS DOUBLE)))"
scalars(
    "F52_fuse_fixes", "preds", "id", _fused,
    {k: f"({k} * {_WA} + p{k} * {_WB}) / ({_WA} + {_WB})" for k in "enu"} | {"agreement": _AG, "sigma": _SE, "confidence": f"(1 - exp(-144 / (2 * {_SE} * {_SE}))) * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {_AG})"},
)
scalars("F53_target_confidence", "preds", "id", lambda: {"conf": estimates.target_confidence(c("sigma") * 4, F.abs(c("pe") - c("e")) * 9)}, {"conf": "1 / (1 + sigma * 4 / 30 + abs(pe - e) * 9 / 100)"})
scalars(
    "F54_measurement_variance", "preds", "id",
    lambda: dict(zip(("ve", "vn", "vu"), estimates.regression_covariance(c("sigma"), 0.9, 4.0))) | dict(zip(("re", "rn", "ru"), estimates.retrieval_covariance((c("sigma") * 3, c("sigma") * 2, c("sigma")), 4.0))),
    {"ve": "greatest(sigma * CAST(0.9 AS DOUBLE), 4) ** 2", "vn": "greatest(sigma * CAST(0.9 AS DOUBLE), 4) ** 2", "vu": "2 * greatest(sigma * CAST(0.9 AS DOUBLE), 4) ** 2",
     "re": "sigma * 3 + 16", "rn": "sigma * 2 + 16", "ru": "sigma + 16"},
)
_s20, _c20 = math.sin(math.radians(20)), math.cos(math.radians(20))
scalars(
    "F55_level_ray", "view_px", "view_id", lambda: {"r": c("r"), "c": c("c")} | dict(zip(("right_x", "forward", "up"), estimates.level_ray(c("c"), c("r"), 64, 48, 60.0, 20.0))),
    {"r": "r", "c": "c", "right_x": "(c - 32) / CAST(60 AS DOUBLE)", "forward": f"{D(_c20)} - {D(_s20)} * (24 - r) / CAST(60 AS DOUBLE)", "up": f"{D(_c20)} * (24 - r) / CAST(60 AS DOUBLE) + {D(_s20)}"},
    exact="r c",
)
scalars(
    "F56_body_to_world", "captures", "id", lambda: dict(zip(("de", "dn"), estimates.body_to_world(c("e") / 100, c("n") / 100, c("heading")))),
    {"de": "e / 100 * cos(radians(heading)) + n / 100 * sin(radians(heading))", "dn": "n / 100 * cos(radians(heading)) - e / 100 * sin(radians(heading))"},
)
scalars(
    "F57_regression_output", "preds", "id",
    lambda: estimates.regression_output([c("pe") / 500, c("pn") / 500, c("pu") / 500], -c("sigma"), F.sin(F.radians(c("ph"))), F.cos(F.radians(c("ph"))), -c("sigma") / 3, 500.0),
    {
        "e": "pe / 500 * 500", "n": "pn / 500 * 500", "u": "pu / 500 * 500", "heading": "(degrees(atan2(sin(radians(ph)), cos(radians(ph)))) + 360) % 360", "sigma": "exp(-sigma / 2) * 500 / sqrt(CAST(3 AS DOUBLE))",
        "sigma_heading": "greatest(1, least(90, degrees(exp(-sigma / 6))))",
    },
)


@query("F58_ring_centroid", with_tables("buildings", "SELECT id, round(lon + CAST(0.0003 AS DOUBLE) * 2 / 5, 7) AS lon, round(lat + CAST(0.0003 AS DOUBLE) * 2 / 5, 7) AS lat FROM buildings"))
def ring_centroid(spark, sf_dir):
    mean = lambda k: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[k]) / F.size("ring")
    return rings(domain.buildings(spark, sf_dir)).select("id", r(mean("lon"), 7).alias("lon"), r(mean("lat"), 7).alias("lat"))


scalars(
    "F59_success", "episodes", "id", lambda: {"success": estimates.success(c("declared"), c("dist_at_arrival"), c("violation"), c("collided"), 60.0)},
    {"success": "declared AND dist_at_arrival <= 60 AND NOT violation AND NOT collided"}, exact="success",
)


@query(
    "F63_anchor",
    with_tables("pois", """SELECT id, CASE WHEN id % 3 = 0 THEN lat ELSE CAST(43.32 AS DOUBLE) END AS lat0, CASE WHEN id % 3 = 0 THEN lon ELSE CAST(11.33 AS DOUBLE) END AS lon0,
  CASE WHEN id % 3 = 0 THEN 'sim_metadata' ELSE 'env_config' END AS source FROM pois"""),
)
def anchor(spark, sf_dir):
    """Metadata embedded in a scene comes first, the configuration otherwise."""
    scenes = domain.pois(spark, sf_dir)
    meta = scenes.where("id % 3 = 0").select("id", F.struct("lat", "lon").alias("meta"))
    source = F.when(c("meta").isNotNull(), "sim_metadata").otherwise("env_config")
    return scenes.join(meta, "id", "left").select("id", F.coalesce("meta.lat", F.lit(LAT0)).alias("lat0"), F.coalesce("meta.lon", F.lit(LON0)).alias("lon0"), source.alias("source"))

"""Geodesy as column expressions: frames, headings, grid cells, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METRES_PER_DEGREE = 111320.0
CELL_M = 500.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
BAND_LETTERS = "CDEFGHJKLMNPQRSTUVWX"
COLUMN_SETS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"

_A, _E2 = WGS84_A, WGS84_F * (2 - WGS84_F)
_B = WGS84_A * (1 - WGS84_F)


def sim_to_enu(x: Column, y: Column, z: Column, offset_deg: float) -> list[Column]:
    """East, north, up of a left-handed position whose z axis bears ``offset_deg``."""
    c, s = math.cos(math.radians(offset_deg)), math.sin(math.radians(offset_deg))
    return [c * x + s * z, -s * x + c * z, y]


def enu_to_sim(e: Column, n: Column, u: Column, offset_deg: float) -> list[Column]:
    c, s = math.cos(math.radians(offset_deg)), math.sin(math.radians(offset_deg))
    return [c * e - s * n, u, s * e + c * n]


def heading_deg(e: Column, n: Column) -> Column:
    """Clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(e, n)) + 360, F.lit(360.0))


def quaternion_heading(x: Column, y: Column, z: Column, w: Column, offset_deg: float) -> Column:
    """Heading of the forward axis of a body quaternion in the left-handed frame; its length does not matter."""
    e, n, _ = sim_to_enu(2 * (x * z + y * w), F.lit(0.0), x * x * -1 - y * y + z * z + w * w, offset_deg)
    return heading_deg(e, n)


def quaternion_yaw(y: Column, w: Column) -> Column:
    return F.pmod(F.degrees(2 * F.atan2(y, w)), F.lit(360.0))


def wrap_deg(a: Column) -> Column:
    """An angle's difference as a value in (-180, 180]."""
    wrapped = F.pmod(a + 180, F.lit(360.0)) - 180
    return F.when(wrapped == -180, 180.0).otherwise(wrapped)


def _ecef(lat: Column | float, lon: Column | float, alt: Column | float, m=F) -> list:
    n = _A / m.sqrt(1 - _E2 * m.sin(m.radians(lat)) * m.sin(m.radians(lat)))
    return [
        (n + alt) * m.cos(m.radians(lat)) * m.cos(m.radians(lon)),
        (n + alt) * m.cos(m.radians(lat)) * m.sin(m.radians(lon)),
        (n * (1 - _E2) + alt) * m.sin(m.radians(lat)),
    ]


def geodetic_to_enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float) -> list[Column]:
    dx, dy, dz = (a - b for a, b in zip(_ecef(lat, lon, alt), _ecef(lat0, lon0, alt0, math)))
    sp, cp, sl, cl = math.sin(math.radians(lat0)), math.cos(math.radians(lat0)), math.sin(math.radians(lon0)), math.cos(math.radians(lon0))
    return [-sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz]


def enu_to_geodetic(e: Column, n: Column, u: Column, lat0: float, lon0: float, alt0: float) -> list[Column]:
    """Latitude, longitude (degrees) and altitude, by Bowring's closed form."""
    sp, cp, sl, cl = math.sin(math.radians(lat0)), math.cos(math.radians(lat0)), math.sin(math.radians(lon0)), math.cos(math.radians(lon0))
    x0, y0, z0 = _ecef(lat0, lon0, alt0, math)
    x, y, z = x0 - sl * e - sp * cl * n + cp * cl * u, y0 + cl * e - sp * sl * n + cp * sl * u, z0 + cp * n + sp * u
    p, second = F.sqrt(x * x + y * y), (_A**2 - _B**2) / _B**2
    theta = F.atan2(z * _A, p * _B)
    lat = F.atan2(z + second * _B * F.pow(F.sin(theta), 3), p - _E2 * _A * F.pow(F.cos(theta), 3))
    radius = _A / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
    return [F.degrees(lat), F.degrees(F.atan2(y, x)), p * F.cos(lat) + z * F.sin(lat) - _A * _A / radius]


def enu_to_geodetic_small(e: Column, n: Column, lat0: float, lon0: float) -> list[Column]:
    """Flat-earth latitude and longitude, for areas of a few kilometres."""
    return [lat0 + n / METRES_PER_DEGREE, lon0 + e / (METRES_PER_DEGREE * math.cos(math.radians(lat0)))]


def lonlat_to_plane(lon: Column, lat: Column, lon0: float, lat0: float) -> list[Column]:
    """Flat-earth east and north in metres."""
    return [(lon - lon0) * (METRES_PER_DEGREE * math.cos(math.radians(lat0))), (lat - lat0) * METRES_PER_DEGREE]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def parse_bbox(text: Column, margin: float = 0.0) -> list[Column]:
    """South, west, north, east of "lat,lon,lat,lon" in any corner order, widened by ``margin``."""
    part = lambda k: F.trim(F.split(text, ",")[k]).cast("double")
    return [F.least(part(0), part(2)) - margin, F.least(part(1), part(3)) - margin, F.greatest(part(0), part(2)) + margin, F.greatest(part(1), part(3)) + margin]


def cell_index(lat: Column, lon: Column, cell_m: float = CELL_M) -> list[Column]:
    """Row and column on the fixed global grid."""
    step = cell_m / METRES_PER_DEGREE
    return [F.floor(lat / step), F.floor(lon / step)]


def cell_id(ilat: Column, ilon: Column, cell_m: float = CELL_M) -> Column:
    return F.concat(F.lit(f"c{int(cell_m)}_"), ilat.cast("string"), F.lit("_"), ilon.cast("string"))


def cell_bbox(ilat: Column, ilon: Column, cell_m: float = CELL_M) -> list[Column]:
    step = cell_m / METRES_PER_DEGREE
    return [ilat * step, ilon * step, (ilat + 1) * step, (ilon + 1) * step]


def plane_cell(e: Column, n: Column, cell_m: float) -> list[Column]:
    return [F.floor(e / cell_m), F.floor(n / cell_m)]


def dem_tile(lat: Column, lon: Column) -> Column:
    """Name of the elevation tile at whole degrees."""
    ns = F.when(lat >= 0, "N").otherwise("S")
    ew = F.when(lon >= 0, "E").otherwise("W")
    digits = lambda c, k: F.lpad(F.abs(c).cast("string"), k, "0")
    return F.concat(F.lit("Copernicus_DSM_COG_10_"), ns, digits(lat, 2), F.lit("_00_"), ew, digits(lon, 3), F.lit("_00_DEM"))


def mgrs(lat: Column, lon: Column) -> list[Column]:
    """Zone, band letter and 100 km square, from the transverse Mercator series."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    band = F.substring(F.lit(BAND_LETTERS), F.greatest(F.lit(0), F.least(F.lit(19), F.floor((lat + 80) / 8))).cast("int") + 1, F.lit(1))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e1, e2 = _E2, _E2 / (1 - _E2)
    n = _A / F.sqrt(1 - e1 * F.sin(phi) * F.sin(phi))
    t, c, a = F.tan(phi) * F.tan(phi), e2 * F.cos(phi) * F.cos(phi), lam * F.cos(phi)
    arc = _A * (
        (1 - e1 / 4 - 3 * e1**2 / 64 - 5 * e1**3 / 256) * phi
        - (3 * e1 / 8 + 3 * e1**2 / 32 + 45 * e1**3 / 1024) * F.sin(2 * phi)
        + (15 * e1**2 / 256 + 45 * e1**3 / 1024) * F.sin(4 * phi)
        - (35 * e1**3 / 3072) * F.sin(6 * phi)
    )
    easting = 0.9996 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2) * F.pow(a, 5) / 120) + 500000
    north = 0.9996 * (
        arc + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e2) * F.pow(a, 6) / 720)
    )
    northing = north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)
    sets = F.element_at(F.array(*[F.lit(s) for s in COLUMN_SETS]), (zone - 1) % 3 + 1)
    column = F.substring(sets, F.floor(easting / 100_000).cast("int"), F.lit(1))
    row = F.pmod(F.floor(northing / 100_000) + F.when(zone % 2 == 0, 5).otherwise(0), F.lit(20))
    return [zone, band, F.concat(column, F.substring(F.lit(ROW_LETTERS), row.cast("int") + 1, F.lit(1)))]


def web_tile(lat: Column, lon: Column, zoom: Column) -> list[Column]:
    n = F.pow(F.lit(2.0), zoom)
    return [((lon + 180) / 360 * n).cast("long"), ((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n).cast("long")]


def web_tile_corner(x: Column, y: Column, zoom: Column) -> list[Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = F.pow(F.lit(2.0), zoom)
    return [x / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))]


def texel(e: Column, n: Column, e0: float, n0: float, res: float, height: int, width: int) -> list[Column]:
    """Row and column of the raster, clipped to it; row 0 is the southern one."""
    inside = lambda c, k: F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor(c)))
    return [inside((n - n0) / res, height), inside((e - e0) / res, width)]

"""Sun and moon positions (published low-precision series) as column expressions over UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _poly(x: Column, *c: float) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = k + x * out
    return out


def _sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def julian_day(seconds: Column) -> Column:
    """From seconds since 1970-01-01 UTC (Gregorian calendar)."""
    return seconds / 86400 + 2440587.5


def century(seconds: Column) -> Column:
    return (julian_day(seconds) - 2451545.0) / 36525


def sun_terms(seconds: Column) -> list[Column]:
    """Declination (degrees) and equation of time (minutes)."""
    t = century(seconds)
    long0 = F.pmod(_poly(t, 280.46646, 36000.76983, 0.0003032), F.lit(360.0))
    anomaly, ecc = _poly(t, 357.52911, 35999.05029, -0.0001537), _poly(t, 0.016708634, -0.000042037, -0.0000001267)
    centre = _sin(anomaly) * _poly(t, 1.914602, -0.004817, -0.000014) + _sin(2 * anomaly) * _poly(t, 0.019993, -0.000101) + _sin(3 * anomaly) * 0.000289
    node = _poly(t, 125.04, -1934.136)
    apparent = long0 + centre - 0.00569 - 0.00478 * _sin(node)
    tilt = 23 + (26 + _poly(t, 21.448, -46.815, -0.00059, 0.001813) / 60) / 60 + 0.00256 * _cos(node)
    y = F.tan(F.radians(tilt / 2)) * F.tan(F.radians(tilt / 2))
    time = 4 * F.degrees(
        y * _sin(2 * long0) - 2 * ecc * _sin(anomaly) + 4 * ecc * y * _sin(anomaly) * _cos(2 * long0) - 0.5 * y * y * _sin(4 * long0) - 1.25 * ecc * ecc * _sin(2 * anomaly)
    )
    return [F.degrees(F.asin(_sin(tilt) * _sin(apparent))), time]


def clipped(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def refraction(elevation: Column) -> Column:
    """Degrees to add to a geometric elevation."""
    te = F.tan(F.radians(F.greatest(elevation, F.lit(-0.99))))
    high = 58.1 / te - 0.07 / F.pow(te, 3) + 0.000086 / F.pow(te, 5)
    low = _poly(elevation, 1735.0, -518.2, 103.4, -12.79, 0.711)
    return F.when(elevation >= 85, 0.0).when(elevation > 5, high).when(elevation > -0.575, low).otherwise(-20.772 / te) / 3600


def sun(seconds: Column, lat: Column, lon: Column) -> list[Column]:
    """Azimuth (from north, clockwise) and elevation with refraction, degrees."""
    dec, time = sun_terms(seconds)
    solar = F.pmod(F.pmod(seconds, F.lit(86400.0)) / 60 + time + 4 * lon, F.lit(1440.0))
    hour = solar / 4 - 180
    cos_zenith = clipped(_sin(lat) * _sin(dec) + _cos(lat) * _cos(dec) * _cos(hour))
    zenith = F.acos(cos_zenith)
    turn = F.degrees(F.acos(clipped((_sin(lat) * cos_zenith - _sin(dec)) / (_cos(lat) * F.sin(zenith)))))
    azimuth = F.when(F.abs(F.sin(zenith)) < 1e-9, 0.0).when(hour > 0, F.pmod(turn + 180, F.lit(360.0))).otherwise(F.pmod(540 - turn, F.lit(360.0)))
    elevation = 90 - F.degrees(zenith)
    return [azimuth, elevation + refraction(elevation)]


def moon(seconds: Column, lat: Column, lon: Column) -> list[Column]:
    """Azimuth and elevation of the moon's centre seen from the earth's, degrees."""
    t = century(seconds)
    wave = lambda size, at, rate: size * _sin(_poly(t, at, rate))
    long_ = _poly(t, 218.32, 481267.881) + wave(6.29, 135.0, 477198.87) - wave(1.27, 259.3, -413335.36) + wave(0.66, 235.7, 890534.22)
    long_ = F.pmod(long_ + wave(0.21, 269.9, 954397.74) - wave(0.19, 357.5, 35999.05) - wave(0.11, 186.5, 966404.03), F.lit(360.0))
    beta = wave(5.13, 93.3, 483202.02) + wave(0.28, 228.2, 960400.89) - wave(0.28, 318.3, 6003.15) - wave(0.17, 217.6, -407332.21)
    tilt = _poly(t, 23.4393, -0.013)
    sin_dec = clipped(_sin(beta) * _cos(tilt) + _cos(beta) * _sin(tilt) * _sin(long_))
    cos_dec = F.sqrt(1 - sin_dec * sin_dec)
    ra = F.degrees(F.atan2(_sin(long_) * _cos(tilt) - F.tan(F.radians(beta)) * _sin(tilt), _cos(long_)))
    hour = F.pmod(F.pmod(280.46061837 + 360.98564736629 * (julian_day(seconds) - 2451545.0) + lon, F.lit(360.0)) - ra, F.lit(360.0))
    elevation = F.degrees(F.asin(clipped(_sin(lat) * sin_dec + _cos(lat) * cos_dec * _cos(hour))))
    azimuth = F.degrees(F.atan2(-cos_dec * _sin(hour), sin_dec * _cos(lat) - cos_dec * _cos(hour) * _sin(lat)))
    return [F.pmod(azimuth, F.lit(360.0)), elevation]


def direction(azimuth: Column, elevation: Column) -> list[Column]:
    """Unit vector (east, north, up)."""
    return [_sin(azimuth) * _cos(elevation), _cos(azimuth) * _cos(elevation), _sin(elevation)]


def sun_heading(sun_azimuth: Column, sun_elevation: Column, seen_azimuth: Column, seen_elevation: Column) -> Column:
    """Heading from a sun sighting; null below 5 degrees or where the elevations differ by more than 12."""
    fits = (sun_elevation >= 5) & (F.abs(sun_elevation - seen_elevation) <= 12)
    return F.when(fits, F.pmod(sun_azimuth - seen_azimuth, F.lit(360.0)))

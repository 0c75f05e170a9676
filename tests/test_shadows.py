"""Shadows painted for known heights: heights come back, and rays that another building cuts are not used."""

import math

import numpy as np
import pytest

from skylattice.operators import polygons, shadows
from skylattice.operators.shadows import Sun

RES, SIZE, SUN = 0.5, 400, Sun(azimuth=150.0, elevation=50.0)


def scene(spark, shapes):
    """Ground at 0.8, roofs at 0.7, shadows at 0.25 for ``shapes`` (ring of metres, height, known)."""
    gray, inside = np.full((SIZE, SIZE), 0.8), []
    yy, xx = (np.mgrid[0:SIZE, 0:SIZE] + 0.5) * RES
    for ring, *_ in shapes:
        odd = np.zeros((SIZE, SIZE), dtype=bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                odd ^= ((ay <= yy) != (by <= yy)) & (ax + (yy - ay) * (bx - ax) / (by - ay) <= xx)
        inside.append(odd)
    de, dn = SUN.away()
    for odd, (_, height, _) in zip(inside, shapes):
        for t in np.arange(RES / 2, height / math.tan(math.radians(SUN.elevation)), RES / 2):
            gray[np.roll(np.roll(odd, round(dn * t / RES), 0), round(de * t / RES), 1)] = 0.25
    for odd in inside:
        gray[odd] = 0.7
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring]], float(h) if known else None) for k, (ring, h, known) in enumerate(shapes)]
    b = spark.createDataFrame(rows, f"id long, rings {polygons.RINGS}, height_m double")
    px = spark.createDataFrame([(r, c, float(gray[r, c])) for r in range(SIZE) for c in range(SIZE)], "row long, col long, gray double")
    return shadows.outlines(b, "id", "rings"), px


def square(x, y, w=20, h=16):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_height_of_a_lone_building(spark):
    b, px = scene(spark, [(square(90, 90), 20.0, False)])
    rays = shadows.shadow_rays(b, px, "id", SUN, RES)
    got = shadows.shadow_heights(rays, "id", SUN, RES).collect()
    assert len(got) == 1 and got[0].height_m == pytest.approx(20.0, rel=0.3) and got[0].rays >= 3
    assert {r.state for r in rays.collect()} <= {"shadow", "lit"}


def test_a_near_building_cuts_rays(spark):
    """The second building stands in the shadow's way: rays that meet it are hidden, and the height comes from the others."""
    de, dn = SUN.away()
    other = square(90 + de * 9, 90 + 16 + dn * 6, 8, 10)
    b, px = scene(spark, [(square(90, 90), 20.0, False), (other, 30.0, True)])
    rays = shadows.shadow_rays(b, px, "id", SUN, RES).where("id = 0").collect()
    hidden = [r for r in rays if r.state == "hidden"]
    free = [r for r in rays if r.state == "shadow"]
    assert hidden and free and all(r.reach is None for r in hidden)
    alone, lone_px = scene(spark, [(square(90, 90), 20.0, False)])
    assert {r.i for r in hidden} <= {r.i for r in shadows.shadow_rays(alone, px, "id", SUN, RES).collect() if r.state == "shadow"}  # without the index they count


def test_rays_that_leave_the_image_and_tagged_buildings(spark):
    b, px = scene(spark, [(square(3, 170, 20, 20), 40.0, False), (square(100, 50), 10.0, True)])
    rays = shadows.shadow_rays(b, px, "id", SUN, RES).collect()
    assert {r.id for r in rays} == {0} and any(r.state == "outside" for r in rays)
    assert shadows.shadow_rays(b.where("false"), px, "id", SUN, RES).count() == 0
    assert shadows.shadow_heights(shadows.shadow_rays(b, px, "id", SUN, RES), "id", Sun(150.0, 5.0), RES).count() == 0

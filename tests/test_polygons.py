"""Burning of polygons against a plain even-odd test of every texel."""

import random

from skylattice.operators import polygons
from skylattice.plans import rasters as plans


def inside(rings, x, y):
    odd = False
    for ring in rings:
        if len(ring) < 3:
            continue
        closed = ring if ring[0] == ring[-1] else ring + ring[:1]
        for (ax, ay), (bx, by) in zip(closed, closed[1:]):
            if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
                odd = not odd
    return odd


def shapes():
    r = random.Random(4)
    star = lambda x, y, k: [(x + r.uniform(1, 9) * [1, 0.7, -0.5, -1, 0.1][i % 5], y + r.uniform(1, 9) * [0, 1, 0.9, -0.6, -1][i % 5]) for i in range(k)]
    made = [[star(r.uniform(0, 40), r.uniform(0, 40), r.choice([3, 4, 5, 9]))] for _ in range(25)]
    made.append([[(5.0, 5.0), (35.0, 5.0), (35.0, 35.0), (5.0, 35.0)], [(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)], [(15.0, 15.0), (25.0, 15.0), (20.0, 25.0)]])
    made.append([[(0.5, 0.5), (10.5, 0.5), (10.5, 10.5), (0.5, 10.5), (0.5, 0.5)]])  # edges through centres
    made += [[[(1.0, 1.0), (2.0, 2.0)]], [], [[(3.0, 3.0), (9.0, 3.0), (12.0, 3.0)]]]  # nothing to fill
    return made


def test_burn_equals_even_odd_on_every_texel(spark):
    made = shapes()
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings], float(k)) for k, rings in enumerate(made)]
    df = spark.createDataFrame(rows, f"seq long, rings {polygons.RINGS}, h double")
    texels = spark.range(60 * 60).selectExpr("id div 60 AS row", "id % 60 AS col")
    got = {(r.row, r.col): (r.seq, r.h) for r in polygons.burn_polygons(texels, df, "seq", ["seq", "h"], block=16).collect()}
    want = {}
    for row in range(60):
        for col in range(60):
            hit = [k for k, rings in enumerate(made) if inside(rings, col + 0.5, row + 0.5)]
            if hit:
                want[row, col] = (hit[-1], float(hit[-1]))
    assert got == want
    assert polygons.burn_polygons(texels, df.where("false"), "seq", ["seq"]).count() == 0


def test_spans_cut_to_rows(spark):
    df = spark.createDataFrame([(1, [[{"x": 0.0, "y": -1e9}, {"x": 4.0, "y": -1e9}, {"x": 4.0, "y": 1e9}, {"x": 0.0, "y": 1e9}]])], f"seq long, rings {polygons.RINGS}")
    assert sorted((r.row, r.c0, r.c1) for r in polygons.spans(df, "seq", "rings", (2, 4)).collect()) == [(2, 0, 3), (3, 0, 3), (4, 0, 3)]


def test_footprints_have_courts(spark, sf_dir):
    """A texel in a court keeps what was there, though the footprint's outer ring surrounds it."""
    b = plans.footprint_elements(spark, sf_dir, "building")
    assert b.where("type = 'relation'").count() > 0 and b.where("type = 'way'").count() > 0
    with_holes = plans.polygon_burn(spark, sf_dir).count()
    assert 0 < with_holes

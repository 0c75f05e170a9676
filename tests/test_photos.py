"""Photo classes: a golden image with a sky pocket that does not touch the top, and regions against a plain flood."""

import numpy as np

from skylattice.operators import photos

SKY, WALL, LEAF, SEA = (0.55, 0.7, 0.9), (0.5, 0.4, 0.35), (0.2, 0.5, 0.2), (0.3, 0.35, 0.5)


def image():
    rgb = np.empty((48, 64, 3))
    rgb[:] = WALL
    rgb[:16] = SKY
    rgb[4:40, 24:40] = WALL  # a tower into the sky
    rgb[24:32, 28:36] = SKY  # a window: bright, smooth, but walled in
    rgb[16:32, :16] = LEAF
    rgb[36:, 44:] = SEA
    return rgb


def frame(spark, rgb, photo=0):
    return spark.createDataFrame([(photo, r, c, *map(float, rgb[r, c])) for r in range(rgb.shape[0]) for c in range(rgb.shape[1])], "photo long, row long, col long, r double, g double, b double")


def test_golden_image(spark):
    for block in (64, 16):
        got = {(x.row, x.col): x["class"] for x in photos.pixel_classes(frame(spark, image()), 4, block).collect()}
        assert len(got) == 12 * 16
        assert got[0, 0] == got[2, 1] == got[1, 15] == "sky" and got[3, 8] == "building"
        assert got[6, 8] == got[7, 7] == "water"  # the pocket is not joined to the top, so blue below the horizon counts as water
        assert got[5, 1] == "vegetation" and got[10, 13] == "water" and got[6, 12] == "building"


def test_regions_equal_a_flood(spark):
    mask = np.random.default_rng(2).random((2, 50, 70)) < 0.6
    df = spark.createDataFrame([(int(p), int(r), int(c)) for p, r, c in np.argwhere(mask)], "photo long, row long, col long")
    got = {(x.photo, x.row, x.col): x.region for x in photos.regions(df, 16).collect()}
    seen, names = {}, {}
    for at in map(tuple, np.argwhere(mask).tolist()):
        if at in seen:
            continue
        stack, seen[at] = [at], at
        while stack:
            p, r, c = stack.pop()
            for n in ((p, r - 1, c), (p, r + 1, c), (p, r, c - 1), (p, r, c + 1)):
                if 0 <= n[1] < 50 and 0 <= n[2] < 70 and mask[n] and n not in seen:
                    seen[n] = at
                    stack.append(n)
    assert set(got) == set(seen)
    for at, first in seen.items():
        assert names.setdefault(first, got[at]) == got[at]
    assert len(set(names.values())) == len(names)
    assert photos.regions(df.where("false")).count() == 0

"""Heights of buildings from their shadows: rays from the shaded side, cut where another building stands in the way.

Everything is in metres of the local plane. Only buildings without a height cast rays. A ray is a row of steps; the cells it
crosses, each with its first and last step there, are joined with an index of footprints by cell, and only the steps that
lie in a footprint's box are tested against its edges. Brightness is joined by texel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.graph import dealt
from skylattice.operators.polygons import ring_edges


@dataclass(frozen=True)
class Sun:
    azimuth: float
    elevation: float

    def away(self) -> tuple[float, float]:
        """East and north of a step along the shadow."""
        turned = math.radians((self.azimuth + 180.0) % 360.0)
        return math.sin(turned), math.cos(turned)


# Fixed values.
LEAST_ELEVATION, LONGEST, DARKER, LEAST_RAYS, LEAST_LIGHT = 12.0, 150.0, 0.72, 3, 0.15
RAY_POINTS, GROUND_POINTS, RAY_OFF, GROUND_OFF, LEAST_GROUND = 36, 24, 0.6, 6.0, 4
LOW, HIGH = 2.0, 300.0


def outlines(buildings: DataFrame, key: str, rings: str) -> DataFrame:
    """``key``, edges of all rings, box, and edges, centroid and turning sense of the outer (first) ring."""
    outer = ring_edges(F.slice(F.col(rings), 1, 1))
    total = lambda f: F.aggregate("outer", F.lit(0.0), lambda s, e: s + f(e))
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    ends = lambda of, k: of(F.transform("outer", lambda e: e[k]))
    rows = buildings.select("*", ring_edges(F.col(rings)).alias("edges"), outer.alias("outer")).where(F.size("outer") >= 3)
    rows = rows.withColumn("area2", total(cross)).where("area2 <> 0")
    return rows.select(
        *buildings.columns, "edges", "outer", F.signum("area2").alias("sense"),
        (total(lambda e: (e["ax"] + e["bx"]) * cross(e)) / (3 * F.col("area2"))).alias("cx"), (total(lambda e: (e["ay"] + e["by"]) * cross(e)) / (3 * F.col("area2"))).alias("cy"),
        ends(F.array_min, "ax").alias("x0"), ends(F.array_max, "ax").alias("x1"), ends(F.array_min, "ay").alias("y0"), ends(F.array_max, "ay").alias("y1"),
    )


def around(outlined: DataFrame, key: str, n: int, off: float) -> DataFrame:
    """``n`` points at even lengths along each outline, ``off`` metres outside of it: ``key``, i, x, y, cx, cy."""
    length = lambda e: F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"]))
    rows = outlined.withColumn("whole", F.aggregate("outer", F.lit(0.0), lambda s, e: s + length(e)))
    lengths = F.transform("outer", length)
    before = lambda k: F.aggregate(F.slice(F.col("lengths"), 1, k), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("lengths", lengths).select(key, "cx", "cy", "sense", "whole", "lengths", F.posexplode("outer").alias("k", "e"))
    rows = rows.select(key, "cx", "cy", "sense", "whole", "e", before(F.col("k")).alias("done"), F.element_at("lengths", F.col("k") + 1).alias("len")).where("len > 0")
    place = lambda length: F.ceil(F.round(length * n / F.col("whole"), 9))
    first, last = place(F.col("done")), place(F.col("done") + F.col("len")) - 1
    rows = rows.withColumn("first", first).withColumn("last", F.least(last, F.lit(n - 1))).where("first <= last").withColumn("i", F.explode(F.sequence("first", "last")))
    share = (F.col("i") * F.col("whole") / n - F.col("done")) / F.col("len")
    step_x, step_y = (F.col("e.bx") - F.col("e.ax")) / F.col("len"), (F.col("e.by") - F.col("e.ay")) / F.col("len")
    x = F.col("e.ax") + (F.col("e.bx") - F.col("e.ax")) * share + step_y * F.col("sense") * off
    y = F.col("e.ay") + (F.col("e.by") - F.col("e.ay")) * share - step_x * F.col("sense") * off
    return rows.select(key, F.col("i").cast("int").alias("i"), x.alias("x"), y.alias("y"), "cx", "cy")


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies inside of rings by the even-odd rule."""
    left = lambda e: e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.when((e["ay"] <= y) != (e["by"] <= y), left(e) <= x).otherwise(F.lit(False)))


def first_hits(rays: DataFrame, outlined: DataFrame, key: str, direction: tuple[float, float], step: float, cell: float) -> DataFrame:
    """The first step (``cut``) at which each ray (``key``, i, x, y, steps ``low`` to ``high``) is inside of a building other
    than its own."""
    de, dn = direction[0] * step, direction[1] * step
    at = lambda k: (F.floor((F.col("x") + de * k) / cell), F.floor((F.col("y") + dn * k) / cell))
    crossed = F.transform(F.sequence("low", "high"), lambda k: F.struct(at(k)[0].alias("cx"), at(k)[1].alias("cy"), k.alias("k")))
    cells = rays.select(key, "i", "x", "y", F.explode(crossed).alias("c")).groupBy(key, "i", "x", "y", "c.cx", "c.cy").agg(F.min("c.k").alias("a"), F.max("c.k").alias("b"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    index = outlined.select(F.col(key).alias("other"), "edges", "x0", "x1", "y0", "y1").withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    near = cells.join(dealt(index), ["cx", "cy"]).where(F.col("other") != F.col(key))
    px, py = F.col("x") + de * F.col("k"), F.col("y") + dn * F.col("k")
    points = near.withColumn("k", F.explode(F.sequence("a", "b"))).where(px.between(F.col("x0"), F.col("x1")) & py.between(F.col("y0"), F.col("y1")))
    return points.where(_odd(F.col("edges"), px, py)).groupBy(key, "i").agg(F.min("k").alias("cut"))


def brightness(points: DataFrame, ortho: DataFrame, x: Column, y: Column, res: float) -> DataFrame:
    """``points`` with the brightness ``gray`` of their texel (row, col, gray); null outside of the image."""
    placed = points.withColumn("row", F.floor(y / res)).withColumn("col", F.floor(x / res))
    return placed.join(dealt(ortho.select("row", "col", "gray")), ["row", "col"], "left").drop("row", "col")


def ground_light(outlined: DataFrame, buildings: DataFrame, ortho: DataFrame, key: str, sun: Sun, res: float, cell: float) -> DataFrame:
    """Median brightness of the ground around each of ``buildings`` on the sunny side, where four points or more are not
    inside of another building: ``key``, ground."""
    step, (de, dn) = max(res, 0.5), sun.away()
    sunny = (F.col("x") - F.col("cx")) * de + (F.col("y") - F.col("cy")) * dn < 0
    points = around(buildings, key, GROUND_POINTS, GROUND_OFF * step).where(sunny).withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    inside = first_hits(points, outlined, key, (de, dn), step, cell)
    clear = brightness(points.join(dealt(inside), [key, "i"], "left_anti"), ortho, F.col("x"), F.col("y"), res)
    return clear.groupBy(key).agg(F.median("gray").alias("ground"), F.count("*").alias("n")).where(F.col("n") >= LEAST_GROUND).drop("n")


def shadow_rays(outlined: DataFrame, ortho: DataFrame, key: str, sun: Sun, res: float, untagged: str = "height_m is null", cell: float = 64.0) -> DataFrame:
    """One row per ray of a building that has no height and a known ground brightness: ``key``, i, reach (the last dark step
    before two lit ones in a row, null if none is dark) and state: ``shadow``, ``lit``, ``hidden`` (another building comes
    first) or ``outside`` (the image ends first)."""
    step, (de, dn) = max(res, 0.5), sun.away()
    n = int(LONGEST / step)
    own = outlined.where(untagged)
    ground = ground_light(outlined, own, ortho, key, sun, res, cell).where(F.col("ground") >= LEAST_LIGHT)
    shaded = (F.col("x") - F.col("cx")) * de + (F.col("y") - F.col("cy")) * dn > 0
    rays = around(own, key, RAY_POINTS, RAY_OFF * step).where(shaded).join(dealt(ground), key).withColumn("low", F.lit(1)).withColumn("high", F.lit(n))
    rays = rays.join(dealt(first_hits(rays, outlined, key, (de, dn), step, cell)), [key, "i"], "left")
    steps = rays.select(key, "i", "x", "y", "ground", "cut", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.coalesce("cut", F.lit(n))))).alias("k"))
    seen = brightness(steps, ortho, F.col("x") + de * step * F.col("k"), F.col("y") + dn * step * F.col("k"), res)
    w = Window.partitionBy(key, "i").orderBy("k")
    seen = seen.withColumn("dark", F.col("gray") < F.col("ground") * DARKER).withColumn("before", F.lag("dark").over(w))
    stop = F.min(F.when(~F.col("dark") & ~F.col("before"), F.col("k"))).over(Window.partitionBy(key, "i"))
    found = seen.withColumn("stop", F.coalesce(stop, F.lit(n))).groupBy(key, "i").agg(
        F.max(F.when(F.col("dark") & (F.col("k") < F.col("stop") + F.when(F.col("stop") == n, 1).otherwise(0)), F.col("k"))).alias("reach"),
        F.min(F.when(F.col("gray").isNull(), F.col("k"))).alias("out"),
        F.max("cut").alias("cut"),
        F.max("stop").alias("stop"),
    )
    end = lambda c: F.coalesce(F.col(c) <= F.col("stop"), F.lit(False))
    state = F.when(end("out") & F.coalesce(F.col("out") <= F.col("cut"), F.lit(True)), "outside").when(end("cut"), "hidden").when(F.col("reach").isNull(), "lit").otherwise("shadow")
    return found.select(key, "i", F.when(state == "shadow", F.col("reach")).alias("reach"), state.alias("state"))


def shadow_heights(rays: DataFrame, key: str, sun: Sun, res: float) -> DataFrame:
    """Heights of buildings with three usable rays or more: the median length times the tangent of the sun's elevation."""
    step = max(res, 0.5)
    mid = rays.where("state = 'shadow'").groupBy(key).agg((F.median("reach") * step).alias("length"), F.count("*").alias("rays"))
    high = F.col("length") * math.tan(math.radians(sun.elevation))
    fits = (F.col("rays") >= LEAST_RAYS) & F.col("length").between(step, LONGEST) & high.between(LOW, HIGH) & F.lit(sun.elevation >= LEAST_ELEVATION)
    return mid.where(fits).select(key, "rays", high.alias("height_m"))

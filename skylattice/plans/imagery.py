"""Queries of imagery statistics, views, shadows, flow fits, and model hooks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import geo, raster
from skylattice.operators import imagery, photos, rasters, shadows
from skylattice.operators.graph import dealt, grid_components, written
from skylattice.operators.quantiles import exact_quantiles
from skylattice.plans.base import r
from skylattice.plans.rasters import HOLE, OUTER, SHAPES, SLOPES, burnt, slopes
from skylattice.plans.scalars import ROOF, WALL
from skylattice.registry import query
from skylattice.sources import domain
from skylattice.sources.domain import with_tables

c = lambda name: F.col(name)


@query("S02_image_lookup", with_tables("frames", "SELECT frame_id, frame_id // 512 AS shard, frame_id % 512 AS pos, octet_length(encode(repeat('px', CAST(frame_id % 50 + 1 AS INTEGER)))) AS bytes FROM frames WHERE frame_id % 10 = 3"))
def image_lookup(spark, sf_dir):
    """Images, binary and keyed by shard and place, looked up for a set of captures."""
    f = domain.frames(spark, sf_dir).select("frame_id")
    images = f.select(F.floor(c("frame_id") / 512).alias("shard"), (c("frame_id") % 512).alias("pos"), F.encode(F.repeat(F.lit("px"), (c("frame_id") % 50 + 1).cast("int")), "UTF-8").alias("rgb"))
    wanted = f.where("frame_id % 10 = 3").select("frame_id", F.floor(c("frame_id") / 512).alias("shard"), (c("frame_id") % 512).alias("pos"))
    return wanted.join(images, ["shard", "pos"]).select("frame_id", "shard", "pos", F.length("rgb").cast("long").alias("bytes"))


@query("S13_orthophoto", with_tables("ortho_px", "SELECT scene, count(*) AS n, round(avg(gray), 4) AS mean, count(*) FILTER (valid) AS usable FROM ortho_px GROUP BY scene"))
def orthophoto(spark, sf_dir):
    return domain.ortho_px(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n"), r(F.avg("gray")).alias("mean"), F.count_if("valid").alias("usable"))


@query("G08_pose_grid", with_tables("texels", "SELECT row, col, yaw, round(ground + 60, 3) AS up FROM texels CROSS JOIN (VALUES (0), (90), (180), (270)) y(yaw) WHERE row % 10 = 5 AND col % 10 = 5"))
def pose_grid(spark, sf_dir):
    """Poses every ten texels in four directions, 60 m above the ground."""
    t = domain.texels(spark, sf_dir).where("row % 10 = 5 and col % 10 = 5")
    return t.select("row", "col", F.explode(F.array(*[F.lit(y) for y in (0, 90, 180, 270)])).alias("yaw"), r(c("ground") + 60, 3).alias("up"))


MASK = """, m AS (SELECT row, col, row * 120 + col AS node FROM texels WHERE h % 3 = 0),
e AS (SELECT a.node AS x, b.node AS y FROM m a JOIN m b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
walk(node, root) AS (SELECT node, node FROM m UNION SELECT b.y, w.root FROM walk w JOIN both_ b ON b.x = w.node WHERE b.y > w.root),
comp AS (SELECT node, min(root) AS component FROM walk GROUP BY node),
blob AS (SELECT component, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, avg(row) AS mid_r, avg(col) AS mid_c FROM m JOIN comp USING (node) GROUP BY component),
gate AS (SELECT *, area / CAST((r1 - r0 + 1) * (c1 - c0 + 1) AS DOUBLE) AS fill FROM blob)
"""


def recursive(statement: str) -> str:
    return statement.replace("WITH ", "WITH RECURSIVE ", 1)


def components(spark, sf_dir):
    return grid_components(domain.texels(spark, sf_dir).where("h % 3 = 0").select("row", "col"), 120)


@query("A45_pixel_components", recursive(with_tables("texels", MASK + "SELECT node, component FROM comp")))
def pixel_components(spark, sf_dir):
    return components(spark, sf_dir).select("node", "component")


@query("A45_building_points", recursive(with_tables("view_px", """, m AS (SELECT view_id::BIGINT AS photo, r::BIGINT AS row, c::BIGINT AS col, r::BIGINT * 64 + c AS node, (c - 32) / 60.0::DOUBLE * depth AS x, depth AS z FROM view_px WHERE building),
e AS (SELECT a.photo, a.node AS x, b.node AS y FROM m a JOIN m b ON a.photo = b.photo AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col))),
both_ AS (SELECT photo, x, y FROM e UNION ALL SELECT photo, y, x FROM e),
walk(photo, node, root) AS (SELECT photo, node, node FROM m UNION SELECT w.photo, b.y, w.root FROM walk w JOIN both_ b ON b.photo = w.photo AND b.x = w.node WHERE b.y > w.root),
comp AS (SELECT photo, node, min(root) AS root FROM walk GROUP BY photo, node)
SELECT photo, root, count(*) AS px, round(median(m.x), 4) AS x, round(median(m.z), 4) AS z FROM comp JOIN m USING (photo, node) GROUP BY photo, root HAVING count(*) >= 6 AND isfinite(median(m.x)) AND isfinite(median(m.z))""")))  # fmt: skip
def building_points(spark, sf_dir):
    """Ground points of the buildings in sight: median place of each region of six pixels or more, seen through a pinhole
    camera of focal length 60."""
    v = domain.view_px(spark, sf_dir).where("building")
    px = v.select(c("view_id").cast("long").alias("photo"), c("r").cast("long").alias("row"), c("c").cast("long").alias("col"), ((c("c") - 32) / 60.0 * c("depth")).alias("x"), c("depth").alias("z"))
    found = px.join(photos.regions(px, 16), ["photo", "row", "col"])
    points = found.groupBy("photo", "region").agg(F.min(c("row") * 64 + c("col")).alias("root"), F.count("*").alias("px"), F.median("x").alias("x"), F.median("z").alias("z"))
    finite = lambda k: F.abs(k) < float("inf")
    return points.where((c("px") >= photos.LEAST_BLOB) & finite("x") & finite("z")).select("photo", "root", "px", r(c("x")).alias("x"), r(c("z")).alias("z"))


@query("A46_blob_table", recursive(with_tables("texels", MASK + "SELECT component, area, round(mid_r, 4) AS mid_r, round(mid_c, 4) AS mid_c, r0, r1, c0, c1 FROM blob")))
def blob_table(spark, sf_dir):
    return imagery.blobs(components(spark, sf_dir), []).select("component", "area", r(c("mid_r")).alias("mid_r"), r(c("mid_c")).alias("mid_c"), "r0", "r1", "c0", "c1")


@query("P08_blob_gates", recursive(with_tables("texels", MASK + "SELECT component, area, round(fill, 4) AS fill FROM gate WHERE area BETWEEN 4 AND 200 AND round(fill, 6) >= CAST(0.4 AS DOUBLE)")))
def blob_gates(spark, sf_dir):
    b = imagery.blobs(components(spark, sf_dir), [])
    return b.where(c("area").between(4, 200) & (F.round("fill", 6) >= 0.4)).select("component", "area", r(c("fill")).alias("fill"))


DISC = """, d AS (SELECT col // 40 AS image, count(*) FILTER (ground > 29) AS n, stddev_pop(col % 40) FILTER (ground > 29) AS sx, stddev_pop(row) FILTER (ground > 29) AS sy,
  avg(col % 40) FILTER (ground > 29) AS mx, avg(row) FILTER (ground > 29) AS my, count(*) AS k, max(row) + 1 AS high FROM texels GROUP BY 1),
ok AS (SELECT * FROM d WHERE n >= 3 AND n <= k * CAST(0.05 AS DOUBLE) AND sx <= 40 * CAST(0.08 AS DOUBLE) AND sy <= high * CAST(0.08 AS DOUBLE))
"""


def discs(spark, sf_dir):
    """Bright compact spot of each image (strips of 40 columns, the ground as brightness); an image without one has no row."""
    t = domain.texels(spark, sf_dir).select(F.floor(c("col") / 40).alias("image"), (c("col") % 40).alias("x"), "row", (c("ground") > 29).alias("hit"))
    on = lambda k: F.when(c("hit"), c(k))
    d = t.groupBy("image").agg(F.count_if("hit").alias("n"), F.stddev_pop(on("x")).alias("sx"), F.stddev_pop(on("row")).alias("sy"), F.avg(on("x")).alias("mx"), F.avg(on("row")).alias("my"), F.count("*").alias("k"), (F.max("row") + 1).alias("high"))
    return d.where((c("n") >= 3) & (c("n") <= c("k") * 0.05) & (c("sx") <= 40 * 0.08) & (c("sy") <= c("high") * 0.08))


@query("P12_sun_disc", with_tables("texels", DISC + "SELECT image, n, round(mx, 4) AS mx, round(my, 4) AS my FROM ok"))
def sun_disc(spark, sf_dir):
    return discs(spark, sf_dir).select("image", "n", r(c("mx")).alias("mx"), r(c("my")).alias("my"))


TILT = math.radians(10.0)
_X, _Y = "((mx - 20) / 80)", "((62 - my) / 80)"
_UP, _AHEAD = (f"({math.cos(TILT)!r}::DOUBLE * {_Y} - {math.sin(TILT)!r}::DOUBLE)", f"({math.sin(TILT)!r}::DOUBLE * {_Y} + {math.cos(TILT)!r}::DOUBLE)")


@query("F64_disc_direction", with_tables("texels", DISC + f"SELECT image, round(degrees(atan2({_X}, {_AHEAD})), 4) AS azimuth, round(degrees(asin({_UP} / sqrt({_X} ** 2 + {_UP} ** 2 + {_AHEAD} ** 2))), 4) AS elevation FROM ok"))
def disc_direction(spark, sf_dir):
    """Body azimuth and elevation of the disc's centre through a pinhole camera (focal length 80) that is tilted by ten degrees."""
    x, y = (c("mx") - 20) / 80, (62 - c("my")) / 80
    up, ahead = math.cos(TILT) * y - math.sin(TILT), math.sin(TILT) * y + math.cos(TILT)
    far = F.sqrt(x * x + up * up + ahead * ahead)
    return discs(spark, sf_dir).select("image", r(F.degrees(F.atan2(x, ahead))).alias("azimuth"), r(F.degrees(F.asin(up / far))).alias("elevation"))


RAYS = """, b AS (SELECT p_partkey AS id, p_partkey * 7919 % 100 + 5 AS row, p_partkey * 104729 % 90 + 5 AS col FROM part WHERE p_size % 3 = 0),
s AS (SELECT id, ray, step, t.build_h < 8 AND (t.h % 4 <> 0) AS dark FROM b CROSS JOIN range(5) y(ray) CROSS JOIN range(1, 9) z(step) JOIN texels t ON t.row = b.row + step AND t.col = b.col + ray),
l AS (SELECT *, NOT dark AND lag(NOT dark) OVER (PARTITION BY id, ray ORDER BY step) AS two FROM s), k AS (SELECT *, min(step) FILTER (two) OVER (PARTITION BY id, ray) AS stop FROM l),
run AS (SELECT id, ray, max(step) AS reach FROM k WHERE dark AND (stop IS NULL OR step < stop) GROUP BY id, ray)
"""


def rays(spark, sf_dir):
    """Five parallel rays of eight steps from each building without a height, on the shadow side."""
    b = domain.raw(spark, sf_dir, "part").where("p_size % 3 = 0").selectExpr("p_partkey AS id", "p_partkey * 7919 % 100 + 5 AS br", "p_partkey * 104729 % 90 + 5 AS bc")
    steps = b.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(8))))
    at = steps.select("id", "ray", "step", (c("br") + c("step")).alias("row"), (c("bc") + c("ray")).alias("col"))
    t = domain.texels(spark, sf_dir).select("row", "col", ((c("build_h") < 8) & (c("h") % 4 != 0)).alias("dark"))
    return at.join(dealt(t), ["row", "col"])


@query("W13_shadow_runs", with_tables("texels", RAYS + "SELECT id, CAST(ray AS INTEGER) AS ray, CAST(reach AS INTEGER) AS reach FROM run"))
def shadow_runs(spark, sf_dir):
    return imagery.shadow_runs(rays(spark, sf_dir), c("dark"))


SUN = shadows.Sun(217.3, 40.0)
_DE, _DN = (f"({x!r}::DOUBLE)" for x in SUN.away())
_OUTLINE = ", ".join(f"({k}, {hole}, {i}, {ax}, {ay}, {bx}, {by})" for k in range(4) for hole, ring in ((0, OUTER[k]), (1, HOLE[k] or [])) for i, ((ax, ay), (bx, by)) in enumerate(zip(ring, ring[1:])))
CAST_RAYS = f""", b AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, p_partkey % 20 * 15 + 0.137::DOUBLE AS x0, p_partkey // 20 * 12.5::DOUBLE + 0.291::DOUBLE AS y0, 5.5::DOUBLE + p_size % 3 * 1.75::DOUBLE AS w, 5.0::DOUBLE + p_size % 4 * 1.5::DOUBLE AS v, p_size % 3 = 0 AS untagged FROM part),
unit AS (SELECT kind, hole, i, px::DOUBLE AS px, py::DOUBLE AS py, qx::DOUBLE AS qx, qy::DOUBLE AS qy FROM (VALUES {_OUTLINE}) u(kind, hole, i, px, py, qx, qy)),
edge AS (SELECT id, untagged, hole, i, b.x0, b.y0, b.x0 + w AS x1, b.y0 + v AS y1, b.x0 + w * px AS ax, b.y0 + v * py AS ay, b.x0 + w * qx AS bx, b.y0 + v * qy AS fy FROM b JOIN unit USING (kind)),
outer_edge AS (SELECT *, sqrt((bx - ax) ** 2 + (fy - ay) ** 2) AS len, ax * fy - bx * ay AS cross2 FROM edge WHERE hole = 0),
mid AS (SELECT id, sum(len) AS whole, sum(cross2) AS area2, sum((ax + bx) * cross2) / (3 * sum(cross2)) AS cx, sum((ay + fy) * cross2) / (3 * sum(cross2)) AS cy FROM outer_edge GROUP BY id),
run AS (SELECT e.*, m.* EXCLUDE (id), coalesce(sum(len) OVER (PARTITION BY e.id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM outer_edge e JOIN mid m ON m.id = e.id WHERE untagged),
pts AS (
  SELECT id, n, k.i AS i, cx, cy, ax + (bx - ax) * ((k.i * whole / n - done) / len) + (fy - ay) / len * sign(area2) * far AS x, ay + (fy - ay) * ((k.i * whole / n - done) / len) - (bx - ax) / len * sign(area2) * far AS y
  FROM run, (VALUES (36, 1.5::DOUBLE), (24, 15::DOUBLE)) m(n, far), (SELECT unnest(range(36)) AS i) k
  WHERE k.i < n AND k.i >= ceil(round(done * n / whole, 9)) AND k.i <= ceil(round((done + len) * n / whole, 9)) - 1
),
walk AS (
  SELECT id, n, i, 0 AS k, x, y FROM pts WHERE n = 24 AND (x - cx) * {_DE} + (y - cy) * {_DN} < 0
  UNION ALL SELECT id, n, i, step AS k, x + {_DE} * 2.5::DOUBLE * step AS x, y + {_DN} * 2.5::DOUBLE * step AS y FROM pts, (SELECT unnest(range(1, 61)) AS step) WHERE n = 36 AND (x - cx) * {_DE} + (y - cy) * {_DN} > 0
),
boxes AS (SELECT DISTINCT id, x0, y0, x1, y1 FROM edge),
met AS (SELECT w.id, w.n, w.i, w.k, o.id AS other, w.x, w.y FROM walk w JOIN boxes o ON w.x BETWEEN o.x0 AND o.x1 AND w.y BETWEEN o.y0 AND o.y1 AND o.id <> w.id),
odd AS (SELECT m.id, m.n, m.i, m.k FROM met m JOIN edge e ON e.id = m.other AND (e.ay <= m.y) <> (e.fy <= m.y) AND e.ax + (m.y - e.ay) * (e.bx - e.ax) / (e.fy - e.ay) <= m.x GROUP BY m.id, m.n, m.i, m.k, m.other HAVING count(*) % 2 = 1),
cuts AS (SELECT id, n, i, min(k) AS cut FROM odd GROUP BY id, n, i),
grid AS (SELECT row, col, CASE WHEN (row * 2 + col) // 8 % 2 = 0 THEN 0.25::DOUBLE ELSE 0.8::DOUBLE END AS gray FROM (SELECT DISTINCT row FROM texels), (SELECT unnest(range(120)) AS col)),
lit AS (SELECT w.*, g.gray, c.cut FROM walk w LEFT JOIN grid g ON g.row = CAST(floor(w.y / 2.5::DOUBLE) AS BIGINT) AND g.col = CAST(floor(w.x / 2.5::DOUBLE) AS BIGINT) LEFT JOIN cuts c ON c.id = w.id AND c.n = w.n AND c.i = w.i),
ground AS (SELECT id, median(gray) AS ground FROM lit WHERE n = 24 AND cut IS NULL GROUP BY id HAVING count(*) >= 4 AND median(gray) >= 0.15::DOUBLE),
seen AS (SELECT l.id, l.i, l.k, l.gray, l.cut, gray < ground * 0.72::DOUBLE AS dark FROM lit l JOIN ground USING (id) WHERE n = 36 AND k <= coalesce(cut, 60)),
prev AS (SELECT *, lag(dark) OVER (PARTITION BY id, i ORDER BY k) AS was FROM seen),
ended AS (SELECT *, coalesce(min(k) FILTER (NOT dark AND NOT was) OVER (PARTITION BY id, i), 60) AS stop FROM prev),
ray AS (SELECT id, i, max(k) FILTER (dark AND (k < stop OR stop = 60)) AS reach, min(k) FILTER (gray IS NULL) AS gone, max(cut) AS cut, max(stop) AS stop FROM ended GROUP BY id, i)
"""


@query("J28_shadow_rays", with_tables("texels", CAST_RAYS + """, said AS (SELECT id, i, reach, CASE WHEN coalesce(gone <= stop, false) AND coalesce(gone <= cut, true) THEN 'outside' WHEN coalesce(cut <= stop, false) THEN 'hidden' WHEN reach IS NULL THEN 'lit' ELSE 'shadow' END AS state FROM ray)
SELECT id, i::INTEGER AS ray, CASE WHEN state = 'shadow' THEN reach END AS reach, state FROM said"""))  # fmt: skip
def shadow_rays(spark, sf_dir):
    """Rays from buildings without a height over striped ground; others cut them."""
    b = domain.raw(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CAST(p_partkey % 4 AS INT) AS kind", "p_partkey % 20 * 15 + 0.137D AS x0", "p_partkey div 20 * 12.5D + 0.291D AS y0", "5.5D + p_size % 3 * 1.75D AS w", "5.0D + p_size % 4 * 1.5D AS v",
        "CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS height_m",
    )
    ring = lambda points: F.array(*[F.struct((c("x0") + c("w") * x).alias("x"), (c("y0") + c("v") * y).alias("y")) for x, y in points])
    rings = F.element_at(F.array(*[F.array(ring(o), *([ring(h)] if h else [])) for o, h in zip(OUTER, HOLE)]), c("kind") + 1)
    outlined = shadows.outlines(b.select("id", "height_m", rings.alias("rings")), "id", "rings")
    rows = domain.texels(spark, sf_dir).select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(119).cast("long"))))
    ortho = rows.withColumn("gray", F.when(F.expr("(row * 2 + col) div 8 % 2 = 0"), 0.25).otherwise(0.8))
    found = shadows.shadow_rays(outlined, ortho, "id", SUN, 2.5)
    return found.select("id", c("i").alias("ray"), c("reach").cast("long").alias("reach"), "state")


@query("A63_shadow_height", with_tables("texels", RAYS + f"SELECT id, count(*) AS rays, round(median(reach) * CAST({2.5 * math.tan(math.radians(40))!r} AS DOUBLE), 4) AS height_m FROM run WHERE reach >= 2 GROUP BY id HAVING count(*) >= 3"))
def shadow_height(spark, sf_dir):
    """Median shadow length of three rays or more, times the tangent of the sun's elevation (40 degrees)."""
    runs = imagery.shadow_runs(rays(spark, sf_dir), c("dark")).where("reach >= 2")
    h = runs.groupBy("id").agg(F.count("*").alias("rays"), F.median("reach").alias("mid")).where("rays >= 3")
    return h.select("id", "rays", r(c("mid") * (2.5 * math.tan(math.radians(40)))).alias("height_m"))


@query("F60_shadow_support", with_tables("texels", """, b AS (SELECT p_partkey AS id, p_partkey * 7919 % 100 + 8 AS row, p_partkey * 104729 % 90 + 8 AS col FROM part),
o AS (SELECT b.id, side, t.h % 256 AS v FROM b CROSS JOIN (VALUES (-1), (1)) s(side) CROSS JOIN (VALUES (2), (3), (4)) k(far) JOIN texels t ON t.row = b.row + side * far AND t.col = b.col),
m AS (SELECT id, median(v) FILTER (side = 1) AS shade, median(v) FILTER (side = -1) AS sunny FROM o GROUP BY id) SELECT id, coalesce(shade < sunny * CAST(0.85 AS DOUBLE), false) AS supported FROM m"""))  # fmt: skip
def shadow_support(spark, sf_dir):
    """Whether the side away from the sun is darker than the other: medians of three probes each."""
    b = domain.raw(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey * 7919 % 100 + 8 AS br", "p_partkey * 104729 % 90 + 8 AS col")
    at = b.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("far", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).withColumn("row", c("br") + c("side") * c("far"))
    v = at.join(dealt(domain.texels(spark, sf_dir).select("row", "col", (c("h") % 256).alias("v"))), ["row", "col"])
    mid = lambda s: F.median(F.when(c("side") == s, c("v")))
    return v.groupBy("id").agg(F.coalesce(mid(1) < mid(-1) * 0.85, F.lit(False)).alias("supported"))


@query("J29_archetype_stamp", with_tables("texels", SHAPES + "SELECT t.row, t.col, round(greatest(t.build_h, b.h * (1 + CAST(0.45 AS DOUBLE) * greatest(0, least(1, 1 - (b.seq % 10) / CAST(12 AS DOUBLE))))), 4) AS h FROM burnt b JOIN texels t USING (row, col)"))
def archetype_stamp(spark, sf_dir):
    """Spires stamped over the footprints that cover a texel, where they are taller than what is there."""
    t = domain.texels(spark, sf_dir).select("row", "col", "build_h")
    top = raster.archetype_height(F.lit("spire_tower"), c("h"), (c("seq") % 10).cast("double"), F.lit(12.0), F.lit(0.0), 2.0)
    return burnt(spark, sf_dir).join(t, ["row", "col"]).select("row", "col", r(F.greatest("build_h", top)).alias("h"))


_HALVES = (("top", "r < 24"), ("bottom", "r >= 24"))
_BIN = "CASE WHEN depth < 'Infinity'::DOUBLE AND ln(1 + depth) * (12 / 8.5::DOUBLE) BETWEEN 0 AND 12 THEN least(11, floor(ln(1 + depth) * (12 / 8.5::DOUBLE))) END"
_PARTS = (
    [f"count(*) FILTER (bin = {k}) / greatest(1, count(*) FILTER (depth < 'Infinity'::DOUBLE))::DOUBLE" for k in range(12)]
    + [f"coalesce(avg(({kind})::INT::DOUBLE) FILTER ({half}), 0)" for kind in ("building", "vegetation", "depth = 'Infinity'::DOUBLE", "water") for _, half in _HALVES]
    + [f"coalesce(1 - min(r) FILTER (building AND c // 4 = {k}) / 48::DOUBLE, 0)" for k in range(16)]
)


@query("A26_view_descriptor", with_tables("view_px", f", b AS (SELECT *, {_BIN} AS bin FROM view_px), v AS (SELECT view_id, [{', '.join(_PARTS)}] AS d FROM b GROUP BY view_id), n AS (SELECT view_id, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS size FROM v), u AS (SELECT view_id, size, unnest(d) AS x, unnest(range(36)) AS part FROM n) SELECT view_id, CAST(part AS INTEGER) AS part, round(CASE WHEN size > 0 THEN x / size ELSE x END, 4) AS value FROM u"))
def view_descriptor(spark, sf_dir):
    """The descriptor of every view, a row for each of its 36 parts."""
    d = imagery.view_descriptor(domain.view_px(spark, sf_dir), 64, 48)
    return d.select("view_id", F.posexplode("descriptor").alias("part", "value")).withColumn("value", r(c("value")))


VIEWS = """, p AS (SELECT a.view_id, a.depth AS ad, b.depth AS bd, a.building AS ab, b.building AS bb, a.water AS aw, b.water AS bw FROM view_px a JOIN view_px b ON b.view_id = a.view_id + 1 AND a.r = b.r AND a.c = b.c),
s AS (SELECT view_id, coalesce(count(*) FILTER (ab AND bb) / nullif(count(*) FILTER (ab OR bb), 0)::DOUBLE, 1) AS silhouette, avg(((ad = 'Infinity'::DOUBLE) = (bd = 'Infinity'::DOUBLE))::INT::DOUBLE) AS sky,
  CASE WHEN count(*) FILTER (aw) > 0 THEN coalesce(count(*) FILTER (aw AND bw) / nullif(count(*) FILTER (aw OR bw), 0)::DOUBLE, 1) END AS water,
  greatest(0, least(1, 1 - 2 * median(CASE WHEN ad < 'Infinity'::DOUBLE AND bd < 'Infinity'::DOUBLE THEN abs(ad - bd) / greatest(ad, 1) END))) AS near,
  count(*) FILTER (ad < 'Infinity'::DOUBLE AND bd < 'Infinity'::DOUBLE) AS both_ FROM p GROUP BY view_id),
k AS (SELECT *, CASE WHEN both_ > 0 THEN near END AS depth FROM s)
SELECT view_id, round(silhouette, 4) AS silhouette, round(sky, 4) AS sky, round(water, 4) AS water, round(depth, 4) AS depth, round(CASE
  WHEN depth IS NOT NULL AND water IS NOT NULL THEN 0.4::DOUBLE * silhouette + 0.25::DOUBLE * depth + 0.15::DOUBLE * sky + 0.2::DOUBLE * water
  WHEN depth IS NOT NULL THEN 0.5::DOUBLE * silhouette + 0.3::DOUBLE * depth + 0.2::DOUBLE * sky
  WHEN water IS NOT NULL THEN 0.45::DOUBLE * silhouette + 0.25::DOUBLE * sky + 0.3::DOUBLE * water ELSE 0.65::DOUBLE * silhouette + 0.35::DOUBLE * sky END, 4) AS score FROM k"""


@query("A27_view_alignment", with_tables("view_px", VIEWS))
def view_alignment(spark, sf_dir):
    """Every view as a query against the next one."""
    v = domain.view_px(spark, sf_dir)
    side = lambda k, shift: v.select((c("view_id") + shift).alias("view_id"), "r", "c", *[c(x).alias(f"{k}_{x}") for x in ("depth", "building", "water")])
    a = imagery.view_alignment(side("a", 0).join(side("b", -1), ["view_id", "r", "c"]))
    return a.select("view_id", *[r(c(k)).alias(k) for k in ("silhouette", "sky", "water", "depth", "score")])


SETS = """, m AS (SELECT view_id, r, c, (view_id * 1000 + r) * 64 + c AS node FROM view_px WHERE building),
e AS (SELECT a.node AS x, b.node AS y FROM m a JOIN m b ON a.view_id = b.view_id AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c))),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
walk(node, root) AS (SELECT node, node FROM m UNION SELECT b.y, w.root FROM walk w JOIN both_ b ON b.x = w.node WHERE b.y > w.root),
comp AS (SELECT node, min(root) AS component FROM walk GROUP BY node),
pts AS (SELECT view_id, component, avg(r) AS r, avg(c) AS c FROM m JOIN comp USING (node) GROUP BY view_id, component HAVING count(*) >= 6),
ctr AS (SELECT view_id, avg(c) AS mx, avg(r) AS my FROM pts GROUP BY view_id),
dst AS (SELECT a.view_id, avg(sqrt((a.c - b.c) ** 2 + (a.r - b.r) ** 2)) AS scale FROM pts a JOIN pts b ON a.view_id = b.view_id AND a.component < b.component GROUP BY a.view_id)
"""


def point_sets(spark, sf_dir):
    """Centres of the building blobs (six pixels or more) of each view."""
    px = domain.view_px(spark, sf_dir).where("building").select("view_id", (c("view_id") * 1000 + c("r")).alias("row"), c("c").alias("col"))
    b = imagery.blobs(grid_components(px, 64), ["view_id"]).where("area >= 6")
    return b.select("view_id", "component", (c("mid_r") - c("view_id") * 1000).alias("r"), c("mid_c").alias("c"))


@query("A28_constellation_norm", recursive(with_tables("view_px", SETS + "SELECT view_id, component, round((c - mx) / scale, 4) AS x, round((r - my) / scale, 4) AS y FROM pts JOIN ctr USING (view_id) JOIN dst USING (view_id)")))
def constellation_norm(spark, sf_dir):
    p = point_sets(spark, sf_dir)
    mid = p.groupBy("view_id").agg(F.avg("c").alias("mx"), F.avg("r").alias("my"))
    q = p.select("view_id", c("component").alias("other"), c("r").alias("qr"), c("c").alias("qc"))
    pairs = p.join(q, "view_id").where("component < other")  # blobs of one view
    scale = pairs.groupBy("view_id").agg(F.avg(geo.distance(c("c"), c("r"), c("qc"), c("qr"))).alias("scale"))
    return p.join(mid, "view_id").join(scale, "view_id").select("view_id", "component", r((c("c") - c("mx")) / c("scale")).alias("x"), r((c("r") - c("my")) / c("scale")).alias("y"))


@query("A29_constellation_score")
def constellation_score(spark, sf_dir):
    """Each view's points against the next two views' points."""
    p = point_sets(spark, sf_dir)
    own = p.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select(c("view_id").alias("query"), (c("view_id") + c("k")).alias("hypothesis"), F.lit(0).alias("side"), c("c").cast("double").alias("x"), c("r").cast("double").alias("y"))
    model = p.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select((c("view_id") - c("k")).alias("query"), c("view_id").alias("hypothesis"), F.lit(1).alias("side"), c("c").cast("double").alias("x"), c("r").cast("double").alias("y"))
    return imagery.constellation_scores(own.unionByName(model))


def zoned(spark, sf_dir):
    stats = rasters.block_stats(domain.ortho_px(spark, sf_dir), 16)
    return imagery.zones(stats, rasters.like_blocks(stats))


@query("A31_zone_labels")
def zone_labels(spark, sf_dir):
    return zoned(spark, sf_dir)


@query("A32_zone_normalization")
def zone_normalization(spark, sf_dir):
    z = imagery.normalize_zones(domain.ortho_px(spark, sf_dir), zoned(spark, sf_dir), 16)
    return z.select("scene", "row", "col", "zone", *[r(c(k)).alias(k) for k in ("gray", "r", "g", "b")])


#: SQL of windows over a raster of scenes.
def _over(along: str, radius: int | None = None) -> str:
    fixed = "row" if along == "col" else "col"
    return f"OVER (PARTITION BY scene, {fixed} ORDER BY {along}" + (")" if radius is None else f" RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)")


def _step(v: str, along: str, k: int) -> str:
    return f"{'lead' if k > 0 else 'lag'}({v}, {abs(k)}) {_over(along)}" if k else v


def _blurred(v: str, along: str, sigma: float) -> str:
    g = rasters.gaussian(sigma)
    steps = range(1 - len(g), len(g))
    total = " + ".join(f"coalesce({_step(v, along, k)} * {g[abs(k)]!r}::DOUBLE, 0)" for k in steps)
    return f"({total}) / ({' + '.join(f'CASE WHEN {_step(v, along, k)} IS NULL THEN 0 ELSE {g[abs(k)]!r}::DOUBLE END' for k in steps)})"


def _boxes(source: str, v: str, radius: int, name: str) -> str:
    """CTEs ``{name}_x`` and ``{name}``: the source with a box mean of ``v`` as ``name``."""
    return f"""{name}_x AS (SELECT *, sum({v}) {_over("col", radius)} AS sx, count({v}) {_over("col", radius)} AS nx FROM {source}),
{name}_t AS (SELECT * EXCLUDE (sx, nx), sum(sx) {_over("row", radius)} / sum(nx) {_over("row", radius)} AS {name} FROM {name}_x)"""


def _grown(source: str, flag: str, radius: int, name: str, of: str = "bool_or") -> str:
    return f"""{name}_x AS (SELECT * REPLACE ({of}({flag}) {_over("col", radius)} AS {flag}) FROM {source}),
{name} AS (SELECT * REPLACE ({of}({flag}) {_over("row", radius)} AS {flag}) FROM {name}_x)"""


def _opened(source: str, flag: str, name: str) -> str:
    return _grown(source, flag, 1, f"{name}_e", "bool_and") + ",\n" + _grown(f"{name}_e", flag, 1, name)


def _closed(source: str, flag: str, name: str) -> str:
    return _grown(source, flag, 1, f"{name}_d") + ",\n" + _grown(f"{name}_d", flag, 1, name, "bool_and")


def _mirrored(v: str, along: str, k: int) -> str:
    return f"coalesce({_step(v, along, k)}, {_step(v, along, -k)})"


def _smooth(v: str, along: str) -> str:
    return f"{_mirrored(v, along, -1)} + 2 * {v} + {_mirrored(v, along, 1)}"


def _slope(v: str, along: str) -> str:
    return f"{_mirrored(v, along, 1)} - {_mirrored(v, along, -1)}"


CLOUDS = f""", md AS (SELECT scene, median(gray) AS mid FROM scene_px GROUP BY scene), px AS (SELECT *, greatest(r, g, b) - least(r, g, b) AS spread FROM scene_px JOIN md USING (scene)),
s1 AS (SELECT *, {_blurred("gray", "col", 1.0)} AS v1 FROM px), s2 AS (SELECT *, {_blurred("v1", "row", 1.0)} AS smooth FROM s1),
e1 AS (SELECT *, {_slope("smooth", "col")} AS d, {_smooth("smooth", "col")} AS m FROM s2), e2 AS (SELECT *, {_smooth("d", "row")} AS gx, {_slope("m", "row")} AS gy FROM e1),
ro AS (SELECT *, (round(sqrt(gx * gx + gy * gy), 9) > 0.1::DOUBLE)::INT::DOUBLE AS rough FROM e2), {_boxes("ro", "rough", 4, "texture")},
raw AS (SELECT scene, row, col, round(gray - greatest(0.6::DOUBLE, least(mid + 0.15::DOUBLE, 0.72::DOUBLE)), 9) > 0 AND round(spread, 9) < 0.16::DOUBLE AND (round(texture, 9) < 0.35::DOUBLE OR gray > 0.72::DOUBLE) AS cloud,
  round(gray - mid * 0.62::DOUBLE, 9) < 0 AND round(spread, 9) < 0.22::DOUBLE AS shadow FROM texture_t),
{_opened("raw", "cloud", "c0")}, {_grown("c0", "cloud", 5, "c1")}, {_opened("c1", "shadow", "h0")},
n0 AS (SELECT *, cloud AS near FROM h0), {_grown("n0", "near", 60, "n1")}, g0 AS (SELECT scene, row, col, cloud, shadow AND near AS shadow FROM n1), {_grown("g0", "shadow", 5, "g1")}
SELECT scene, row, col, cloud, shadow FROM g1 WHERE cloud OR shadow"""


@query("A35_cloud_mask", with_tables("scene_px", CLOUDS))
def cloud_mask(spark, sf_dir):
    """At ten metres a pixel."""
    return imagery.cloud_mask(domain.scene_px(spark, sf_dir), 10.0).where("cloud or shadow")


@query("A36_colour_clusters")
def colour_clusters(spark, sf_dir):
    """Clusters of each scene on its own, the largest first."""
    px = imagery.kmeans(domain.ortho_px(spark, sf_dir), ["scene"], ["r", "g", "b"], 4)
    return px.groupBy("scene", "cluster").agg(F.count("*").alias("n"), *[r(F.avg(k)).alias(k) for k in "rgb"])


def chromatic(px):
    total = c("r") + c("g") + c("b") + 1e-6
    return px.withColumn("x", c("r") / total).withColumn("y", c("g") / total)


def medians(px, keys):
    out = px.groupBy(*keys).agg(F.count("*").alias("n"))
    for k in "rgb":
        out = out.join(exact_quantiles(px, keys, k, {k: 0.5}), keys)
    return out.select(*keys, "n", *[r(c(k)).alias(k) for k in "rgb"])


@query("A37_chromaticity_clusters")
def chromaticity_clusters(spark, sf_dir):
    """Clusters of colour shares, so that shade does not matter; median colour of each, scene by scene, the largest first."""
    return medians(imagery.kmeans(chromatic(domain.ortho_px(spark, sf_dir)), ["scene"], ["x", "y"], 3), ["scene", "cluster"])


def palette_candidates(spark, sf_dir):
    """Pixels that may show a wall (valid ones below the top quarter) or a roof (where a building stands as well)."""
    px = domain.ortho_px(spark, sf_dir).where("valid")
    high = domain.texels(spark, sf_dir).select("row", "col", (c("build_h") > 0).alias("built"))
    top = px.agg((F.floor((F.max("row") + 1) / 4)).alias("quarter"))  # one row
    rows = px.join(high, ["row", "col"]).crossJoin(F.broadcast(top))
    wall = raster.wall_candidate(c("r"), c("g"), c("b")) & (c("row") >= c("quarter"))
    return rows.withColumn("wall", wall).withColumn("roof", raster.roof_candidate(c("r"), c("g"), c("b")) | c("built"))


@query("A38_palette", with_tables("ortho_px", f""", q AS (SELECT (max(row) + 1) // 4 AS quarter FROM ortho_px WHERE valid),
k AS (SELECT o.scene, row >= quarter AND {WALL} AS wall, {ROOF} OR t.build_h > 0 AS roof FROM ortho_px o JOIN texels t USING (row, col) CROSS JOIN q WHERE o.valid)
SELECT scene, count(*) FILTER (wall) AS wall_px, count(*) FILTER (roof) AS roof_px, count(*) FILTER (wall) >= 400 AS wall_measured, count(*) FILTER (roof) >= 400 AS roof_measured FROM k GROUP BY scene"""))  # fmt: skip
def palette(spark, sf_dir):
    """Which colours of each scene are measured: those with 400 candidate pixels; the others are the defaults."""
    n = palette_candidates(spark, sf_dir).groupBy("scene").agg(F.count_if("wall").alias("wall_px"), F.count_if("roof").alias("roof_px"))
    return n.withColumn("wall_measured", c("wall_px") >= 400).withColumn("roof_measured", c("roof_px") >= 400)


@query("A38_palette_colours")
def palette_colours(spark, sf_dir):
    """Three wall and three roof colours of each scene, the most frequent first: clusters of colour and of colour shares,
    or the defaults where too few pixels are candidates."""
    px = written(palette_candidates(spark, sf_dir))
    known = px.groupBy("scene").agg(*[(F.count_if(k) >= 400).alias(f"{k}_known") for k in ("wall", "roof")])  # a row per scene
    own = px.join(F.broadcast(known), "scene")
    walls = imagery.kmeans(own.where("wall and wall_known"), ["scene"], ["r", "g", "b"], 3)
    walls = walls.groupBy("scene", "cluster").agg(F.count("*").alias("n"), *[r(F.avg(x)).alias(x) for x in "rgb"])
    roofs = medians(imagery.kmeans(chromatic(own.where("roof and roof_known")), ["scene"], ["x", "y"], 3), ["scene", "cluster"])
    found = walls.withColumn("kind", F.lit("wall")).unionByName(roofs.withColumn("kind", F.lit("roof")))
    defaults = [(kind, k, *v) for kind, colours in (("wall", raster.DEFAULT_WALLS), ("roof", raster.DEFAULT_ROOFS)) for k, v in enumerate(colours)]
    fixed = F.broadcast(spark.createDataFrame(defaults, "kind string, cluster int, r double, g double, b double"))
    rest = known.crossJoin(fixed).where(((c("kind") == "wall") & ~c("wall_known")) | ((c("kind") == "roof") & ~c("roof_known"))).drop("wall_known", "roof_known")
    return found.unionByName(rest.withColumn("n", F.lit(None).cast("long"))).withColumnRenamed("cluster", "rank")


ROOFS = f""", s1 AS (SELECT *, {_blurred("gray", "col", 1.0)} AS v1 FROM scene_px), s2 AS (SELECT *, {_blurred("v1", "row", 1.0)} AS smooth FROM s1),
{_boxes("s2", "smooth", 7, "local")}, aw AS (SELECT *, abs(smooth - local) AS away FROM local_t), {_boxes("aw", "away", 7, "mad")},
raw AS (SELECT scene, row, col, round(smooth - local - greatest(0.06::DOUBLE, 2.5::DOUBLE * mad), 9) > 0 AND valid AS roof FROM mad_t), {_closed("raw", "roof", "k0")}, {_opened("k0", "roof", "k1")}
SELECT scene, row, col FROM k1 WHERE roof"""


@query("A47_roof_mask", with_tables("scene_px", ROOFS))
def roof_mask(spark, sf_dir):
    """At ten metres a pixel."""
    return imagery.roof_mask(domain.scene_px(spark, sf_dir), 10.0).where("roof").select("scene", "row", "col")


def flow(spark, sf_dir):
    """Matched ground points of frame pairs: turned by ten degrees and shifted, with a few outliers."""
    s, k = math.sin(math.radians(10)), math.cos(math.radians(10))
    f = domain.captures(spark, sf_dir).select(c("run").alias("pair"), "id", (c("e") / 10).alias("x"), (c("n") / 10).alias("y"))
    wrong = F.when(c("id") % 19 == 0, 60.0).otherwise(0.0)
    return f.withColumn("u", c("x") * k - c("y") * s + 3 + wrong).withColumn("v", c("x") * s + c("y") * k - 2)


@query("A48_rigid_fit", with_tables("captures", f""", f AS (SELECT run AS pair, e / 10 AS x, n / 10 AS y, e / 10 * {math.cos(math.radians(10))!r}::DOUBLE - n / 10 * {math.sin(math.radians(10))!r}::DOUBLE + 3 AS u, e / 10 * {math.sin(math.radians(10))!r}::DOUBLE + n / 10 * {math.cos(math.radians(10))!r}::DOUBLE - 2 AS v FROM captures WHERE id % 19 <> 0),
m AS (SELECT pair, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM f GROUP BY pair),
t AS (SELECT pair, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, atan2(sum((x - mx) * (v - mv) - (y - my) * (u - mu)), sum((x - mx) * (u - mu) + (y - my) * (v - mv))) AS turn FROM f JOIN m USING (pair) GROUP BY pair)
SELECT pair, round(degrees(turn), 4) AS turn_deg, round(mu - (mx * cos(turn) - my * sin(turn)), 4) AS de, round(mv - (mx * sin(turn) + my * cos(turn)), 4) AS dn FROM t"""))  # fmt: skip
def rigid_fit(spark, sf_dir):
    """The outliers are gone after the trims, so the fit is that of the other points."""
    fit = imagery.rigid_fit(flow(spark, sf_dir))
    return fit.select("pair", *[(F.round(c(k), 4) + 0.0).alias(k) for k in ("turn_deg", "de", "dn")])


@query("A49_yaw_fit", with_tables("captures", """, d AS (SELECT run AS pair, (id * 13 % 7) / 10.0::DOUBLE + CASE WHEN id % 23 = 0 THEN 40 ELSE 5 END AS d FROM captures), m AS (SELECT pair, median(d) AS mid FROM d GROUP BY pair),
a AS (SELECT pair, any_value(mid) AS mid, median(abs(d - mid)) AS mad FROM d JOIN m USING (pair) GROUP BY pair) SELECT pair, round(any_value(mid), 4) AS turn, count(*) AS inliers FROM d JOIN a USING (pair) WHERE abs(d - mid) <= 3 * mad + 1e-6 GROUP BY pair HAVING count(*) >= 8"""))  # fmt: skip
def yaw_fit(spark, sf_dir):
    """Median of azimuth differences and the differences near it."""
    d = domain.captures(spark, sf_dir).select(c("run").alias("pair"), ((c("id") * 13 % 7) / 10.0 + F.when(c("id") % 23 == 0, 40).otherwise(5)).alias("d"))
    mid = d.groupBy("pair").agg(F.median("d").alias("mid"))
    mad = d.join(mid, "pair").groupBy("pair").agg(F.first("mid").alias("mid"), F.median(F.abs(c("d") - c("mid"))).alias("mad"))
    near = d.join(mad, "pair").where(F.abs(c("d") - c("mid")) <= 3 * c("mad") + 1e-6)
    return near.groupBy("pair").agg(r(F.first("mid")).alias("turn"), F.count("*").alias("inliers")).where("inliers >= 8")


@query("A59_horizon", with_tables("view_px", ", s AS (SELECT view_id, c, max(r) FILTER (depth = 'Infinity'::DOUBLE) AS last FROM view_px GROUP BY view_id, c) SELECT view_id, median(last) AS horizon, round(degrees(atan((24 - median(last)) / 60)), 4) AS pitch_down FROM s GROUP BY view_id"))
def horizon(spark, sf_dir):
    """Last sky row of each column, their median, and the camera's pitch that puts it there (focal length 60)."""
    last = domain.view_px(spark, sf_dir).groupBy("view_id", "c").agg(F.max(F.when(c("depth") == float("inf"), c("r"))).alias("last"))
    h = last.groupBy("view_id").agg(F.median("last").alias("horizon"))
    return h.select("view_id", "horizon", r(F.degrees(F.atan((24 - c("horizon")) / 60))).alias("pitch_down"))


def photo_px(spark, sf_dir):
    """Photos of 48 x 64 pixels from the views: smooth sky above roofs of different height, windows that mirror it, trees,
    and water at the foot."""
    v = domain.view_px(spark, sf_dir).select(c("view_id").cast("long").alias("photo"), c("r").cast("long").alias("row"), c("c").cast("long").alias("col"), "water", "vegetation", F.expr("((r * 73856093) ^ (c * 19349663)) & 15").alias("h"))
    look = F.expr("CASE WHEN row < 8 + (col div 8 * 5 + photo) % 9 THEN 1 WHEN row BETWEEN 24 AND 29 AND col % 16 BETWEEN 4 AND 11 THEN 1 WHEN row >= 38 THEN 2 WHEN col % 16 < 5 OR vegetation THEN 3 ELSE 4 END")
    v = v.withColumn("look", look)
    shade = lambda *of: F.element_at(F.array(*[F.lit(x) for x in of]), c("look")) + c("h") / 4000.0
    return v.select("photo", "row", "col", shade(0.55, 0.3, 0.2, 0.5).alias("r"), shade(0.7, 0.35, 0.5, 0.4).alias("g"), shade(0.9, 0.5, 0.2, 0.35).alias("b"))


PHOTOS = """, v AS (SELECT view_id::BIGINT AS photo, r::BIGINT AS row, c::BIGINT AS col, xor(r * 73856093, c * 19349663) & 15 AS h, vegetation FROM view_px),
w AS (SELECT *, CASE WHEN row < 8 + (col // 8 * 5 + photo) % 9 THEN 1 WHEN row BETWEEN 24 AND 29 AND col % 16 BETWEEN 4 AND 11 THEN 1 WHEN row >= 38 THEN 2 WHEN col % 16 < 5 OR vegetation THEN 3 ELSE 4 END AS look FROM v),
p AS (SELECT photo, row, col, ([0.55, 0.3, 0.2, 0.5]::DOUBLE[])[look] + h / 4000.0::DOUBLE AS r, ([0.7, 0.35, 0.5, 0.4]::DOUBLE[])[look] + h / 4000.0::DOUBLE AS g, ([0.9, 0.5, 0.2, 0.35]::DOUBLE[])[look] + h / 4000.0::DOUBLE AS b FROM w),
y AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray FROM p),
n AS (SELECT a.*, round(coalesce(abs(e.gray - f.gray), 0) + coalesce(abs(u.gray - d.gray), 0), 9) AS grad FROM y a LEFT JOIN y e ON e.photo = a.photo AND e.row = a.row AND e.col = a.col - 1 LEFT JOIN y f ON f.photo = a.photo AND f.row = a.row AND f.col = a.col + 1
  LEFT JOIN y u ON u.photo = a.photo AND u.row = a.row - 1 AND u.col = a.col LEFT JOIN y d ON d.photo = a.photo AND d.row = a.row + 1 AND d.col = a.col),
o AS (SELECT photo, row, col FROM n WHERE grad < 0.08 AND (greatest(r, g, b) > 0.45 OR (b > r AND b > g AND greatest(r, g, b) > 0.3))),
sky(photo, row, col) AS (SELECT photo, row, col FROM o WHERE row = 0 UNION SELECT o.photo, o.row, o.col FROM sky s JOIN o ON o.photo = s.photo AND abs(o.row - s.row) + abs(o.col - s.col) = 1),
k AS (SELECT n.*, s.row IS NOT NULL AS sky FROM n LEFT JOIN sky s USING (photo, row, col)),
hz AS (SELECT photo, floor(median(last)) AS horizon FROM (SELECT photo, col, coalesce(max(row) FILTER (sky), 0) AS last FROM k GROUP BY photo, col) GROUP BY photo),
lf AS (SELECT k.*, horizon, NOT sky AND g > r * 1.04::DOUBLE AND g > b * 1.04::DOUBLE AND g > 0.12 AS leaf FROM k JOIN hz USING (photo)),
sm AS (SELECT photo, row // 4 AS row, col // 4 AS col, avg(sky::INT) AS sky, avg(leaf::INT) AS leaf, avg((NOT sky AND NOT leaf AND b >= r * 0.95::DOUBLE AND grad < 0.06 AND lf.row > horizon)::INT) AS wet FROM lf GROUP BY photo, lf.row // 4, lf.col // 4)
"""


@query("A60_pixel_classes", recursive(with_tables("view_px", PHOTOS + "SELECT photo, row, col, CASE WHEN sky > 0.5 THEN 'sky' WHEN leaf > 0.35 THEN 'vegetation' WHEN wet > 0.35 THEN 'water' ELSE 'building' END AS class FROM sm")))
def pixel_classes(spark, sf_dir):
    """Classes of blocks of four by four pixels by their colours."""
    return photos.pixel_classes(photo_px(spark, sf_dir), 4)


@query("F43_image_filter", with_tables("ortho_px", SLOPES + """SELECT scene, row, col, round(least(1, sqrt(dx * dx + dy * dy)), 4) AS edge, round(CAST(0.5 AS DOUBLE) * gray + CAST(0.5 AS DOUBLE) * least(1, sqrt(dx * dx + dy * dy)), 4) AS gray_edge FROM g"""))
def image_filter(spark, sf_dir):
    """Edge strength, and half of it with half of the gray value: the filter's modes as columns."""
    edge = F.least(F.lit(1.0), F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")))
    return slopes(spark, sf_dir).select("scene", "row", "col", r(edge).alias("edge"), r(0.5 * c("gray") + 0.5 * edge).alias("gray_edge"))


#: What a model says of the images that it takes: shares of gray value and edge strength.
FILTERS = [("grayscale", 1.0, 0.0), ("edges", 0.0, 1.0), ("gray_edges", 0.5, 0.5)]


@query("X08_filter_spec", with_tables("ortho_px", SLOPES + f"""SELECT m.mode, scene, count(*) AS n, round(avg(m.a * gray + m.b * least(1, sqrt(dx * dx + dy * dy))), 4) AS mean, round(max(m.a * gray + m.b * least(1, sqrt(dx * dx + dy * dy))), 4) AS top
FROM g CROSS JOIN (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in FILTERS)}) m(mode, a, b) GROUP BY m.mode, scene"""))
def filter_spec(spark, sf_dir):
    """Images filtered as the specification says that each model carries with it: a table of its own, read with the model."""
    from skylattice.plans.ingestion import table_path

    path = table_path(spark, "models")
    spark.createDataFrame(FILTERS, "mode string, a double, b double").write.json(path)
    spec = spark.read.schema("mode string, a double, b double").json(path)
    edge = F.least(F.lit(1.0), F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")))
    value = c("a") * c("gray") + c("b") * c("edge")
    rows = slopes(spark, sf_dir).withColumn("edge", edge).crossJoin(F.broadcast(spec))  # a row per model
    return rows.groupBy("mode", "scene").agg(F.count("*").alias("n"), r(F.avg(value)).alias("mean"), r(F.max(value)).alias("top"))


@query("X01_embed_batches", with_tables("landmarks", "SELECT id, round(list_sum(embedding), 3) AS total, round(embedding[1] * 2, 4) AS first FROM landmarks"))
def embed_batches(spark, sf_dir):
    """A caller's model over vectors in batches of 64; here a projection to two numbers."""
    import numpy as np

    weights = np.stack([np.ones(64), np.eye(64)[0] * 2], axis=1)
    out = imagery.batched(domain.landmarks(spark, sf_dir), lambda x: x @ weights, "id long, out array<double>", "embedding")
    return out.select("id", r(c("out")[0], 3).alias("total"), r(c("out")[1]).alias("first"))


@query("X02_predict_batches", with_tables("landmarks", "SELECT id, round(embedding[1] * 1000, 3) AS e, round(embedding[2] * 1000, 3) AS n, round(50 + embedding[3] * 10, 3) AS u, round((degrees(atan2(embedding[4], embedding[5])) + 360) % 360, 3) AS heading, round(exp(embedding[6]), 4) AS sigma FROM landmarks"))
def predict_batches(spark, sf_dir):
    """A caller's regression head in batches: position, heading by sine and cosine, and a positive sigma by its logarithm."""
    import numpy as np

    def head(x):
        return np.stack([x[:, 0] * 1000, x[:, 1] * 1000, 50 + x[:, 2] * 10, np.degrees(np.arctan2(x[:, 3], x[:, 4])) % 360, np.exp(x[:, 5])], axis=1)

    out = imagery.batched(domain.landmarks(spark, sf_dir).withColumn("embedding", c("embedding").cast("array<double>")), head, "id long, out array<double>", "embedding")
    return out.select("id", *[r(c("out")[k], 4 if name == "sigma" else 3).alias(name) for k, name in enumerate(("e", "n", "u", "heading", "sigma"))])


@query("X03_mask_hook", with_tables("ortho_px", ", t AS (SELECT *, avg(gray) OVER (PARTITION BY scene, row // 32, col // 32) AS mean FROM ortho_px) SELECT scene, row, col FROM t WHERE round(gray - mean, 9) > 0"))
def mask_hook(spark, sf_dir):
    """A caller's segmentation of tiles; here what is brighter than its tile."""
    import numpy as np

    px = domain.ortho_px(spark, sf_dir)
    out = imagery.tiles_through(px, lambda image: np.round(image - image[image > 0].mean(), 9) > 0, "prob", 32, 0, 0)
    return out.where("prob > 0").select("scene", "row", "col")


def smooth_depth(image):
    """Stands in for a depth model: the mean of five by five pixels, with zeros beyond the edge."""
    wide = np.pad(image, 2)
    return sum(wide[a : a + image.shape[0], b : b + image.shape[1]] for a in range(5) for b in range(5)) / 25


@query("X04_depth_hook", with_tables("ortho_px", """, near AS (SELECT scene, row - dr AS row, col - dc AS col, gray FROM ortho_px, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)),
m AS (SELECT scene, row, col, sum(gray) / 25 AS depth FROM near GROUP BY scene, row, col)
SELECT p.scene, p.row, p.col, round(depth, 4) AS depth FROM ortho_px p JOIN m USING (scene, row, col)"""))  # fmt: skip
def depth_hook(spark, sf_dir):
    """A caller's model over tiles with a halo, blended where they overlap."""
    out = imagery.tiles_through(domain.ortho_px(spark, sf_dir), smooth_depth, "depth", 32)
    return out.select("scene", "row", "col", r(c("depth")).alias("depth"))

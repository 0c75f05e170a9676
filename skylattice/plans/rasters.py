"""Queries of raster algebra: grids, sampling, burning, windows, terrain, saliency, vegetation, imagery."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import features, geo, raster
from skylattice.operators import ingest, polygons, rasters, vectors
from skylattice.operators.quantiles import exact_quantiles, with_quantiles
from skylattice.plans.base import r
from skylattice.plans.ingestion import table_path
from skylattice.plans.scalars import LAT0, LON0
from skylattice.registry import query
from skylattice.sources import domain
from skylattice.sources.domain import with_tables

c = lambda name: F.col(name)
HASH = "((xor(row * 73856093, col * 19349663) & 65535) / CAST(65535 AS DOUBLE))"


@query("G09_texel_grid", with_tables("texels", "SELECT row, col, round(col * CAST(2.5 AS DOUBLE) + CAST(1.25 AS DOUBLE), 3) AS e, round(row * CAST(2.5 AS DOUBLE) + CAST(1.25 AS DOUBLE), 3) AS n FROM (SELECT DISTINCT row FROM texels) CROSS JOIN range(120) t(col)"))
def texel_grid(spark, sf_dir):
    """All texels of the extent of the rows at hand, with their centres."""
    rows = domain.texels(spark, sf_dir).select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(119).cast("long"))))
    return rows.select("row", "col", r((c("col") + 0.5) * 2.5, 3).alias("e"), r((c("row") + 0.5) * 2.5, 3).alias("n"))


for name in ("S14_texel_store", "K03_texel_store_write"):

    @query(name, with_tables("texels", "SELECT row // 64 AS block, count(*) AS n, round(sum(build_h), 3) AS built FROM texels GROUP BY 1"))
    def texel_store(spark, sf_dir):
        """The texel table, partitioned by blocks of rows, and read back."""
        from skylattice.plans.ingestion import table_path

        path = table_path(spark, "texels")
        domain.texels(spark, sf_dir).withColumn("block", F.floor(c("row") / 64)).repartition("block").write.partitionBy("block").parquet(path)
        return spark.read.parquet(path).groupBy(c("block").cast("long").alias("block")).agg(F.count("*").alias("n"), r(F.sum("build_h"), 3).alias("built"))


POINTS = """, p AS (SELECT s_suppkey AS id, s_suppkey * 7919 % 1180 / CAST(10 AS DOUBLE) AS x, s_suppkey * 104729 % 110 / CAST(10 AS DOUBLE) AS y FROM supplier)
"""


def points(spark, sf_dir):
    return domain.raw(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey * 7919 % 1180 / 10D AS x", "s_suppkey * 104729 % 110 / 10D AS y")


NEAR = """, o AS (SELECT p.id, t.ground, abs(1 - a - (y - floor(y))) * abs(1 - b - (x - floor(x))) AS w FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b)
  JOIN texels t ON t.row = CAST(floor(y) AS BIGINT) + a AND t.col = CAST(floor(x) AS BIGINT) + b{only})
"""


@query("J08_bilinear", with_tables("texels", POINTS + NEAR.format(only="") + "SELECT id, round(sum(w * ground) / sum(w), 6) AS ground FROM o GROUP BY id"))
def bilinear_ground(spark, sf_dir):
    return rasters.bilinear(points(spark, sf_dir), domain.texels(spark, sf_dir), "ground").select("id", r(c("ground"), 6).alias("ground"))


@query("S11_dem_sample", with_tables("texels", POINTS + NEAR.format(only=" AND t.col // 40 <> 1") + "SELECT p.id, round(coalesce(sum(w * ground) / nullif(sum(w), 0), 0), 6) AS ground FROM p LEFT JOIN o USING (id) GROUP BY p.id"))
def dem_sample(spark, sf_dir):
    """Elevation from tiles of 40 columns, one of which is not there: a place on a missing tile is at 0 m."""
    held, p = domain.texels(spark, sf_dir).where("col div 40 <> 1"), points(spark, sf_dir)
    found = rasters.bilinear(p, held, "ground")
    return p.select("id").join(found, "id", "left").select("id", r(F.coalesce("ground", F.lit(0.0)), 6).alias("ground"))


SHAPES = """, shapes AS (SELECT p_partkey AS seq, p_partkey * 7919 % 125 AS r0, p_partkey * 104729 % 110 AS c0, p_partkey * 7919 % 125 + p_size % 7 AS r1, p_partkey * 104729 % 110 + p_size % 9 AS c1, CAST(p_size AS DOUBLE) AS h FROM part),
burnt AS (SELECT t.row, t.col, arg_max(s.h, s.seq) AS h, max(s.seq) AS seq FROM texels t JOIN shapes s ON t.row BETWEEN r0 AND r1 AND t.col BETWEEN c0 AND c1
  AND (t.row - (r0 + r1) / CAST(2 AS DOUBLE)) ** 2 + (t.col - (c0 + c1) / CAST(2 AS DOUBLE)) ** 2 >= CASE WHEN s.seq % 4 = 0 THEN 2 ELSE 0 END GROUP BY t.row, t.col)
"""


def burnt(spark, sf_dir):
    """Building rectangles, every fourth with a court in the middle, burnt in list order."""
    s = domain.raw(spark, sf_dir, "part").selectExpr(
        "p_partkey AS seq", "p_partkey * 7919 % 125 AS r0", "p_partkey * 104729 % 110 AS c0", "p_partkey * 7919 % 125 + p_size % 7 AS r1", "p_partkey * 104729 % 110 + p_size % 9 AS c1", "CAST(p_size AS DOUBLE) AS h"
    )
    away = F.pow(c("row") - (c("r0") + c("r1")) / 2, 2) + F.pow(c("col") - (c("c0") + c("c1")) / 2, 2)
    inside = away >= F.when(c("seq") % 4 == 0, 2).otherwise(0)
    return rasters.burn(domain.texels(spark, sf_dir).select("row", "col"), s, inside, "seq", ["h", "seq"])


def footprint_elements(spark, sf_dir, tag):
    """Map elements with footprints of four kinds on the texel grid: with a court, concave, slanted, and concave with a
    slanted court; those with a court are relations, the others ways. ``tag`` is their kind."""
    place = lambda p: F.struct((p["y"] * RES / geo.METRES_PER_DEGREE + LAT0).alias("lat"), (p["x"] * RES / (geo.METRES_PER_DEGREE * math.cos(math.radians(LAT0))) + LON0).alias("lon"))
    ring = lambda points: F.transform(F.array(*[F.struct((c("x0") + c("w") * x).alias("x"), (c("y0") + c("v") * y).alias("y")) for x, y in points]), place)
    of_kind = lambda rings: F.element_at(F.array(*[ring(p) for p in rings]), c("kind") + 1)
    s = domain.raw(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CAST(p_partkey % 4 AS INT) AS kind", "p_partkey * 104729 % 105 + 0.137D AS x0", "p_partkey * 7919 % 120 + 0.291D AS y0", "4.0D + p_size % 9 AS w", "4.0D + p_size % 7 AS v",
        "map_from_arrays(array('" + tag + "', 'height'), array('house', CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS STRING) ELSE 'x' END)) AS tags",
    )
    outer, hole = of_kind(OUTER), of_kind([h or [(0, 0)] for h in HOLE])
    member = lambda role, r: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), r.alias("geometry"))
    way = (c("kind") % 3 != 0) | F.lit(tag != "building")
    el = F.struct(F.when(way, "way").otherwise("relation").alias("type"), "id", "tags", F.when(way, outer).alias("geometry"), F.when(~way, F.array(member("outer", outer), member("inner", hole))).alias("members"))
    path = table_path(spark, "footprints")
    s.select(F.array(el).alias("elements")).write.json(path)
    return vectors.read_elements(spark, path)


#: Corners of each kind's outer ring and court, in shares of its width and height.
OUTER = [
    [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0, 0), (1, 0), (1, 0.4), (0.45, 0.4), (0.45, 1), (0, 1), (0, 0)], [(0.5, 0), (1, 0.45), (0.55, 1), (0, 0.6), (0.5, 0)],
    [(0, 0), (1, 0), (1, 1), (0.8, 1), (0.7, 0.55), (0.3, 0.6), (0.2, 1), (0, 1), (0, 0)],
]
HOLE = [[(0.3, 0.3), (0.7, 0.3), (0.7, 0.7), (0.3, 0.7), (0.3, 0.3)], None, None, [(0.3, 0.1), (0.8, 0.15), (0.5, 0.45), (0.3, 0.1)]]
RES = 2.5
_EDGES = ", ".join(f"({k}, {hole}, {ax}, {ay}, {bx}, {by})" for k in range(4) for hole, ring in ((0, OUTER[k]), (1, HOLE[k] or [])) for (ax, ay), (bx, by) in zip(ring, ring[1:]))
POLYGONS = f""", shape AS (SELECT p_partkey AS seq, p_partkey % 4 AS kind, p_partkey * 104729 % 105 + 0.137::DOUBLE AS x0, p_partkey * 7919 % 120 + 0.291::DOUBLE AS y0, 4.0::DOUBLE + p_size % 9 AS w, 4.0::DOUBLE + p_size % 7 AS v, CASE WHEN p_size % 3 <> 0 THEN p_size::DOUBLE END AS tagged FROM part),
edge AS (SELECT * FROM (VALUES {_EDGES}) e(kind, hole, px, py, qx, qy)),
inside AS (
  SELECT t.row, t.col, s.seq, s.tagged FROM texels t JOIN shape s ON t.row + 0.5 BETWEEN y0 AND y0 + v AND t.col + 0.5 BETWEEN x0 AND x0 + w
  JOIN edge e ON e.kind = s.kind AND (t.row + 0.5::DOUBLE >= y0 + v * py::DOUBLE) <> (t.row + 0.5::DOUBLE >= y0 + v * qy::DOUBLE)
    AND x0 + w * px::DOUBLE + (t.row + 0.5::DOUBLE - y0 - v * py::DOUBLE) * (w * (qx::DOUBLE - px::DOUBLE)) / (v * (qy::DOUBLE - py::DOUBLE)) <= t.col + 0.5::DOUBLE
  WHERE {{holes}} GROUP BY t.row, t.col, s.seq, s.tagged HAVING count(*) % 2 = 1
),
top AS (SELECT row, col, max(seq) AS seq, arg_max(coalesce(tagged, -1), seq) AS tagged FROM inside GROUP BY row, col)
"""


@query("J05_polygon_burn", with_tables("texels", POLYGONS.format(holes="true") + "SELECT t.row, t.col, b.seq, greatest(t.build_h, CASE WHEN tagged < 0 THEN 7 ELSE tagged END) AS h, 11 AS class_id FROM top b JOIN texels t USING (row, col)"))
def polygon_burn(spark, sf_dir):
    """Parsed footprints with courts: the last one wins among themselves and sets the class; heights are the taller of
    it and what was there before."""
    b = vectors.parse_buildings(footprint_elements(spark, sf_dir, "building"))
    shapes = b.select(
        c("osm_id").alias("seq"), polygons.to_texels(F.concat(F.array("ring"), "holes"), LON0, LAT0, RES).alias("rings"), vectors.burn_height(c("height_m"), c("cls")).alias("h"),
        features.lookup(c("cls"), features.CLASS_IDS, 10).alias("class_id"),
    )
    t = domain.texels(spark, sf_dir).select("row", "col", "build_h")
    found = polygons.burn_polygons(t, shapes, "seq", ["seq", "h", "class_id"])
    return found.join(t, ["row", "col"]).select("row", "col", "seq", F.greatest("build_h", "h").alias("h"), "class_id")


@query("J30_part_stamp", with_tables("texels", POLYGONS.format(holes="hole = 0") + "SELECT t.row, t.col, b.seq, CASE WHEN tagged = 0 THEN t.build_h ELSE greatest(t.build_h, CASE WHEN tagged < 0 THEN 6 ELSE tagged END) END AS h FROM top b JOIN texels t USING (row, col) WHERE tagged <> 0"))
def part_stamp(spark, sf_dir):
    """Parts of buildings set their own height (6 m where none is tagged, 400 m at most) where that is more than what is there."""
    p = vectors.parse_parts(footprint_elements(spark, sf_dir, "building:part"))
    shapes = p.select(c("id").alias("seq"), polygons.to_texels(F.array("ring"), LON0, LAT0, RES).alias("rings"), F.least("height_m", F.lit(400.0)).alias("h"))
    t = domain.texels(spark, sf_dir).select("row", "col", "build_h")
    found = polygons.burn_polygons(t, shapes, "seq", ["seq", "h"]).where("h > 0")
    return found.join(t, ["row", "col"]).select("row", "col", "seq", F.greatest("build_h", "h").alias("h"))


LINES = """, lines AS (SELECT s_suppkey AS seq, CAST(s_suppkey * 7919 % 100 AS DOUBLE) AS x0, CAST(s_suppkey * 104729 % 120 AS DOUBLE) AS y0, CAST(s_suppkey * 7919 % 100 + s_suppkey % 23 AS DOUBLE) AS x1, CAST(s_suppkey * 104729 % 120 + s_suppkey % 19 + 1 AS DOUBLE) AS y1 FROM supplier),
near AS (SELECT t.row, t.col, seq, greatest(0, least(1, ((t.col - x0) * (x1 - x0) + (t.row - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS k, x0, y0, x1, y1 FROM lines
  JOIN texels t ON t.col BETWEEN least(x0, x1) - 2 AND greatest(x0, x1) + 2 AND t.row BETWEEN least(y0, y1) - 2 AND greatest(y0, y1) + 2),
road AS (SELECT row, col, max(seq) AS seq FROM near WHERE round((col - x0 - k * (x1 - x0)) ** 2 + (row - y0 - k * (y1 - y0)) ** 2, 6) <= CAST(2.25 AS DOUBLE) GROUP BY row, col)
"""


def roads(spark, sf_dir):
    s = domain.raw(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS seq", "CAST(s_suppkey * 7919 % 100 AS DOUBLE) AS x0", "CAST(s_suppkey * 104729 % 120 AS DOUBLE) AS y0", "CAST(s_suppkey * 7919 % 100 + s_suppkey % 23 AS DOUBLE) AS x1", "CAST(s_suppkey * 104729 % 120 + s_suppkey % 19 + 1 AS DOUBLE) AS y1"
    )
    s = s.withColumn("r0", F.least("y0", "y1").cast("long") - 2).withColumn("r1", F.greatest("y0", "y1").cast("long") + 2).withColumn("c0", F.least("x0", "x1").cast("long") - 2).withColumn("c1", F.greatest("x0", "x1").cast("long") + 2)
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("col") - c("x0")) * dx + (c("row") - c("y0")) * dy) / (dx * dx + dy * dy)))
    away = F.pow(c("col") - c("x0") - k * dx, 2) + F.pow(c("row") - c("y0") - k * dy, 2)
    return rasters.burn(domain.texels(spark, sf_dir).select("row", "col"), s, F.round(away, 6) <= 2.25, "seq", ["seq"])


@query("J06_line_burn", with_tables("texels", LINES + "SELECT row, col, seq FROM road"))
def line_burn(spark, sf_dir):
    """Texels within 1.5 of a segment."""
    return roads(spark, sf_dir)


@query(
    "J26_bridge_deck",
    with_tables("texels", LINES + """, e AS (SELECT l.seq, a.ground AS g0, b.ground AS g1 FROM lines l JOIN texels a ON a.row = l.y0 AND a.col = l.x0 JOIN texels b ON b.row = l.y1 AND b.col = l.x1)
SELECT r.row, r.col, round(greatest(t.ground, least(e.g0, e.g1) + CAST(0.5 AS DOUBLE)), 3) AS deck FROM road r JOIN e USING (seq) JOIN texels t ON t.row = r.row AND t.col = r.col"""),
)
def bridge_deck(spark, sf_dir):
    """Decks half a metre above the lower of their ends, where that is above the ground."""
    t = domain.texels(spark, sf_dir).select("row", "col", "ground")
    s = domain.raw(spark, sf_dir, "supplier").selectExpr("s_suppkey AS seq", "s_suppkey * 7919 % 100 AS x0", "s_suppkey * 104729 % 120 AS y0", "s_suppkey * 7919 % 100 + s_suppkey % 23 AS x1", "s_suppkey * 104729 % 120 + s_suppkey % 19 + 1 AS y1")
    end = lambda k: t.select(c("row").alias(f"y{k}"), c("col").alias(f"x{k}"), c("ground").alias(f"g{k}"))
    ends = s.join(end(0), ["y0", "x0"]).join(end(1), ["y1", "x1"]).select("seq", "g0", "g1")
    return roads(spark, sf_dir).join(ends, "seq").join(t, ["row", "col"]).select("row", "col", r(F.greatest("ground", F.least("g0", "g1") + 0.5), 3).alias("deck"))


@query("J07_drape", with_tables("ortho_px", "SELECT t.row, t.col, round(o.gray, 4) AS gray FROM texels t JOIN ortho_px o ON o.scene = 0 AND o.row = t.row // 2 AND o.col = t.col // 2 WHERE o.valid"))
def drape(spark, sf_dir):
    """Nearest sample of an orthophoto of half the resolution."""
    o = domain.ortho_px(spark, sf_dir).where("scene = 0 and valid").select(c("row").alias("orow"), c("col").alias("ocol"), "gray")
    t = domain.texels(spark, sf_dir).select("row", "col", F.floor((c("row") + 0.5) / 2).alias("orow"), F.floor((c("col") + 0.5) / 2).alias("ocol"))
    return t.join(o, ["orow", "ocol"]).select("row", "col", r(c("gray")).alias("gray"))


@query("A39_drape_coverage", with_tables("ortho_px", "SELECT round(avg(CASE WHEN o.valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS covered FROM texels t LEFT JOIN ortho_px o ON o.scene = 0 AND o.row = t.row // 2 AND o.col = t.col // 2"))
def drape_coverage(spark, sf_dir):
    o = domain.ortho_px(spark, sf_dir).where("scene = 0").select(c("row").alias("orow"), c("col").alias("ocol"), "valid")
    t = domain.texels(spark, sf_dir).select(F.floor((c("row") + 0.5) / 2).alias("orow"), F.floor((c("col") + 0.5) / 2).alias("ocol"))
    return t.join(o, ["orow", "ocol"], "left").agg(r(F.avg(F.coalesce("valid", F.lit(False)).cast("double"))).alias("covered"))


@query("P07_usable_texels", with_tables("ortho_px", "SELECT scene, count(*) AS n FROM ortho_px WHERE valid GROUP BY scene"))
def usable_texels(spark, sf_dir):
    return domain.ortho_px(spark, sf_dir).where("valid").groupBy("scene").agg(F.count("*").alias("n"))


TERRAIN = """, terrain AS (SELECT CAST(floor(e / 60) AS BIGINT) AS ce, CAST(floor(n / 60) AS BIGINT) AS cn, median(ground_up) AS up FROM captures GROUP BY 1, 2)
"""


def terrain(spark, sf_dir):
    caps = domain.captures(spark, sf_dir)
    ce, cn = geo.plane_cell(c("e"), c("n"), 60.0)
    return caps.groupBy(ce.alias("ce"), cn.alias("cn")).agg(F.median("ground_up").alias("up"))


@query("A09_terrain_prior", with_tables("captures", TERRAIN + "SELECT ce, cn, round(up, 4) AS up, round((SELECT median(up) FROM terrain), 4) AS all_up FROM terrain"))
def terrain_prior(spark, sf_dir):
    t = terrain(spark, sf_dir)
    return t.crossJoin(F.broadcast(exact_quantiles(t, [], "up", {"all_up": 0.5}))).select("ce", "cn", r(c("up")).alias("up"), r(c("all_up")).alias("all_up"))  # one row


@query(
    "J15_terrain_lookup",
    with_tables("captures landmarks", TERRAIN + """, q AS (SELECT id, CAST(floor(e / 60) AS BIGINT) AS qe, CAST(floor(n / 60) AS BIGINT) AS qn FROM landmarks),
o AS (SELECT q.id, greatest(abs(t.ce - qe), abs(t.cn - qn)) AS ring, t.up FROM q JOIN terrain t ON abs(t.ce - qe) <= 2 AND abs(t.cn - qn) <= 2),
m AS (SELECT id, max(up) FILTER (ring = 0) AS a, median(up) FILTER (ring <= 1) AS b, median(up) FILTER (ring <= 2) AS d FROM o GROUP BY id)
SELECT id, round(coalesce(a, b, d, (SELECT median(up) FROM terrain)), 4) AS up FROM q LEFT JOIN m USING (id)"""),
)
def terrain_lookup(spark, sf_dir):
    """The pose's own cell, else the median of ever wider rings, else of all."""
    t = terrain(spark, sf_dir)
    q = domain.landmarks(spark, sf_dir).select("id", *[x.alias(k) for k, x in zip(("qe", "qn"), geo.plane_cell(c("e"), c("n"), 60.0))])
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    near = q.withColumn("s", F.explode(steps)).select("id", (c("qe") + c("s.a")).alias("ce"), (c("qn") + c("s.b")).alias("cn"), F.greatest(F.abs("s.a"), F.abs("s.b")).alias("ring"))
    up = lambda k: F.median(F.when(c("ring") <= k, c("up")))
    found = near.join(t, ["ce", "cn"]).groupBy("id").agg(F.coalesce(up(0), up(1), up(2)).alias("up"))
    whole = exact_quantiles(t, [], "up", {"all_up": 0.5})  # one row
    return q.select("id").join(found, "id", "left").crossJoin(F.broadcast(whole)).select("id", r(F.coalesce("up", "all_up")).alias("up"))


BINS = [0, 3, 6, 10, 15, 25, 40, 70]
_BIN = "CASE " + " ".join(f"WHEN build_h < {hi} THEN {k}" for k, hi in enumerate(BINS[1:])) + " ELSE 7 END"
SALIENT = f""", t AS (SELECT row // 12 AS cr, col // 12 AS cc, ground, build_h, {_BIN} AS bin FROM texels WHERE row // 12 < (SELECT (max(row) + 1) // 12 FROM texels)),
hist AS (SELECT cr, cc, bin, count(*) AS k, count(*) FILTER (build_h > 1) AS kb FROM t GROUP BY cr, cc, bin),
base AS (SELECT cr, cc, stddev_pop(ground) AS relief, max(build_h) FILTER (build_h > 1) AS top, median(build_h) FILTER (build_h > 1) AS mid FROM t GROUP BY cr, cc),
ent AS (SELECT cr, cc, -sum(CASE WHEN kb > 0 THEN (kb / CAST(tot AS DOUBLE)) * ln(kb / CAST(tot AS DOUBLE)) END) AS entropy FROM (SELECT *, sum(kb) OVER (PARTITION BY cr, cc) AS tot FROM hist) GROUP BY cr, cc),
nrm AS (SELECT cr, cc, bin, k / sqrt(sum(k * k) OVER (PARTITION BY cr, cc)) AS v FROM hist),
sim AS (SELECT a.cr, a.cc, b.cr AS br, b.cc AS bc, sum(a.v * b.v) AS s FROM nrm a JOIN nrm b ON a.bin = b.bin AND (a.cr <> b.cr OR a.cc <> b.cc) GROUP BY 1, 2, 3, 4),
rar AS (SELECT cr, cc, 1 - max(s) AS rarity FROM sim GROUP BY cr, cc),
sal AS (SELECT cr, cc, relief, coalesce(entropy, 0) AS entropy, coalesce(rarity, 2) AS rarity, coalesce(top > 3 * greatest(mid, 1), false) AS landmark FROM base JOIN ent USING (cr, cc) LEFT JOIN rar USING (cr, cc)),
dis AS (SELECT *, least(1, relief / 15) * CAST(0.35 AS DOUBLE) + least(1, entropy / CAST(1.6 AS DOUBLE)) * CAST(0.3 AS DOUBLE) + least(1, rarity * 2) * CAST(0.2 AS DOUBLE) + CASE WHEN landmark THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS d FROM sal)
"""


def saliency(spark, sf_dir):
    from skylattice.operators.saliency import cell_saliency

    return cell_saliency(domain.texels(spark, sf_dir), 12)


for name, cols in {
    "A13_cell_relief": "relief", "A14_height_entropy": "entropy", "A15_landmark_flag": "landmark", "J17_skyline_rarity": "rarity", "A16_density_multiplier": "density", "K06_saliency_output": "density", "S22_saliency_map": "density",
}.items():
    _of = {"landmark": "landmark", "density": "round(greatest(0.5, least(2.2, CAST(1.35 AS DOUBLE) - d)), 4) AS density"}.get(cols, f"round({cols}, 4) AS {cols}")

    @query(name, with_tables("texels", SALIENT + f"SELECT cr, cc, {_of} FROM dis"))
    def cell_measure(spark, sf_dir, cols=cols, name=name):
        s = saliency(spark, sf_dir)
        if name[0] in "KS":
            from skylattice.plans.ingestion import table_path

            path = table_path(spark, "saliency")
            s.write.parquet(path)
            s = spark.read.parquet(path)
        return s.select("cr", "cc", c(cols) if cols == "landmark" else r(c(cols)).alias(cols))


@query("J16_pose_density", with_tables("texels captures", SALIENT + "SELECT p.id, CASE WHEN d IS NULL THEN 1 ELSE round(greatest(0.5, least(2.2, CAST(1.35 AS DOUBLE) - d)), 4) END AS density FROM captures p LEFT JOIN dis ON cr = CAST(floor(p.n / 30) AS BIGINT) AND cc = CAST(floor(p.e / 30) AS BIGINT)"))
def pose_density(spark, sf_dir):
    """Density at each pose, one where the map has no cell."""
    s = saliency(spark, sf_dir).select("cr", "cc", "density")
    p = domain.captures(spark, sf_dir).select("id", F.floor(c("n") / 30).alias("cr"), F.floor(c("e") / 30).alias("cc"))
    return p.join(s, ["cr", "cc"], "left").select("id", r(F.coalesce("density", F.lit(1.0))).alias("density"))


@query("T02_orbit_points")
def orbit_points(spark, sf_dir):
    from skylattice.operators.saliency import separated_peaks

    return separated_peaks(domain.texels(spark, sf_dir), 20, 10.0)


VEG = f"CASE WHEN build_h > 0 OR {HASH} < CAST(0.18 AS DOUBLE) THEN 0 WHEN class_id = 6 THEN 16 * (CAST(0.7 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {HASH}) ELSE 0 END"


@query("A41_canopy", with_tables("texels", f"SELECT row, col, round({VEG}, 4) AS veg_h FROM texels WHERE class_id IN (6, 7)"))
def canopy(spark, sf_dir):
    t = domain.texels(spark, sf_dir).where("class_id in (6, 7)")
    return t.select("row", "col", r(raster.canopy_height(c("row"), c("col"), c("class_id"), c("build_h"))).alias("veg_h"))


@query("K10_tree_instances", with_tables("texels", f"SELECT row, col, round({VEG}, 4) AS veg_h FROM texels WHERE row % 4 = 0 AND col % 4 = 0 AND {VEG} > 1"))
def tree_instances(spark, sf_dir):
    t = domain.texels(spark, sf_dir).where("row % 4 = 0 and col % 4 = 0")
    veg = raster.canopy_height(c("row"), c("col"), c("class_id"), c("build_h"))
    return t.select("row", "col", veg.alias("veg_h")).where("veg_h > 1").select("row", "col", r(c("veg_h")).alias("veg_h"))


@query("A42_water_level", with_tables("texels", "SELECT row, col, round(CASE WHEN class_id = 2 THEN (SELECT quantile_cont(ground, 0.1) FROM texels WHERE class_id = 2) ELSE ground END, 4) AS ground FROM texels"))
def water_level(spark, sf_dir):
    """Water lies flat at the tenth percentile of its ground."""
    t = domain.texels(spark, sf_dir)
    level = exact_quantiles(t.where("class_id = 2"), [], "ground", {"level": 0.1})  # one row, or none without water
    return t.join(F.broadcast(level), F.lit(True), "left").select("row", "col", r(F.when(c("class_id") == 2, c("level")).otherwise(c("ground"))).alias("ground"))


@query("A43_mosaic_stats", with_tables("texels", "SELECT min(ground) AS low, max(ground) AS high, max(ground + build_h) AS top, round(median(ground) FILTER (row < 64), 4) AS ground_offset FROM texels"))
def mosaic_stats(spark, sf_dir):
    """The ground offset is the median of the first window of rows."""
    t = domain.texels(spark, sf_dir)
    sums = t.agg(F.min("ground").alias("low"), F.max("ground").alias("high"), F.max(c("ground") + c("build_h")).alias("top"))
    return with_quantiles(sums, t.where("row < 64"), [], {"ground": {"ground_offset": 0.5}}).select("low", "high", "top", r(c("ground_offset")).alias("ground_offset"))


@query("A44_rail_embankment", with_tables("texels", "SELECT count(*) AS n, round(sum(ground + CAST(0.7 AS DOUBLE)), 3) AS total FROM texels WHERE class_id = 4"))
def rail_embankment(spark, sf_dir):
    t = domain.texels(spark, sf_dir).withColumn("ground", F.when(c("class_id") == 4, c("ground") + 0.7).otherwise(c("ground")))
    return t.where("class_id = 4").agg(F.count("*").alias("n"), r(F.sum("ground"), 3).alias("total"))


@query("J25_terrain_base", with_tables("texels buildings", "SELECT b.id, round(t.ground, 3) AS base FROM buildings b JOIN texels t ON t.row = least(11, CAST(floor((b.lat - 43.31::DOUBLE) * 600) AS BIGINT)) AND t.col = least(119, CAST(floor((b.lon - 11.32::DOUBLE) * 5000) AS BIGINT))"))
def terrain_base(spark, sf_dir):
    b = domain.buildings(spark, sf_dir).select("id", F.least(F.lit(11), F.floor((c("lat") - 43.31) * 600)).alias("row"), F.least(F.lit(119), F.floor((c("lon") - 11.32) * 5000)).alias("col"))
    return b.join(domain.texels(spark, sf_dir).select("row", "col", "ground"), ["row", "col"]).select("id", r(c("ground"), 3).alias("base"))


@query("J27_class_lookup", with_tables("texels", "SELECT class_id, n, round(n * CASE class_id WHEN 2 THEN 0.10::DOUBLE WHEN 6 THEN 0.20::DOUBLE WHEN 4 THEN 0.30::DOUBLE ELSE 0.52::DOUBLE END, 4) AS red FROM (SELECT class_id, count(*) AS n FROM texels GROUP BY class_id)"))
def class_lookup(spark, sf_dir):
    from skylattice.functions.features import lookup

    n = domain.texels(spark, sf_dir).groupBy("class_id").agg(F.count("*").alias("n"))
    return n.select("class_id", "n", r(c("n") * lookup(c("class_id"), {k: v[0] for k, v in raster.CLASS_COLOURS.items()})).alias("red"))


BOX = """, a AS (SELECT row, col, sum(build_h) OVER w AS s, count(*) OVER w AS k FROM texels WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT row, col, sum(s) OVER w / sum(k) OVER w AS mean FROM a WINDOW w AS (PARTITION BY col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
"""


@query("W10_box_mean", with_tables("texels", BOX + "SELECT row, col, round(mean, 4) AS mean FROM m"))
def box_mean(spark, sf_dir):
    return rasters.box_mean(domain.texels(spark, sf_dir), "build_h", 2).select("row", "col", r(c("mean")).alias("mean"))


@query("W11_dilate", with_tables("texels", ", b AS (SELECT row, col, build_h > 30 AS f FROM texels), r AS (SELECT row, col, bool_or(f) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM b) SELECT row, col FROM (SELECT row, col, bool_or(f) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM r) WHERE f"))
def dilate(spark, sf_dir):
    t = domain.texels(spark, sf_dir).select("row", "col", (c("build_h") > 30).alias("f"))
    return rasters.dilate(t, "f", 1).where("f").select("row", "col")


@query("W16_facade_step", with_tables("texels", "SELECT row, col, round(greatest(coalesce(abs(build_h - lead(build_h) OVER (PARTITION BY row ORDER BY col)), 0), coalesce(abs(build_h - lead(build_h) OVER (PARTITION BY col ORDER BY row)), 0)), 4) AS step FROM texels"))
def facade_step(spark, sf_dir):
    t = rasters.beside(domain.texels(spark, sf_dir), "build_h")
    jump = lambda k: F.coalesce(F.abs(c("build_h") - c(k)), F.lit(0.0))
    return t.select("row", "col", r(F.greatest(jump("right"), jump("down"))).alias("step"))


_DX = "(lead(ground) OVER (PARTITION BY row ORDER BY col) - lag(ground) OVER (PARTITION BY row ORDER BY col)) / 5"
_DY = "(lead(ground) OVER (PARTITION BY col ORDER BY row) - lag(ground) OVER (PARTITION BY col ORDER BY row)) / 5"


@query("W17_surface_normal", with_tables("texels", f", g AS (SELECT row, col, {_DX} AS dx, {_DY} AS dy FROM texels) SELECT row, col, round(-dx / sqrt(dx * dx + dy * dy + 1), 4) AS nx, round(-dy / sqrt(dx * dx + dy * dy + 1), 4) AS ny, round(1 / sqrt(dx * dx + dy * dy + 1), 4) AS nz FROM g WHERE dx IS NOT NULL AND dy IS NOT NULL"))
def surface_normal(spark, sf_dir):
    t = rasters.beside(domain.texels(spark, sf_dir).select("row", "col", "ground"), "ground")
    t = t.select("row", "col", ((c("right") - c("left")) / 5).alias("dx"), ((c("down") - c("up")) / 5).alias("dy")).dropna()
    long_ = F.sqrt(c("dx") * c("dx") + c("dy") * c("dy") + 1)
    return t.select("row", "col", r(-c("dx") / long_).alias("nx"), r(-c("dy") / long_).alias("ny"), r(1 / long_).alias("nz"))


#: Differences across each texel, from scene to scene; none at the border.
SLOPES = """, g AS (SELECT scene, row, col, gray, coalesce(lead(gray) OVER (PARTITION BY scene, row ORDER BY col) - lag(gray) OVER (PARTITION BY scene, row ORDER BY col), 0) AS dx,
  coalesce(lead(gray) OVER (PARTITION BY scene, col ORDER BY row) - lag(gray) OVER (PARTITION BY scene, col ORDER BY row), 0) AS dy FROM ortho_px)
"""


def slopes(spark, sf_dir):
    px = rasters.beside(domain.ortho_px(spark, sf_dir).select("scene", "row", "col", "gray"), "gray", ("scene",))
    return px.withColumn("dx", F.coalesce(c("right") - c("left"), F.lit(0.0))).withColumn("dy", F.coalesce(c("down") - c("up"), F.lit(0.0)))


@query("W19_gradient", with_tables("ortho_px", SLOPES + "SELECT scene, row, col, round(sqrt(dx * dx + dy * dy) / 2, 4) AS grad FROM g"))
def gradient(spark, sf_dir):
    """Central differences of every scene; none across the border."""
    return slopes(spark, sf_dir).select("scene", "row", "col", r(F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")) / 2).alias("grad"))


STATS = ", v AS (SELECT scene, row // 16 AS br, col // 16 AS bc, gray, r, g, b FROM ortho_px WHERE valid), s AS (SELECT scene, br, bc, median(gray) AS mid, median(r) AS mid_r, median(g) AS mid_g, median(b) AS mid_b, count(*) AS n FROM v GROUP BY ALL), d AS (SELECT v.scene, v.br, v.bc, median(abs(v.gray - s.mid)) AS mad FROM v JOIN s USING (scene, br, bc) GROUP BY ALL)\n"


@query("A30_block_stats", with_tables("ortho_px", STATS + "SELECT scene, br, bc, round(mid, 4) AS mid, round(mad, 4) AS mad, round(mid_r, 4) AS mid_r, n FROM s JOIN d USING (scene, br, bc)"))
def block_stats(spark, sf_dir):
    s = rasters.block_stats(domain.ortho_px(spark, sf_dir), 16)
    return s.select("scene", "br", "bc", r(c("mid")).alias("mid"), r(c("mad")).alias("mad"), r(c("mid_r")).alias("mid_r"), "n")


EDGES = f"""SELECT a.scene, a.br, a.bc, b.br AS nr, b.bc AS nc FROM s a JOIN s b ON a.scene = b.scene AND (b.br = a.br + 1 AND b.bc = a.bc OR b.br = a.br AND b.bc = a.bc + 1)
WHERE round(abs(a.mid - b.mid), 9) <= CAST({rasters.LUM_SPLIT} AS DOUBLE) AND round(greatest(abs(a.mid_r - b.mid_r), abs(a.mid_g - b.mid_g), abs(a.mid_b - b.mid_b)), 9) <= CAST({rasters.CHAN_SPLIT} AS DOUBLE)"""


@query("J20_block_edges", with_tables("ortho_px", STATS + EDGES))
def block_edges(spark, sf_dir):
    return rasters.like_blocks(rasters.block_stats(domain.ortho_px(spark, sf_dir), 16))


def _gain(k: str) -> str:
    return f"round(greatest(0.5, least(2, rg_{k} / greatest(sg_{k}, CAST(0.001 AS DOUBLE)))), 4) AS gain_{k}"


@query("A33_scene_alignment", with_tables("ortho_px", """, p AS (SELECT b.scene, a.gray AS ra, b.gray AS rb, a.r AS r0, a.g AS g0, a.b AS b0, b.r, b.g, b.b FROM ortho_px a JOIN ortho_px b ON a.scene = 0 AND b.scene > 0 AND a.row = b.row AND a.col = b.col WHERE a.valid AND b.valid),
m AS (SELECT scene, count(*) AS n, median(ra) AS ref_mid, median(rb) AS mid, median(r0) AS rg_r, median(g0) AS rg_g, median(b0) AS rg_b, median(r) AS sg_r, median(g) AS sg_g, median(b) AS sg_b FROM p GROUP BY scene),
d AS (SELECT scene, median(abs(ra - ref_mid)) AS ref_mad, median(abs(rb - mid)) AS mad FROM p JOIN m USING (scene) GROUP BY scene)
SELECT scene, n, round(mid, 4) AS mid, round(ref_mid, 4) AS ref_mid, round(greatest(0.5, least(2, CASE WHEN ref_mad > 0 THEN ref_mad ELSE 0.001 END / CASE WHEN mad > 0 THEN mad ELSE 0.001 END)), 4) AS scale, """ + ", ".join(map(_gain, "rgb")) + " FROM m JOIN d USING (scene) WHERE n >= 500"))  # fmt: skip
def scene_alignment(spark, sf_dir):
    """What brings each later scene to the first one, on pixels that both show."""
    px = domain.ortho_px(spark, sf_dir).where("valid")
    gains = rasters.scene_gains(px.where("scene > 0"), px.where("scene = 0"))
    return gains.select("scene", "n", *[r(c(k)).alias(k) for k in ("mid", "ref_mid", "scale", "gain_r", "gain_g", "gain_b")])


COMP = ", f AS (SELECT row, col, min(scene) FILTER (valid) AS first, arg_min(gray, scene) FILTER (valid) AS gray FROM ortho_px GROUP BY row, col)\n"


@query("J21_composite", with_tables("ortho_px", COMP + "SELECT row, col, first, round(gray, 4) AS gray FROM f"))
def composite(spark, sf_dir):
    """Each texel from its first valid scene; null where none is."""
    from skylattice.operators.saliency import first_valid

    return first_valid(domain.ortho_px(spark, sf_dir)).select("row", "col", "first", r(c("gray")).alias("gray"))


@query("A34_composite_stats", with_tables("ortho_px", COMP + """, k AS (SELECT s.scene, count(f.row) FILTER (f.first = s.scene) AS fills, count(f.row) FILTER (f.first IS NULL OR f.first >= s.scene) / count(*)::DOUBLE AS holes_before, count(f.row) FILTER (f.first IS NULL OR f.first > s.scene) / count(*)::DOUBLE AS holes_after FROM (SELECT DISTINCT scene FROM ortho_px) s CROSS JOIN f GROUP BY s.scene)
SELECT scene, fills, round(holes_before, 4) AS holes_before, round(holes_after, 4) AS holes_after, scene = 0 OR (holes_before > 0.005 AND fills > 0) AS used FROM k WHERE scene = 0 OR holes_before > 0.005"""))  # fmt: skip
def composite_stats(spark, sf_dir):
    """What each scene fills, in order, until less than half a percent of the texels are holes."""
    from skylattice.operators.saliency import composite_fills

    f = composite_fills(domain.ortho_px(spark, sf_dir))
    return f.select("scene", "fills", r(c("holes_before")).alias("holes_before"), r(c("holes_after")).alias("holes_after"), "used")


ROOFS = 500


@query("T08_every_nth", with_tables("texels", f""", k AS (SELECT row, col, row_number() OVER (ORDER BY row, col) - 1 AS k, count(*) OVER () AS n FROM texels WHERE build_h > 0)
SELECT row, col FROM k WHERE k % greatest(1, n // {ROOFS}) = 0"""))
def every_nth(spark, sf_dir):
    """About ROOFS roof texels: every n-th in order, n from their count. A sampling operator."""
    roofs = domain.texels(spark, sf_dir).where("build_h > 0").select("row", "col")
    step = roofs.agg(F.greatest(F.lit(1), F.floor(F.count("*") / ROOFS)).alias("step"))  # one row
    return ingest.numbered(roofs, ["row", "col"]).crossJoin(F.broadcast(step)).where(c("index") % c("step") == 0).select("row", "col")


@query("A40_imagery_vegetation", with_tables("ortho_px", """, q AS (SELECT t.row, t.col, t.class_id, CASE WHEN o.g > o.r * CAST(1.1 AS DOUBLE) AND o.g > o.b AND o.valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS green FROM texels t JOIN ortho_px o ON o.scene = 0 AND o.row = t.row AND o.col = t.col),
x AS (SELECT *, sum(green) OVER w AS s, count(green) OVER w AS k FROM q WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
y AS (SELECT *, sum(s) OVER w / sum(k) OVER w AS dense FROM x WINDOW w AS (PARTITION BY col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT row, col, CASE WHEN class_id <> 0 THEN class_id WHEN round(dense, 6) > CAST(0.55 AS DOUBLE) THEN 6 WHEN green > 0 THEN 1 ELSE 0 END AS class_id FROM y"""))  # fmt: skip
def imagery_vegetation(spark, sf_dir):
    """Green pixels become green ground, dense ones forest; classes that are known stay."""
    o = domain.ortho_px(spark, sf_dir).where("scene = 0").select("row", "col", "r", "g", "b", "valid")
    green = ((c("g") > c("r") * 1.1) & (c("g") > c("b")) & c("valid")).cast("double")
    t = domain.texels(spark, sf_dir).select("row", "col", "class_id").join(o, ["row", "col"]).withColumn("green", green)
    dense = rasters.box_mean(t, "green", 1)
    grown = F.when(c("class_id") != 0, c("class_id")).when(F.round("mean", 6) > 0.55, 6).when(c("green") > 0, 1).otherwise(0)
    return dense.select("row", "col", grown.alias("class_id"))

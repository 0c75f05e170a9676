"""Queries of cells, caches, manifests, coverage, generated plans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import features, geo
from skylattice.operators import cell_log, evaluate, ingest
from skylattice.operators.quantiles import with_quantiles
from skylattice.plans.base import r
from skylattice.plans.evaluation import CELLS, errors
from skylattice.plans.scalars import STEP
from skylattice.registry import query
from skylattice.session import new_path
from skylattice.sources import domain
from skylattice.sources.domain import with_tables

c = lambda name: F.col(name)


def boxes(spark, sf_dir):
    return domain.pois(spark, sf_dir).select("id", (c("lat") - 0.006).alias("south"), (c("lon") - 0.006).alias("west"), (c("lat") + 0.006).alias("north"), (c("lon") + 0.006).alias("east"))


BOXES = ", boxes AS (SELECT id, lat - CAST(0.006 AS DOUBLE) AS south, lon - CAST(0.006 AS DOUBLE) AS west, lat + CAST(0.006 AS DOUBLE) AS north, lon + CAST(0.006 AS DOUBLE) AS east FROM pois)\n"
COVER = BOXES + f""", rows_ AS (SELECT id, west, east, unnest(generate_series(CAST(floor(south / {STEP}) AS BIGINT), CAST(floor((north - 1e-12) / {STEP}) AS BIGINT))) AS ilat FROM boxes),
cover AS (SELECT id, ilat, ilon, 'c500_' || ilat || '_' || ilon AS cell FROM (SELECT id, ilat, unnest(generate_series(CAST(floor(west / {STEP}) AS BIGINT), CAST(floor((east - 1e-12) / {STEP}) AS BIGINT))) AS ilon FROM rows_))
"""


@query("G06_box_cells", with_tables("pois", COVER + "SELECT id, cell FROM cover"))
def box_cells(spark, sf_dir):
    return ingest.cells_of_boxes(boxes(spark, sf_dir)).select("id", "cell")


for name in ("J11_selection_cells", "U01_cell_union", "T09_sorted_cells"):

    @query(name, with_tables("pois", COVER + "SELECT cell, row_number() OVER (ORDER BY cell) AS place FROM (SELECT DISTINCT cell FROM cover)"))
    def selection_cells(spark, sf_dir):
        """Each cell once, with its place in the order of ids, counted in buckets of leading rows."""
        cells = ingest.cells_of_boxes(boxes(spark, sf_dir)).select("ilat", "cell").distinct()
        part = cells.withColumn("head", F.substring("cell", 1, 9))
        before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # a row per leading string
        heads = part.groupBy("head").count().select("head", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        within = F.row_number().over(Window.partitionBy("head").orderBy("cell"))
        return part.withColumn("k", within).join(heads, "head").select("cell", (c("before") + c("k")).alias("place"))


@query("A50_cells_extent", with_tables("pois", COVER + f"SELECT round(min(ilat) * {STEP}, 6) AS south, round(min(ilon) * {STEP}, 6) AS west, round((max(ilat) + 1) * {STEP}, 6) AS north, round((max(ilon) + 1) * {STEP}, 6) AS east FROM cover"))
def cells_extent(spark, sf_dir):
    cells = ingest.cells_of_boxes(boxes(spark, sf_dir))
    corner = [x for k, x in enumerate(geo.cell_bbox(F.min("ilat"), F.min("ilon"))) if k < 2] + [x for k, x in enumerate(geo.cell_bbox(F.max("ilat"), F.max("ilon"))) if k > 1]
    return cells.agg(*[r(x, 6).alias(k) for k, x in zip(("south", "west", "north", "east"), corner)])


@query(
    "G07_dem_tiles",
    with_tables("pois", BOXES + """, t AS (SELECT id, west, east, unnest(generate_series(CAST(floor(south * 3) AS BIGINT), CAST(floor(north * 3) AS BIGINT))) AS lat FROM boxes),
u AS (SELECT id, lat, unnest(generate_series(CAST(floor(west * 5) AS BIGINT), CAST(floor(east * 5) AS BIGINT))) AS lon FROM t)
SELECT id, 'Copernicus_DSM_COG_10_N' || lpad(CAST(lat AS VARCHAR), 2, '0') || '_00_E' || lpad(CAST(lon AS VARCHAR), 3, '0') || '_00_DEM' AS tile FROM u"""),
)
def dem_tiles(spark, sf_dir):
    wide = boxes(spark, sf_dir).select("id", (c("south") * 3).alias("south"), (c("west") * 5).alias("west"), (c("north") * 3).alias("north"), (c("east") * 5).alias("east"))
    return ingest.dem_tiles(wide).select("id", "tile")


@query(
    "A22_dem_coverage",
    with_tables("pois buildings", BOXES + """, t AS (SELECT DISTINCT CAST(floor(south * 300) AS BIGINT) AS lat, CAST(floor(west * 300) AS BIGINT) AS lon FROM boxes),
h AS (SELECT DISTINCT CAST(floor(lat * 300) AS BIGINT) AS lat, CAST(floor(lon * 300) AS BIGINT) AS lon, true AS held FROM buildings WHERE size % 7 = 0)
SELECT count(*) AS tiles, round(avg(CASE WHEN held THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS covered FROM t LEFT JOIN h USING (lat, lon)"""),
)
def dem_coverage(spark, sf_dir):
    """Share of wanted tiles that the tile catalogue holds: the tiles of some buildings, a table of its own."""
    b = boxes(spark, sf_dir)
    wanted = b.select(F.floor(c("south") * 300).alias("lat"), F.floor(c("west") * 300).alias("lon")).distinct()
    held = domain.buildings(spark, sf_dir).where("size % 7 = 0").select(F.floor(c("lat") * 300).alias("lat"), F.floor(c("lon") * 300).alias("lon"))
    catalogue = held.distinct().withColumn("held", F.lit(1.0))
    return wanted.join(catalogue, ["lat", "lon"], "left").agg(F.count("*").alias("tiles"), r(F.avg(F.coalesce("held", F.lit(0.0)))).alias("covered"))


@query(
    "G10_web_tiles",
    with_tables("pois", BOXES + """, t AS (SELECT id, CAST(trunc((west + 180) / 360 * 32768) AS BIGINT) AS x0, CAST(trunc((east + 180) / 360 * 32768) AS BIGINT) AS x1,
  CAST(trunc((1 - asinh(tan(radians(north))) / pi()) / 2 * 32768) AS BIGINT) AS y0, CAST(trunc((1 - asinh(tan(radians(south))) / pi()) / 2 * 32768) AS BIGINT) AS y1 FROM boxes),
u AS (SELECT id, y0, y1, unnest(generate_series(x0, x1)) AS x FROM t) SELECT id, x, unnest(generate_series(y0, y1)) AS y FROM u"""),
)
def web_tiles(spark, sf_dir):
    return ingest.web_tiles(boxes(spark, sf_dir), 15).select("id", "x", "y")


@query(
    "G05_tile_grid",
    """WITH b AS (SELECT id, CAST(10 AS DOUBLE) * id AS e0, CAST(0 AS DOUBLE) AS n0, CAST(10 AS DOUBLE) * id + 700 + id % 900 AS e1, CAST(500 + id % 600 AS DOUBLE) AS n1 FROM (SELECT s_suppkey AS id FROM supplier)),
k AS (SELECT *, greatest(1, CAST(ceil((e1 - e0) / 400) AS BIGINT)) AS ke, greatest(1, CAST(ceil((n1 - n0) / 400) AS BIGINT)) AS kn FROM b),
i AS (SELECT *, unnest(generate_series(0, ke - 1)) AS i FROM k), j AS (SELECT *, unnest(generate_series(0, kn - 1)) AS j FROM i)
SELECT 't' || i || '_' || j AS tile, round(e0 + i * (e1 - e0) / ke, 4) AS e_min, round(e0 + (i + 1) * (e1 - e0) / ke, 4) AS e_max, round(n0 + j * (n1 - n0) / kn, 4) AS n_min FROM j""",
)
def tile_grid(spark, sf_dir):
    b = domain.raw(spark, sf_dir, "supplier").selectExpr("10D * s_suppkey AS e0", "0D AS n0", "10D * s_suppkey + 700 + s_suppkey % 900 AS e1", "CAST(500 + s_suppkey % 600 AS DOUBLE) AS n1")
    return ingest.tile_grid(b, 400.0).select("tile", *[r(c(k)).alias(k) for k in ("e_min", "e_max", "n_min")])


TILES = """, b AS (SELECT min(e) AS e0, max(e) AS e1, min(n) AS n0, max(n) AS n1 FROM captures),
g AS (SELECT i * 3 + j AS seq, 't' || i || '_' || j AS tile, e0 + i * (e1 - e0) / 3 AS e_min, e0 + (i + 1) * (e1 - e0) / 3 AS e_max, n0 + j * (n1 - n0) / 3 AS n_min, n0 + (j + 1) * (n1 - n0) / 3 AS n_max
  FROM b CROSS JOIN range(3) a(i) CROSS JOIN range(3) d(j))
"""


def bounds_of(poses):
    return poses.agg(F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("n").alias("n0"), F.max("n").alias("n1"))  # one row


NEAREST = "arg_min(tile, ((e_min + e_max) / 2 - {e}) ** 2 + ((n_min + n_max) / 2 - {n}) ** 2)"


@query("J19_tile_of_pose", with_tables("captures frames", TILES + f"SELECT frame_id, arg_min(tile, seq) FILTER (est_e BETWEEN e_min AND e_max AND est_n BETWEEN n_min AND n_max) AS inside, {NEAREST.format(e='est_e', n='est_n')} AS nearest FROM frames CROSS JOIN g GROUP BY frame_id"))
def tile_of_pose(spark, sf_dir):
    """First of nine tiles that holds each estimate, null outside of all, and the nearest one."""
    poses = domain.frames(spark, sf_dir).select("frame_id", "est_e", "est_n")
    return ingest.tile_of(poses, bounds_of(domain.captures(spark, sf_dir)), "est_e", "est_n", 3, 3).select("frame_id", "inside", "nearest")


@query("J12_feature_cells", with_tables("buildings pois", COVER + f", b AS (SELECT id, 'c500_' || CAST(floor(lat / {STEP}) AS BIGINT) || '_' || CAST(floor(lon / {STEP}) AS BIGINT) AS cell FROM buildings) SELECT b.id, b.cell FROM b JOIN (SELECT DISTINCT cell FROM cover) r USING (cell)"))
def feature_cells(spark, sf_dir):
    """Features whose centroid lies in a requested cell."""
    wanted = ingest.cells_of_boxes(boxes(spark, sf_dir)).select("cell").distinct()
    b = domain.buildings(spark, sf_dir).select("id", geo.cell_id(*geo.cell_index(c("lat"), c("lon"))).alias("cell"))
    return b.join(wanted, "cell", "left_semi").select("id", "cell")


STATE = """, s AS (SELECT DISTINCT kind, cell, status FROM cells_state)
"""


@query("J13_resume_classes", with_tables("cells_state", STATE + """, k AS (SELECT DISTINCT kind, cell FROM cells_state)
SELECT kind, cell, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.kind = k.kind AND s.cell = k.cell AND status = 'cached') THEN 'cached'
  WHEN EXISTS (SELECT 1 FROM s WHERE s.kind = k.kind AND s.cell = k.cell AND status = 'skipped') THEN 'skipped' ELSE 'pending' END AS class FROM k"""))  # fmt: skip
def resume_classes(spark, sf_dir):
    s = domain.cells_state(spark, sf_dir)
    has = lambda x: F.bool_or(c("status") == x)
    return s.groupBy("kind", "cell").agg(F.when(has("cached"), "cached").when(has("skipped"), "skipped").otherwise("pending").alias("class"))


@query("U03_pending_cells", with_tables("cells_state", "SELECT DISTINCT cell FROM cells_state EXCEPT SELECT cell FROM cells_state WHERE status IN ('cached', 'skipped')"))
def pending_cells(spark, sf_dir):
    s = domain.cells_state(spark, sf_dir).select("cell", "status")
    return ingest.pending(s.select("cell").distinct(), s.where("status = 'cached'"), s.where("status = 'skipped'"))


@query("S15_cache_read", with_tables("cells_state", "SELECT kind, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'skipped') AS skipped FROM cells_state GROUP BY kind"))
def cache_read(spark, sf_dir):
    return domain.cells_state(spark, sf_dir).where("status in ('cached', 'skipped')").groupBy("kind").agg(F.count_if(c("status") == "cached").alias("cached"), F.count_if(c("status") == "skipped").alias("skipped"))


@query("A20_cell_report", with_tables("cells_state", "SELECT kind, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("cached", "skipped", "deferred", "failed", "fetched")) + " FROM cells_state GROUP BY kind"))
def cell_report(spark, sf_dir):
    names = ["cached", "skipped", "deferred", "failed", "fetched"]
    return domain.cells_state(spark, sf_dir).groupBy("kind").pivot("status", names).count().na.fill(0).select("kind", *names)


@query("A21_cache_coverage", with_tables("cells_state", """, r AS (SELECT kind, cell FROM (SELECT DISTINCT kind FROM cells_state) CROSS JOIN (SELECT DISTINCT cell FROM cells_state)),
b AS (SELECT kind, cell, bool_or(status = 'cached') AS cached, bool_or(status = 'skipped') AS skipped FROM cells_state GROUP BY kind, cell)
SELECT kind, count(*) AS wanted, count(*) FILTER (cached) AS cached, count(*) FILTER (skipped AND NOT cached) AS skipped, count(*) FILTER (NOT coalesce(cached OR skipped, false)) AS missing FROM r LEFT JOIN b USING (kind, cell) GROUP BY kind"""))  # fmt: skip
def cache_coverage(spark, sf_dir):
    s = domain.cells_state(spark, sf_dir)
    kinds = s.select("kind").distinct()  # a handful
    wanted = s.select("cell").distinct().join(F.broadcast(kinds))
    held = s.groupBy("kind", "cell").agg(F.bool_or(c("status") == "cached").alias("cached"), F.bool_or(c("status") == "skipped").alias("skipped"))
    both = wanted.join(held, ["kind", "cell"], "left").na.fill(False)
    return both.groupBy("kind").agg(F.count("*").alias("wanted"), F.count_if("cached").alias("cached"), F.count_if(c("skipped") & ~c("cached")).alias("skipped"), F.count_if(~(c("cached") | c("skipped"))).alias("missing"))


@query("K05_download_manifest", with_tables("cells_state", "SELECT kind, count(DISTINCT cell) AS cells, " + ", ".join(f"count(DISTINCT cell) FILTER (status = '{k}') AS {k}" for k in ("cached", "fetched", "skipped", "deferred", "failed")) + " FROM cells_state GROUP BY kind"))
def download_manifest(spark, sf_dir):
    """A JSON summary per kind: its cells and how many of them have each status; written and read back."""
    states = ("cached", "fetched", "skipped", "deferred", "failed")
    s = domain.cells_state(spark, sf_dir).select("kind", "cell", "status").distinct()
    rows = s.groupBy("kind").agg(F.countDistinct("cell").alias("cells"), *[F.count_if(c("status") == k).alias(k) for k in states])
    path = table_path(spark, "manifest")
    rows.write.json(path)
    return spark.read.schema("kind string, " + ", ".join(f"{k} long" for k in ("cells", *states))).json(path)


@query("U07_deferred_cells", with_tables("cells_state", "SELECT cell, count(DISTINCT kind) AS kinds FROM cells_state WHERE status = 'deferred' GROUP BY cell"))
def deferred_cells(spark, sf_dir):
    """Sorted union of the deferred cells over all kinds, a row each."""
    d = domain.cells_state(spark, sf_dir).where("status = 'deferred'")
    return d.groupBy("cell").agg(F.countDistinct("kind").alias("kinds")).orderBy("cell")


FALL = """, p AS (SELECT cell, max(latency) AS v FROM fetch_log WHERE source = 0 AND ok GROUP BY cell), o AS (SELECT cell, max(latency) AS v FROM fetch_log WHERE source = 1 AND ok GROUP BY cell)
"""


@query("J31_source_fallback", with_tables("fetch_log", FALL + "SELECT coalesce(p.cell, o.cell) AS cell, round(coalesce(p.v, o.v), 4) AS latency, CASE WHEN p.cell IS NOT NULL THEN 'primary' ELSE 'fallback' END AS via FROM p FULL JOIN o ON p.cell = o.cell"))
def source_fallback(spark, sf_dir):
    log = domain.fetch_log(spark, sf_dir).where("ok")
    of = lambda k, name: log.where(c("source") == k).groupBy("cell").agg(F.max("latency").alias(name))
    via = F.when(c("p").isNotNull(), "primary").otherwise("fallback")
    return of(0, "p").join(of(1, "o"), "cell", "full").select("cell", r(F.coalesce("p", "o")).alias("latency"), via.alias("via"))


@query("A19_boundary_dedup", with_tables("cell_features", "SELECT osm_id, arg_max(cell, seq) AS cell, min(seq) AS first_seq FROM cell_features GROUP BY osm_id"))
def boundary_dedup(spark, sf_dir):
    f = domain.cell_features(spark, sf_dir).select("osm_id", "cell", "seq")
    return ingest.last_of_each(f, ["osm_id"], "seq").select("osm_id", "cell", "first_seq")


@query("A10_height_stats", with_tables("buildings", "SELECT cls, count(*) AS n, round(avg(CASE WHEN height_m IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS tagged, round(median(height_m), 4) AS median FROM buildings GROUP BY cls"))
def height_stats(spark, sf_dir):
    b = domain.buildings(spark, sf_dir)
    sums = b.groupBy("cls").agg(F.count("*").alias("n"), r(F.avg(c("height_m").isNotNull().cast("double"))).alias("tagged"))
    return with_quantiles(sums, b, ["cls"], {"height_m": {"median": 0.5}}).select("cls", "n", "tagged", r(c("median")).alias("median"))


@query("A23_building_coverage", with_tables("buildings", "SELECT height_source, count(*) AS n, count(*) FILTER (height_m > 0) AS with_height FROM buildings GROUP BY height_source"))
def building_coverage(spark, sf_dir):
    return domain.buildings(spark, sf_dir).groupBy("height_source").agg(F.count("*").alias("n"), F.count_if(c("height_m") > 0).alias("with_height"))


SCENES = "WITH scenes AS (SELECT DISTINCT CAST(date_trunc('day', o_orderdate) AS DATE) AS day, o_custkey % 3 AS tile, o_custkey % 100 AS cloud FROM orders)\n"


def scenes(spark, sf_dir):
    return domain.raw(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), (c("o_custkey") % 3).alias("tile"), (c("o_custkey") % 100).alias("cloud")).distinct()


@query("A24_scene_coverage", SCENES + "SELECT tile, count(*) AS n, max(day) AS newest FROM scenes GROUP BY tile")
def scene_coverage(spark, sf_dir):
    return scenes(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("n"), F.max("day").alias("newest"))


@query("S12_scene_catalogue", SCENES + "SELECT '34T' || tile AS square, day, cloud FROM scenes WHERE cloud % 7 <> 3 AND date_trunc('month', day) > date_trunc('month', (SELECT max(day) FROM scenes WHERE cloud % 7 <> 3)) - INTERVAL 8 MONTH")
def scene_catalogue(spark, sf_dir):
    """Scenes of the last eight months, dated by their names; names of another form are no scenes."""
    s = scenes(spark, sf_dir)
    date = F.date_format("day", "yyyyMMdd")
    named = s.select(F.concat(F.lit("S2A_34T"), "tile", F.lit("_"), F.when(c("cloud") % 7 == 3, F.substring(date, 1, 6)).otherwise(date), F.lit("_0_L2A")).alias("name"), "cloud")
    square, day = features.scene_of(c("name"))
    found = named.select(square.alias("square"), day.alias("day"), "cloud").where("day is not null")
    last = found.agg(F.add_months(F.trunc(F.max("day"), "month"), -8).alias("since"))  # one row
    return found.join(F.broadcast(last), F.trunc("day", "month") > c("since")).select("square", "day", "cloud")


@query(
    "T06_scene_order",
    SCENES + """, n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY day DESC, cloud) AS k FROM scenes), l AS (SELECT *, first_value(cloud) OVER (PARTITION BY tile ORDER BY k) AS first FROM n WHERE k <= 8)
SELECT tile, day, cloud, row_number() OVER (PARTITION BY tile ORDER BY CASE WHEN first > 50 THEN cloud ELSE 0 END, k) AS rank FROM l""",
)
def scene_order(spark, sf_dir):
    """Newest eight scenes of a tile; by cloud share if the newest is mostly cloud."""
    new = Window.partitionBy("tile").orderBy(F.desc("day"), "cloud")
    s = scenes(spark, sf_dir).withColumn("k", F.row_number().over(new)).where("k <= 8")
    s = s.withColumn("first", F.first("cloud").over(Window.partitionBy("tile").orderBy("k")))
    w = Window.partitionBy("tile").orderBy(F.when(c("first") > 50, c("cloud")).otherwise(0), "k")
    return s.select("tile", "day", "cloud", F.row_number().over(w).alias("rank"))


@query(
    "A25_coverage_report",
    with_tables("buildings", """SELECT count(*) AS n_buildings, round(avg(CASE WHEN height_m IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS height_share, (SELECT count(*) FROM supplier) AS n_pois,
  CASE WHEN avg(CASE WHEN height_m IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.5 THEN 'open tags' WHEN count(*) > 0 THEN 'shadow heights' ELSE 'imagery footprints' END AS advice FROM buildings"""),
)
def coverage_report(spark, sf_dir):
    b = domain.buildings(spark, sf_dir).agg(F.count("*").alias("n_buildings"), F.avg(c("height_m").isNotNull().cast("double")).alias("share"))
    p = domain.pois(spark, sf_dir).agg(F.count("*").alias("n_pois"))
    advice = F.when(c("share") >= 0.5, "open tags").when(c("n_buildings") > 0, "shadow heights").otherwise("imagery footprints")
    return b.crossJoin(F.broadcast(p)).select("n_buildings", r(c("share")).alias("height_share"), "n_pois", advice.alias("advice"))  # one row each


@query(
    "A58_district_rollup",
    with_tables("buildings", f""", b AS (SELECT cls, 'c500_' || CAST(floor(lat / {STEP}) AS BIGINT) || '_' || CAST(floor(lon / {STEP}) AS BIGINT) AS cell, height_m FROM buildings)
SELECT cls, cell, count(*) AS n, max(height_m) AS tall FROM b GROUP BY GROUPING SETS ((), (cls), (cell))"""),
)
def district_rollup(spark, sf_dir):
    """Counts at three grains: all, per class, per cell."""
    cell = geo.cell_id(*geo.cell_index(c("lat"), c("lon")))
    b = domain.buildings(spark, sf_dir).select("cls", cell.alias("cell"), "height_m")
    return b.groupingSets([[], ["cls"], ["cell"]], "cls", "cell").agg(F.count("*").alias("n"), F.max("height_m").alias("tall"))


NUMBERED = with_tables("frames", "SELECT frame_id, CAST(k AS BIGINT) AS index, CAST(k // 512 AS BIGINT) AS shard, CAST(k % 512 AS BIGINT) AS pos FROM (SELECT frame_id, 1000 + row_number() OVER (ORDER BY frame_id) - 1 AS k FROM frames WHERE initialized)")

for name in ("W14_shard_position", "K01_append_captures"):

    @query(name, NUMBERED)
    def shard_position(spark, sf_dir, name=name):
        """New captures continue the index at 1000; 512 to a shard."""
        rows = ingest.numbered(domain.frames(spark, sf_dir).where("initialized").select("frame_id"), ["frame_id"], 1000)
        rows = rows.select("frame_id", c("index").cast("long"), "shard", c("pos").cast("long"))
        if name.startswith("W"):
            return rows
        path = table_path(spark, "captures")
        rows.write.mode("append").parquet(path)
        return spark.read.parquet(path)


def table_path(spark, name: str) -> str:
    """A new table folder in the shared folder of the session."""
    return new_path(spark, name)


@query("K04_cache_put", with_tables("cells_state", """, ev AS (SELECT kind, cell, id, status, CASE WHEN status IN ('cached', 'fetched') THEN 'put' WHEN status = 'deferred' THEN 'clear' ELSE 'skip' END AS op FROM cells_state),
m AS (SELECT kind, cell, arg_max(id, id) FILTER (op = 'put') AS id, arg_max(op, id) FILTER (op <> 'put') = 'skip' AS skipped, arg_max(status, id) FILTER (op <> 'put') AS said FROM ev GROUP BY kind, cell)
SELECT kind, cell, id, coalesce(skipped, false) AS skipped, CASE WHEN skipped THEN said END AS reason FROM m WHERE id IS NOT NULL OR skipped"""))  # fmt: skip
def cache_put(spark, sf_dir):
    """Cells are put, marked to be skipped and cleared in three waves, with a compaction before the last."""
    s = domain.cells_state(spark, sf_dir)
    op = F.when(c("status").isin("cached", "fetched"), cell_log.PUT).when(c("status") == "deferred", cell_log.CLEAR).otherwise(cell_log.SKIP)
    events = s.select("kind", "cell", op.alias("op"), F.when(op == cell_log.PUT, c("id").cast("string")).otherwise(c("status")).alias("body"), c("id").alias("seq"))
    low, high = s.agg(F.min("id"), F.max("id")).first()
    bounds = [low + (high + 1 - low) * k // 3 for k in range(4)] if low is not None else [0] * 4
    log = cell_log.CellLog(spark, table_path(spark, "cells"))
    for k in range(3):
        if k == 2:
            log.compact()
        log.append(events.where((c("seq") >= bounds[k]) & (c("seq") < bounds[k + 1])))
    return log.state().select("kind", "cell", c("body").cast("long").alias("id"), "skipped", "reason")


@query("P01_box_filter", with_tables("buildings", "SELECT id FROM buildings WHERE lon + CAST(0.0003 AS DOUBLE) >= 11.325::DOUBLE AND lon <= 11.333::DOUBLE AND lat + CAST(0.0003 AS DOUBLE) >= 43.314::DOUBLE AND lat <= 43.322::DOUBLE"))
def box_filter(spark, sf_dir):
    """Extents that meet a box, edges included."""
    b = domain.buildings(spark, sf_dir)
    return b.where((c("lon") + 3e-4 >= 11.325) & (c("lon") <= 11.333) & (c("lat") + 3e-4 >= 43.314) & (c("lat") <= 43.322)).select("id")


@query("P06_weak_sources", with_tables("buildings", "SELECT id, height_source FROM buildings WHERE height_source IN ('none', 'neighbor_median')"))
def weak_sources(spark, sf_dir):
    return domain.buildings(spark, sf_dir).where(c("height_source").isin("none", "neighbor_median")).select("id", "height_source")


LAWN = """WITH b AS (SELECT min(s_suppkey) * 10 - CAST(300 AS DOUBLE) AS x0, max(s_suppkey) * 10 + CAST(300 AS DOUBLE) AS x1, CAST(-250 AS DOUBLE) AS z0, CAST(250 AS DOUBLE) AS z1 FROM supplier),
s AS (SELECT 60 / power(CAST(2.2 AS DOUBLE), 0.5) AS step),
i AS (SELECT x0, z0, z1, step, unnest(generate_series(0, CAST(floor((x1 - x0 + 1e-6) / step) AS BIGINT))) AS i FROM b, s), j AS (SELECT x0, z0, step, i, unnest(generate_series(0, CAST(floor((z1 - z0 + 1e-6) / step) AS BIGINT))) AS j FROM i),
g AS (SELECT x0 + i * step AS x, z0 + j * step AS z FROM j),
k AS (SELECT x, z FROM g WHERE (xor(CAST(trunc(x * CAST(7.31 AS DOUBLE)) AS BIGINT) * 73856093, CAST(trunc(z * CAST(7.31 AS DOUBLE)) AS BIGINT) * 19349663) & 65535) / CAST(65535 AS DOUBLE) <= CASE WHEN z > 0 THEN 2 ELSE CAST(0.6 AS DOUBLE) END / CAST(2.2 AS DOUBLE))
"""


def lawn(spark, sf_dir):
    b = domain.raw(spark, sf_dir, "supplier").agg((F.min("s_suppkey") * 10 - 300.0).alias("x0"), (F.max("s_suppkey") * 10 + 300.0).alias("x1"), F.lit(-250.0).alias("z0"), F.lit(250.0).alias("z1"))
    return ingest.lawnmower(b, 60.0, [40.0, 70.0], 4, F.when(c("z") > 0, 2.0).otherwise(0.6))


for name in ("G01_lawnmower_plan", "X05_density_function"):

    @query(name, LAWN + "SELECT round(x, 3) AS x, round(z, 3) AS z, agl, yaw FROM k CROSS JOIN (VALUES (40.0::DOUBLE), (70.0::DOUBLE)) a(agl) CROSS JOIN (VALUES (0.0::DOUBLE), (90.0::DOUBLE), (180.0::DOUBLE), (270.0::DOUBLE)) y(yaw)")
    def lawnmower_plan(spark, sf_dir):
        return lawn(spark, sf_dir).select(r(c("x"), 3).alias("x"), r(c("z"), 3).alias("z"), "agl", "yaw")


RING = """, ring AS (SELECT id, k, lon * 1000 + 80 * sin(k * 2 * pi() / 12) AS px, lat * 1000 + 80 * cos(k * 2 * pi() / 12) AS pz, lon * 1000 AS x, lat * 1000 AS z FROM pois CROSS JOIN range(12) t(k))
"""


def rings_plan(spark, sf_dir):
    points = domain.pois(spark, sf_dir).select("id", (c("lon") * 1000).alias("x"), (c("lat") * 1000).alias("z"))
    return ingest.orbit(points, 80.0, 12, [40.0, 70.0, 100.0])


@query("G02_orbit_plan", with_tables("pois", RING + "SELECT id, CAST(k AS INTEGER) AS k, round(px, 3) AS x, round(pz, 3) AS z, agl FROM ring CROSS JOIN (VALUES (40.0::DOUBLE), (70.0::DOUBLE)) a(agl)"))
def orbit_plan(spark, sf_dir):
    return rings_plan(spark, sf_dir).select("id", "k", r(c("x"), 3).alias("x"), r(c("z"), 3).alias("z"), "agl")


ALLOC = CELLS + """, over AS (SELECT *, p95 - 6 AS excess FROM cells WHERE p95 > 6), w AS (SELECT *, exp(excess / (SELECT max(excess) FROM over)) AS weight FROM over),
t AS (SELECT *, weight / (SELECT sum(weight) FROM w) * 500 AS want FROM w), u AS (SELECT *, CAST(floor(want) AS BIGINT) AS base, round(want - floor(want), 9) AS rest FROM t),
v AS (SELECT *, row_number() OVER (ORDER BY rest DESC, ce, cn) AS rank FROM u)
"""


@query("G03_targeted_allocation", with_tables("preds", ALLOC + "SELECT ce, cn, base + CASE WHEN rank <= 500 - (SELECT sum(base) FROM u) THEN 1 ELSE 0 END AS n FROM v"))
def targeted_allocation(spark, sf_dir):
    """Captures per cell of excess error, 500 in all."""
    p = evaluate.cell_p95(errors(spark, sf_dir), 150.0)
    w = evaluate.excess_weights(p, 6.0, 150.0).select(F.floor(c("e") / 150).alias("ce"), F.floor(c("n") / 150).alias("cn"), "weight")
    return ingest.allocate(w, 500).select("ce", "cn", "n")


@query("G04_random_probes")
def random_probes(spark, sf_dir):
    b = domain.captures(spark, sf_dir).agg(F.min("e").alias("x0"), F.max("e").alias("x1"), F.min("n").alias("z0"), F.max("n").alias("z1"), F.count("*").alias("k"))
    return ingest.probes(b.drop("k"), 400, 7211, 40.0, 100.0)


@query("T03_shuffle_cap")
def shuffle_cap(spark, sf_dir):
    return ingest.shuffled(domain.captures(spark, sf_dir).select("id", "e", "n"), "id", 977, 200)


@query("U06_plan_concat", LAWN + ", p AS (SELECT s_suppkey AS id, CAST(11.32 AS DOUBLE) + s_suppkey * 7919 % 20000 / CAST(1000000 AS DOUBLE) AS lon, CAST(43.31 AS DOUBLE) + s_suppkey * 104729 % 20000 / CAST(1000000 AS DOUBLE) AS lat FROM supplier) SELECT 'grid' AS plan, count(*) * 8 AS n FROM k UNION ALL SELECT 'orbit', count(*) * 24 FROM p")
def plan_concat(spark, sf_dir):
    grid = lawn(spark, sf_dir).select(F.lit("grid").alias("plan"), "x", "z", "agl", "yaw")
    orbit = rings_plan(spark, sf_dir).select(F.lit("orbit").alias("plan"), "x", "z", "agl", "yaw")
    return grid.unionByName(orbit).groupBy("plan").agg(F.count("*").alias("n"))


@query("S01_capture_scan", with_tables("captures", "SELECT id, round(e, 3) AS e, round(ground_up, 4) AS ground_up FROM captures"))
def capture_scan(spark, sf_dir):
    """Capture records as JSON lines, read back with their schema."""
    path = table_path(spark, "captures-json")
    domain.captures(spark, sf_dir).select("id", "e", "n", "u", "heading", "ground_up").write.json(path)
    rows = spark.read.schema("id long, e double, n double, u double, heading double, ground_up double").option("mode", "FAILFAST").json(path)
    return rows.select("id", r(c("e"), 3).alias("e"), r(c("ground_up")).alias("ground_up"))


@query("K12_landmark_save", with_tables("landmarks", "SELECT id, round(e, 3) AS e, len(embedding) AS dims FROM landmarks"))
def landmark_save(spark, sf_dir):
    path = table_path(spark, "landmarks")
    domain.landmarks(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).select("id", r(c("e"), 3).alias("e"), F.size("embedding").cast("long").alias("dims"))


@query("S10_latest_release", with_tables("buildings", "SELECT cls, count(*) AS n FROM buildings WHERE id % 3 = 2 GROUP BY cls"))
def latest_release(spark, sf_dir):
    """The newest release of a hive-partitioned table; only its folders are listed and read."""
    path = table_path(spark, "releases")
    b = domain.buildings(spark, sf_dir).withColumn("release", F.concat(F.lit("2026-0"), (c("id") % 3).cast("string")))
    b.write.partitionBy("release").parquet(path)
    held = spark.read.parquet(path)
    last = held.agg(F.max("release").alias("release"))  # from the folders' names
    return held.join(F.broadcast(last), "release").groupBy("cls").agg(F.count("*").alias("n"))

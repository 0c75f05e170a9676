"""Domain tables derived from the driver tables, as DataFrames and, for the SQL twins, as common table expressions.

Each table is a projection (or one grouping) of one Parquet table, so column pruning and pushed filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(df: DataFrame, column: str) -> DataFrame:
    """Seconds since 1970 of a timestamp column, whatever its kind; zone-free values count as UTC."""
    kind = dict(df.dtypes)[column]
    local = F.col(column) if kind == "timestamp_ntz" else F.to_timestamp_ntz(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    seconds = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)") if kind == "timestamp_ntz" else F.unix_micros(local.cast("timestamp"))
    return df.withColumn("t", seconds / F.lit(1e6))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(raw(spark, sf_dir, "events"), "ts").selectExpr(
        "event_id AS frame_id", "user_id % 8 AS run", "t",
        "CAST(event_id * 37 % 2000 - 1000 AS DOUBLE) AS truth_e", "CAST(event_id * 91 % 2000 - 1000 AS DOUBLE) AS truth_n", "CAST(40 + event_id % 80 AS DOUBLE) AS truth_u",
        "event_id * 37 % 2000 - 1000 + value / 10D AS est_e", "event_id * 91 % 2000 - 1000 - value / 20D AS est_n", "CAST(40 + event_id % 80 + event_id % 7 - 3 AS DOUBLE) AS est_u",
        "CAST(event_id * 13 % 360 AS DOUBLE) AS truth_heading", "CAST((event_id * 13 + event_id % 41 + 340) % 360 AS DOUBLE) AS est_heading",
        "(event_id * 29 % 1000) / 1000D AS confidence", "event_type <> 'error' AS initialized", "event_type = 'error' AS lost", "event_type AS cue", "value",
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id", "embedding", "CAST(vec_id * 73 % 2000 - 1000 AS DOUBLE) AS e", "CAST(vec_id * 179 % 2000 - 1000 AS DOUBLE) AS n",
        "CAST(40 + vec_id % 60 AS DOUBLE) AS u", "CAST(vec_id * 47 % 360 AS DOUBLE) AS heading",
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmarks(spark, sf_dir).selectExpr(
        "id", "e", "n", "u", "heading", "e + id % 17 - 8 AS pe", "n + id % 11 - 5 AS pn", "u + id % 5 - 2 AS pu", "(heading + id % 23 + 349) % 360 AS ph", "CAST(3 + id % 9 AS DOUBLE) AS sigma"
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).selectExpr("frame_id AS id", "run", "t", "truth_e AS e", "truth_n AS n", "truth_u AS u", "truth_heading AS heading", "10 + truth_e * 0.05D AS ground_up")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "11.32D + p_partkey * 7919 % 20000 / 1e6 AS lon", "43.31D + p_partkey * 104729 % 20000 / 1e6 AS lat",
        "CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS height_m", "CASE WHEN p_size % 3 = 0 THEN 'none' ELSE 'tag_height' END AS height_source",
        "CASE WHEN p_type LIKE 'STANDARD%' OR p_type LIKE 'SMALL%' THEN 'residential' WHEN p_type LIKE 'LARGE%' THEN 'industrial' "
        "WHEN p_type LIKE 'PROMO%' THEN 'commercial' WHEN p_type LIKE 'MEDIUM%' THEN 'landmark' ELSE 'generic' END AS cls",
        "CAST(p_size AS BIGINT) AS size",
    )


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "11.32D + s_suppkey * 7919 % 20000 / 1e6 AS lon", "43.31D + s_suppkey * 104729 % 20000 / 1e6 AS lat",
        "CASE s_nationkey % 6 WHEN 1 THEN 'spire_tower' WHEN 2 THEN 'cap_tower' WHEN 3 THEN 'crenellated' WHEN 4 THEN 'crenellated_tower' WHEN 5 THEN 'dome' END AS archetype",
        "concat('Q', s_suppkey) AS wikidata",
    )


def heights_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").selectExpr("concat('Q', s_suppkey) AS wikidata", "CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 97 AS DOUBLE) END AS height")


def cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        raw(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("osm_id"), F.col("l_suppkey"))
        .agg(F.max(F.expr("l_orderkey * 8 + l_linenumber")).alias("seq"))
        .selectExpr("osm_id", "l_suppkey AS part_no", "l_suppkey % 16 AS cell", "seq")
    )


def cells_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_custkey % 400 AS cell", "lower(c_mktsegment) AS kind",
        "CASE c_custkey % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'deferred' WHEN 2 THEN 'failed' WHEN 3 THEN 'fetched' ELSE 'cached' END AS status",
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 3 AS source", "o_orderdate AS at", "o_orderkey AS seq", "o_orderstatus <> 'F' AS ok", "o_totalprice / 50000D AS latency",
        "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS blocked", "o_custkey AS cell",
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey % 10 AS run", "o_totalprice / 1000D AS path_m", "o_totalprice / 1000D * (0.6D + o_orderkey % 40 / 100D) AS straight_m",
        "o_orderstatus <> 'F' AS declared", "o_orderkey % 31 = 0 AS violation", "o_orderkey % 53 = 0 AS collided", "CAST(o_orderkey % 240 AS DOUBLE) AS duration_s",
        "CAST(o_orderkey % 97 AS DOUBLE) AS dist_at_arrival",
    )


def texels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain and building rows on a grid of 120 columns; blocks of 64 rows make a natural partitioning."""
    grid = raw(spark, sf_dir, "orders").selectExpr("o_orderkey div 120 AS row", "o_orderkey % 120 AS col").withColumn("h", F.expr("((row * 73856093) ^ (col * 19349663)) & 65535"))
    return grid.selectExpr(
        "row", "col", "h", "round(20 * sin(row / 17D) + 10 * cos(col / 11D), 3) AS ground", "CAST(CASE WHEN h % 5 = 0 THEN h % 40 ELSE 0 END AS DOUBLE) AS build_h",
        "CASE WHEN h % 13 = 0 THEN 2 WHEN h % 7 = 0 THEN 6 WHEN row % 50 = 0 THEN 4 ELSE 0 END AS class_id",
    )


def ortho_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = texels(spark, sf_dir).withColumn("scene", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    gain = scenes.withColumn("gain", F.expr("CASE scene WHEN 0 THEN 1.0D WHEN 1 THEN 0.8D ELSE 1.15D END"))
    return gain.selectExpr(
        "scene", "row", "col", "(h % 200 + 20) / 255D * gain AS gray", "(h % 180 + 30) / 255D * gain AS r", "(h % 160 + 40) / 255D * gain AS g", "(h % 140 + 20) / 255D * gain AS b",
        "(h + scene * 7) % 11 <> 0 AS valid",
    )


_CLOUDY = "scene <> 1 AND row % 60 < 20 AND col % 60 < 24 AND (scene = 0 OR row % 120 < 60)"
_SHADED = "scene <> 1 AND row % 60 BETWEEN 24 AND 37 AND col % 60 < 24 AND (scene = 0 OR row % 120 < 60)"


def scene_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with clouds, their shadows and bright roofs on textured ground: what masks are extracted from."""
    scenes = texels(spark, sf_dir).withColumn("scene", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    gray = scenes.withColumn("gray", F.expr(
        f"CASE WHEN {_CLOUDY} THEN 0.85D + h % 32 / 640D WHEN {_SHADED} THEN 0.1D + h % 16 / 640D WHEN (row + 7) % 15 < 5 AND col % 20 < 6 THEN 0.55D ELSE 0.3D + h % 64 / 640D END"
    ))
    return gray.selectExpr("scene", "row", "col", "gray", "gray AS r", "CASE WHEN h % 9 = 0 AND gray < 0.5D THEN gray + 0.2D ELSE gray * 0.98D END AS g", "gray * 0.95D AS b", "(h + scene * 7) % 11 <> 0 AS valid")


def view_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raw(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "((o_orderkey div 120 * 73856093) ^ (o_orderkey % 120 * 19349663)) & 65535 AS h")
    return px.selectExpr(
        "k div 3072 AS view_id", "k % 3072 div 64 AS r", "k % 64 AS c",
        "CASE WHEN k % 3072 div 64 < 6 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(5 + h % 400 AS DOUBLE) END AS depth",
        "h % 3 = 0 AND k % 3072 div 64 >= 6 AS building", "h % 13 = 0 AS water", "h % 7 = 0 AS vegetation",
    )


#: The same tables for the SQL twins.
CTE = {
    "frames": """SELECT event_id AS frame_id, user_id % 8 AS run, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t,
      CAST(event_id * 37 % 2000 - 1000 AS DOUBLE) AS truth_e, CAST(event_id * 91 % 2000 - 1000 AS DOUBLE) AS truth_n, CAST(40 + event_id % 80 AS DOUBLE) AS truth_u,
      event_id * 37 % 2000 - 1000 + value / CAST(10 AS DOUBLE) AS est_e, event_id * 91 % 2000 - 1000 - value / CAST(20 AS DOUBLE) AS est_n,
      CAST(40 + event_id % 80 + event_id % 7 - 3 AS DOUBLE) AS est_u,
      CAST(event_id * 13 % 360 AS DOUBLE) AS truth_heading, CAST((event_id * 13 + event_id % 41 + 340) % 360 AS DOUBLE) AS est_heading,
      (event_id * 29 % 1000) / CAST(1000 AS DOUBLE) AS confidence, event_type <> 'error' AS initialized, event_type = 'error' AS lost, event_type AS cue, value FROM events""",
    "landmarks": """SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(vec_id * 73 % 2000 - 1000 AS DOUBLE) AS e, CAST(vec_id * 179 % 2000 - 1000 AS DOUBLE) AS n,
      CAST(40 + vec_id % 60 AS DOUBLE) AS u, CAST(vec_id * 47 % 360 AS DOUBLE) AS heading FROM embeddings""",
    "preds": """SELECT id, e, n, u, heading, e + id % 17 - 8 AS pe, n + id % 11 - 5 AS pn, u + id % 5 - 2 AS pu, (heading + id % 23 + 349) % 360 AS ph, CAST(3 + id % 9 AS DOUBLE) AS sigma FROM landmarks""",
    "captures": """SELECT frame_id AS id, run, t, truth_e AS e, truth_n AS n, truth_u AS u, truth_heading AS heading, 10 + truth_e * CAST(0.05 AS DOUBLE) AS ground_up FROM frames""",
    "buildings": """SELECT p_partkey AS id, CAST(11.32 AS DOUBLE) + p_partkey * 7919 % 20000 / CAST(1000000 AS DOUBLE) AS lon, CAST(43.31 AS DOUBLE) + p_partkey * 104729 % 20000 / CAST(1000000 AS DOUBLE) AS lat,
      CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS height_m, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE 'tag_height' END AS height_source,
      CASE WHEN p_type LIKE 'STANDARD%' OR p_type LIKE 'SMALL%' THEN 'residential' WHEN p_type LIKE 'LARGE%' THEN 'industrial'
      WHEN p_type LIKE 'PROMO%' THEN 'commercial' WHEN p_type LIKE 'MEDIUM%' THEN 'landmark' ELSE 'generic' END AS cls, CAST(p_size AS BIGINT) AS size FROM part""",
    "pois": """SELECT s_suppkey AS id, CAST(11.32 AS DOUBLE) + s_suppkey * 7919 % 20000 / CAST(1000000 AS DOUBLE) AS lon, CAST(43.31 AS DOUBLE) + s_suppkey * 104729 % 20000 / CAST(1000000 AS DOUBLE) AS lat,
      CASE s_nationkey % 6 WHEN 1 THEN 'spire_tower' WHEN 2 THEN 'cap_tower' WHEN 3 THEN 'crenellated' WHEN 4 THEN 'crenellated_tower' WHEN 5 THEN 'dome' END AS archetype,
      concat('Q', s_suppkey) AS wikidata FROM supplier""",
    "heights_dim": """SELECT concat('Q', s_suppkey) AS wikidata, CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 97 AS DOUBLE) END AS height FROM supplier""",
    "cell_features": """SELECT l_partkey AS osm_id, l_suppkey AS part_no, l_suppkey % 16 AS cell, max(l_orderkey * 8 + l_linenumber) AS seq FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "cells_state": """SELECT c_custkey AS id, c_custkey % 400 AS cell, lower(c_mktsegment) AS kind,
      CASE c_custkey % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'deferred' WHEN 2 THEN 'failed' WHEN 3 THEN 'fetched' ELSE 'cached' END AS status FROM customer""",
    "fetch_log": """SELECT o_custkey % 3 AS source, o_orderdate AS at_time, o_orderkey AS seq, o_orderstatus <> 'F' AS ok, o_totalprice / CAST(50000 AS DOUBLE) AS latency,
      o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS blocked, o_custkey AS cell FROM orders""",
    "episodes": """SELECT o_orderkey AS id, o_custkey % 10 AS run, o_totalprice / CAST(1000 AS DOUBLE) AS path_m,
      o_totalprice / CAST(1000 AS DOUBLE) * (CAST(0.6 AS DOUBLE) + o_orderkey % 40 / CAST(100 AS DOUBLE)) AS straight_m, o_orderstatus <> 'F' AS declared,
      o_orderkey % 31 = 0 AS violation, o_orderkey % 53 = 0 AS collided, CAST(o_orderkey % 240 AS DOUBLE) AS duration_s, CAST(o_orderkey % 97 AS DOUBLE) AS dist_at_arrival FROM orders""",
    "texels": """SELECT row, col, h, round(20 * sin(row / CAST(17 AS DOUBLE)) + 10 * cos(col / CAST(11 AS DOUBLE)), 3) AS ground, CAST(CASE WHEN h % 5 = 0 THEN h % 40 ELSE 0 END AS DOUBLE) AS build_h,
      CASE WHEN h % 13 = 0 THEN 2 WHEN h % 7 = 0 THEN 6 WHEN row % 50 = 0 THEN 4 ELSE 0 END AS class_id
      FROM (SELECT o_orderkey // 120 AS row, o_orderkey % 120 AS col, xor(o_orderkey // 120 * 73856093, o_orderkey % 120 * 19349663) & 65535 AS h FROM orders)""",
    "ortho_px": """SELECT scene, row, col, (h % 200 + 20) / CAST(255 AS DOUBLE) * gain AS gray, (h % 180 + 30) / CAST(255 AS DOUBLE) * gain AS r, (h % 160 + 40) / CAST(255 AS DOUBLE) * gain AS g,
      (h % 140 + 20) / CAST(255 AS DOUBLE) * gain AS b, (h + scene * 7) % 11 <> 0 AS valid
      FROM texels CROSS JOIN (VALUES (0, CAST(1 AS DOUBLE)), (1, CAST(0.8 AS DOUBLE)), (2, CAST(1.15 AS DOUBLE))) s(scene, gain)""",
    "scene_px": f"""SELECT scene, row, col, gray, gray AS r, CASE WHEN h % 9 = 0 AND gray < CAST(0.5 AS DOUBLE) THEN gray + CAST(0.2 AS DOUBLE) ELSE gray * CAST(0.98 AS DOUBLE) END AS g, gray * CAST(0.95 AS DOUBLE) AS b, (h + scene * 7) % 11 <> 0 AS valid
      FROM (SELECT *, CASE WHEN {_CLOUDY} THEN CAST(0.85 AS DOUBLE) + h % 32 / CAST(640 AS DOUBLE) WHEN {_SHADED} THEN CAST(0.1 AS DOUBLE) + h % 16 / CAST(640 AS DOUBLE)
        WHEN (row + 7) % 15 < 5 AND col % 20 < 6 THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) + h % 64 / CAST(640 AS DOUBLE) END AS gray FROM texels CROSS JOIN (VALUES (0), (1), (2)) s(scene))""",
    "view_px": """SELECT k // 3072 AS view_id, k % 3072 // 64 AS r, k % 64 AS c,
      CASE WHEN k % 3072 // 64 < 6 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(5 + h % 400 AS DOUBLE) END AS depth,
      h % 3 = 0 AND k % 3072 // 64 >= 6 AS building, h % 13 = 0 AS water, h % 7 = 0 AS vegetation
      FROM (SELECT o_orderkey AS k, xor(o_orderkey // 120 * 73856093, o_orderkey % 120 * 19349663) & 65535 AS h FROM orders)""",
}
_NEEDS = {"preds": ["landmarks"], "captures": ["frames"], "ortho_px": ["texels"], "scene_px": ["texels"]}


def with_tables(names: str, body: str) -> str:
    """``body`` behind the common table expressions it reads; ``body`` may begin with further ones (", x AS (...)")."""
    order: list[str] = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    head = "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head}\n{body}"

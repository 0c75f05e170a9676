"""What must not grow with the input: broadcasts, groups in one task, rounds, pairs."""

import contextlib
import io

from pyspark.sql import functions as F

from skylattice.operators import imagery, rasters, retrieval, shadows
from skylattice.plans import features, streams
from skylattice.plans import imagery as plans
from skylattice.plans import rasters as rasters_plans
from skylattice.plans import retrieval as retrieval_plans


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_rays_are_not_broadcast(spark, sf_dir):
    """Forty steps of every building, which the planner counts as one row each."""
    assert "Broadcast" not in plan(plans.rays(spark, sf_dir))


def test_cast_rays_are_not_broadcast(spark):
    b = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}]], None)], "id long, rings array<array<struct<x: double, y: double>>>, height_m double")
    px = spark.range(4).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(0.5).alias("gray"))
    assert "Broadcast" not in plan(shadows.shadow_rays(shadows.outlines(b, "id", "rings"), px, "id", plans.SUN, 2.5))


def test_tiles_meet_bounds_by_a_broadcast_of_the_bounds(spark, sf_dir):
    """A row per scene is sent; pixels are neither sent nor dealt by their scene."""
    for query in (plans.depth_hook, plans.mask_hook):
        found = plan(query(spark, sf_dir))
        assert "BroadcastHashJoin [scene" in found and "BuildLeft" not in found and "SortMergeJoin" not in found


def test_pairs_stay_in_the_task_that_meets_them(spark, sf_dir):
    """No join makes a row per pair of a query and a row; more rows make more blocks, and equal vectors go by id."""
    for query in (retrieval_plans.hard_triplets, retrieval_plans.nearest_pose, retrieval_plans.top):
        found = plan(query(spark, sf_dir))
        assert "FlatMapGroupsInPandas" in found and "Join" not in found
    v = [[1.0, 0.0], [1.0, 0.0], None, [0.5, 0.5], [1.0, None], [1.0, 0.0], [float("nan"), 0.0]]
    rows = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<float>")
    got = retrieval.top_k(rows.where("id in (0, 2)"), rows, 3).orderBy("query", "rank").select("query", "id", "sim").collect()
    assert [r["id"] for r in got] == [6, 1, 5, 0, 1, 3]
    assert [r["sim"] for r in got[1:]] == [1.0, 1.0, None, None, None]


def test_flights_pass_through_a_task_in_batches(spark, sf_dir):
    """No flight is held as a whole, and batches of any size give the same."""
    for query in (streams.error_state_filter, streams.particle_filter):
        found = plan(query(spark, sf_dir))
        assert "MapInPandas" in found and "FlatMapGroups" not in found
        want = sorted(map(tuple, query(spark, sf_dir).collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            assert sorted(map(tuple, query(spark, sf_dir).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_places_are_matched_once(spark, sf_dir):
    """Many buildings at one place are one side of one pair."""
    many = spark.range(1000).select("id", F.lit(1.0).alias("e"), F.lit(2.0).alias("n"))
    assert features.places(many).count() == 1


def test_clusters_move_by_distinct_values(spark):
    """Rounds read each distinct value once, and weigh it by its rows."""
    px = spark.range(3000).select(F.lit(0).alias("scene"), F.when(F.col("id") < 2000, 0.1).when(F.col("id") < 2999, 0.2).otherwise(0.9).alias("r"))
    out = imagery.kmeans(px, ["scene"], ["r"], 2).groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect()
    assert [r["n"] for r in out] == [2999, 1] or [r["n"] for r in out] == [2000, 1000]


def test_rings_in_tiles_are_those_of_one_ring_at_a_time(spark):
    """A strip with two zones at its ends and one aside is filled by few passes, as by single rings."""
    rows = [(0, r, k, {(0, 0): 1, (39, 2): 0, (20, 1): 2}.get((r, k))) for r in range(40) for k in range(3) if (r, k) != (30, 1)]
    zone = {(r, k): z for _, r, k, z in rows}
    while None in zone.values():
        new = {}
        for (r, k), z in zone.items():
            near = [zone.get(p) for p in ((r + 1, k), (r - 1, k), (r, k + 1), (r, k - 1)) if zone.get(p) is not None]
            if z is None and near:
                new[r, k] = min(set(near), key=lambda x: (-near.count(x), x))
        zone |= new
    label, passes = spark.createDataFrame(rows, "scene int, br long, bc long, zone int"), 0
    while label.where("zone is null").count():
        label, passes = spark.createDataFrame(imagery.rings(label, 8).collect(), label.schema), passes + 1
    assert {(r["br"], r["bc"]): r["zone"] for r in label.collect()} == zone and passes <= 3


def test_shapes_list_their_own_texels(spark, sf_dir):
    """Texels of a block are not paired with all shapes of it."""
    found = plan(rasters_plans.burnt(spark, sf_dir))
    assert "LeftSemi" in found and "Inner" not in found


def test_cloud_mask_is_one_pass_over_tiles(spark, sf_dir, monkeypatch):
    """Pixels are dealt once (beside the counts of the median), and the size of the tiles changes nothing, with gaps in the
    raster and unknown values as well."""
    assert plan(plans.cloud_mask(spark, sf_dir)).count("Exchange hashpartitioning") <= 2
    row, col = F.col("row"), F.col("col")
    gray = F.when((row % 90 < 30) & (col % 110 < 40), 0.85).when((row % 90 > 45) & (row % 90 < 60), 0.1).otherwise(0.3 + F.pmod(F.xxhash64("row", "col"), F.lit(64)) / 640)
    px = spark.range(240 * 230).select(F.floor(F.col("id") / 230).alias("row"), (F.col("id") % 230).alias("col")).where(F.pmod(F.xxhash64("col", "row"), F.lit(37)) > 0)
    px = px.withColumn("gray", F.when(F.pmod(F.xxhash64("row", "col"), F.lit(101)) > 0, gray)).selectExpr("0 as scene", "row", "col", "gray", "gray as r", "gray * 0.98 as g", "gray * 0.95 as b")
    found = []
    for size in (512, 1):  # 1: tiles of as many pixels as the windows reach
        monkeypatch.setattr(rasters, "TILE", size)
        found.append(sorted(map(tuple, imagery.cloud_mask(px, 10.0).collect())))
    assert found[0] == found[1] and len(found[0]) == px.count() and 0 < sum(bool(x[3]) for x in found[0]) < len(found[0]) and any(x[4] for x in found[0])


def test_streams_are_written_in_slices(spark, sf_dir, monkeypatch):
    """No file of a stream holds more than a slice, slices follow each other in time, and joins lose nothing between them."""
    rows = streams.sensor_rows(spark, sf_dir)
    n = rows.count()
    monkeypatch.setattr(streams, "ROWS", n // 7 + 1)
    paths = []
    made = streams.table_path
    monkeypatch.setattr(streams, "table_path", lambda spark, kind: paths.append((kind, made(spark, kind))) or paths[-1][1])
    got = [tuple(x) for x in streams.stream_join(spark, sf_dir).select("frame_id").collect()]
    assert sorted(got) == [(k,) for k in sorted(x.frame_id for x in streams.truth_rows(spark, sf_dir).collect())]
    files = [p for kind, p in paths if kind == "stream"]
    for path in files:
        held = spark.read.parquet(path).groupBy(F.input_file_name().alias("f"), F.input_file_name().alias("x")).agg(F.count("*").alias("k"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
        assert len(held) >= 7 and max(r.k for r in held) < n // 3 and all(x.b < y.a for x, y in zip(held, held[1:]))
    rows = streams.sensor_rows(spark, sf_dir).repartition(5)  # an unordered stream keeps the partitions that rows come in
    before = len(paths)
    assert streams.as_stream(spark, rows).isStreaming and len(spark.read.parquet(paths[before][1]).inputFiles()) == 5

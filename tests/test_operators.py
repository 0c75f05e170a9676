"""Operators without an exact SQL twin, and golden or property checks of the others."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice import registry
from skylattice.functions import features, geo, sky
from skylattice.operators import imagery, ingest, retrieval, saliency, vectors
from skylattice.operators.graph import connected_components, grid_components
from skylattice.sources import domain
from skylattice.streaming import flight


def test_geodetic_round_trip(spark):
    rows = spark.createDataFrame([(float(e), float(n), float(u)) for e in (-9000, 0, 700) for n in (-8000, 5, 9000) for u in (-20, 300)], "e double, n double, u double")
    lat, lon, alt = geo.enu_to_geodetic(F.col("e"), F.col("n"), F.col("u"), 47.5, 19.04, 120.0)
    back = rows.select("e", "n", "u", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))
    x, y, z = geo.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), 47.5, 19.04, 120.0)
    for r in back.select("e", "n", "u", x.alias("x"), y.alias("y"), z.alias("z")).collect():
        assert max(abs(r.e - r.x), abs(r.n - r.y), abs(r.u - r.z)) < 1e-5


def test_frames_and_angles(spark):
    one = spark.range(1)
    e, n, _ = geo.sim_to_enu(F.lit(0.0), F.lit(0.0), F.lit(1.0), 90.0)
    r = one.select(e.alias("e"), n.alias("n"), geo.wrap_deg(F.lit(540.0)).alias("w"), geo.heading_deg(F.lit(-1.0), F.lit(0.0)).alias("h")).first()
    assert abs(r.e - 1) < 1e-12 and abs(r.n) < 1e-12 and r.w == 180 and r.h == 270
    back = geo.enu_to_sim(*geo.sim_to_enu(F.lit(3.0), F.lit(4.0), F.lit(5.0), 33.0), 33.0)
    assert np.allclose(list(one.select(*back).first()), [3, 4, 5])


def test_sun_at_known_times(spark):
    """Overhead at the equator at an equinox noon; the pole's midsummer height is the earth's tilt; due south at a northern noon."""
    seconds = lambda t: F.lit(pd.Timestamp(t, tz="UTC").timestamp())
    one = spark.range(1)
    get = lambda t, lat, lon: one.select(*[x.alias(k) for k, x in zip("ae", sky.sun(seconds(t), F.lit(lat), F.lit(lon)))]).first()
    assert get("2024-03-20 12:07:30", 0.0, 0.0).e > 89.5
    assert abs(get("2024-06-20 20:51:00", 89.9, 0.0).e - 23.44) < 0.2
    noon = get("2024-12-21 11:58:00", 50.0, 0.0)
    assert abs(noon.a - 180) < 1 and abs(noon.e - (90 - 50 - 23.44)) < 0.3
    assert one.select(sky.julian_day(F.lit(946728000.0))).first()[0] == 2451545.0


def test_known_square(spark):
    zone, band, square = geo.mgrs(F.lit(47.5), F.lit(19.04))
    assert tuple(spark.range(1).select(zone, band, square).first()) == (34, "T", "CT")


def test_components_of_hubs_and_chains(spark):
    edges = [(5000, k) for k in range(600)] + [(k, 7000) for k in range(1000, 1600)] + [(9000 + k, 9001 + k) for k in range(70)] + [(3, 3), (None, 4), (1, 5000)]
    df = spark.createDataFrame(edges, "a long, b long")
    of = {r.node: r.component for r in connected_components(df).collect()}
    assert of == {**{k: 0 for k in [*range(600), 5000]}, **{k: 1000 for k in [*range(1000, 1600), 7000]}, **{9000 + k: 9000 for k in range(71)}}
    assert connected_components(df.where("false")).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(df, rounds=2)


def test_element_parsing(spark, tmp_path):
    ring = [{"lat": a, "lon": b} for a, b in ((1, 1), (1, 2), (2, 2), (1, 1))]
    doc = {
        "elements": [
            {"type": "way", "id": 1, "tags": {"building": "tower", "height": "55"}, "geometry": ring},
            {"type": "way", "id": 2, "tags": {"building": "yes"}, "geometry": ring},
            {"type": "relation", "id": 3, "tags": {"building": "house", "building:levels": "3"}, "members": [{"type": "way", "role": "outer", "geometry": ring}, {"type": "way", "role": "inner", "geometry": ring}]},
            {"type": "way", "id": 4, "tags": {"highway": "secondary", "bridge": "yes"}, "geometry": ring[:2]},
            {"type": "way", "id": 5, "tags": {"natural": "wood", "leaf_type": "needleleaved"}, "geometry": ring},
            {"type": "way", "id": 6, "tags": {"natural": "water"}, "geometry": ring[:3]},
            {"type": "node", "id": 7, "lat": 5.0, "lon": 6.0, "tags": {"man_made": "tower", "name": "T"}},
            {"type": "way", "id": 8, "tags": {"building:part": "yes", "height": "18", "building:min_level": "2"}, "geometry": ring},
            {"type": "node", "id": 9, "lat": 5.0, "lon": 6.0},
        ]
    }
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=1))
    el = vectors.read_elements(spark, str(path), multi_line=True)
    b = {(r.osm_id, r.cls, r.height_m, r.height_source, len(r.holes)) for r in vectors.parse_buildings(el).collect() if r.osm_id != 8}
    assert b == {(1, "landmark", 55.0, "tag_height", 0), (2, "generic", None, "none", 0), (3, "residential", 9.0, "tag_levels", 1)}
    land = sorted((r.osm_id, r.kind, r.width_m) for r in vectors.parse_landcover(el).where("osm_id in (4, 5, 6)").collect())
    assert land == [(4, "bridge", 10.0), (4, "road", 8.0), (5, "forest_conifer", None)]
    assert [(r.id, r.archetype, r.lon) for r in vectors.parse_pois(el).orderBy("id").collect()] == [(1, "spire_tower", 1.5), (7, "spire_tower", 6.0)]
    assert [(r.id, r.height_m, r.min_m) for r in vectors.parse_parts(el).collect()] == [(8, 18.0, 6.0)]


def test_particles_follow(spark):
    r = np.random.default_rng(2)
    rows = [(0, k, float(k), 2.0 * k + r.normal() * 5, r.normal() * 5, 0.0, 0.0, 5.0, 0.0) for k in range(80)]
    df = spark.createDataFrame(rows, "drone long, frame_id long, t double, est_e double, est_n double, est_u double, est_heading double, sigma double, altitude double")
    a, b = (flight.particle_flights(df, seed=7).toPandas().sort_values("frame_id") for _ in range(2))
    assert a.equals(b)
    assert np.abs(a.e - 2.0 * a.frame_id).tail(30).mean() < 8
    picked = flight.resample(np.array([0.0, 0.5, 0.25, 0.25]), 0.5)
    assert np.bincount(picked, minlength=4).tolist() == [0, 2, 1, 1]


def test_constellation(spark):
    p = [(0.0, 0.0), (10.0, 0.0), (0.0, 20.0), (15.0, 15.0)]
    sets = [(1, 1, p, p), (1, 2, p, [(3 * x + 5, 3 * y - 2) for x, y in p]), (1, 3, p, [(0.0, 0.0)]), (2, 1, p[:1], p)]
    rows = [(q, h, side, x, y) for q, h, a, b in sets for side, pts in ((0, a), (1, b)) for x, y in pts]
    got = {(r["query"], r.hypothesis): r.score for r in imagery.constellation_scores(spark.createDataFrame(rows, "query long, hypothesis long, side int, x double, y double")).collect()}
    assert got[(1, 1)] > 0.99 and got[(1, 2)] > 0.99 and got[(1, 3)] == 0.0 and got[(2, 1)] == 0.5


def test_zones_absorb_and_normalize(spark):
    made = [(0, row, col, (0.5 if col < 48 else 0.8) * (0.9 + 0.2 * ((row * 7 + col * 13) % 10) / 10), True) for row in range(48) for col in range(96)]
    px = spark.createDataFrame(made, "scene int, row long, col long, gray double, valid boolean").withColumn("r", F.col("gray")).withColumn("g", F.col("gray")).withColumn("b", F.col("gray"))
    from skylattice.operators.rasters import block_stats

    stats = block_stats(px, 16)
    near = stats.select("scene", "br", "bc", "mid")
    other = near.select("scene", F.col("br").alias("nr"), F.col("bc").alias("nc"), F.col("mid").alias("omid"))
    edges = near.join(other, "scene").where("abs(br - nr) + abs(bc - nc) = 1 and abs(mid - omid) < 0.05")
    z = imagery.zones(stats, edges, 3)
    assert z.select("zone").distinct().count() == 2
    even = imagery.normalize_zones(px, z, 16).groupBy((F.col("col") < 48).alias("left")).agg(F.median("gray").alias("m")).collect()
    assert abs(even[0].m - even[1].m) < 0.05


def test_rigid_fit_ignores_outliers(spark):
    s, c = math.sin(0.3), math.cos(0.3)
    rows = [(1, k, float(k % 17), float(k % 11), c * (k % 17) - s * (k % 11) + 4 + (50 if k % 9 == 0 else 0), s * (k % 17) + c * (k % 11) - 1) for k in range(200)]
    fit = imagery.rigid_fit(spark.createDataFrame(rows, "pair long, id long, x double, y double, u double, v double")).first()
    assert abs(fit.turn_deg - math.degrees(0.3)) < 1e-6 and abs(fit.de - 4) < 1e-6 and abs(fit.dn + 1) < 1e-6


def test_peaks_are_apart(spark):
    t = spark.range(3600).selectExpr("id div 60 AS row", "id % 60 AS col", "CAST(id * 7919 % 97 AS DOUBLE) AS build_h")
    got = saliency.separated_peaks(t, 12, 8.0).collect()
    assert len(got) == 12 and max(r.build_h for r in got) == 96.0
    assert all(math.dist((a.row, a.col), (b.row, b.col)) > 8 for i, a in enumerate(got) for b in got[:i])


def test_components(spark):
    got = connected_components(spark.createDataFrame([(5, 6), (6, 7), (1, 2), (9, 9), (None, 1)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (5, 5), (6, 5), (7, 5)]
    grid = grid_components(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5), (0, 9), (1, 0)], "row long, col long"), 10)
    assert {(r.row, r.col): r.component for r in grid.collect()} == {(0, 0): 0, (0, 1): 0, (1, 1): 0, (1, 0): 0, (5, 5): 55, (0, 9): 9}


@pytest.mark.parametrize("total", [1, 7, 500])
def test_allocation_adds_up(spark, total):
    cells = spark.createDataFrame([(0, k, float(k * k % 7)) for k in range(20)], "ce long, cn long, weight double")
    assert ingest.allocate(cells, total).agg(F.sum("n")).first()[0] == total


def test_numbering(spark):
    rows = spark.range(5000).selectExpr("id * id AS k")
    got = ingest.numbered(rows, ["k"], 100).orderBy("k").collect()
    assert [r["index"] for r in got] == list(range(100, 5100)) and got[600].shard == 700 // 512 and got[600].pos == 700 % 512


def test_wide_tiles_are_refused(spark):
    box = spark.createDataFrame([(10.0, 10.0, 11.0, 11.0)], "south double, west double, north double, east double")
    with pytest.raises(Exception, match="too many tiles"):
        ingest.web_tiles(box, 15).count()


def test_empty_inputs(spark):
    marks = spark.createDataFrame([], "id long, embedding array<float>, e double, n double, u double, heading double")
    assert retrieval.top_k(marks, marks, 3).count() == 0 and retrieval.positive_pairs(marks, 10.0, 5.0).count() == 0
    assert spark.createDataFrame([("",), (None,), ("abc",)], "t string").select(features.leading_number(F.col("t")).alias("x")).where("x is not null").count() == 0


@pytest.mark.parametrize("name", ["A36_colour_clusters", "A37_chromaticity_clusters"])
def test_clusters_of_every_scene(spark, sf_dir, name):
    got = {}
    for x in registry.queries()[name](spark, sf_dir).collect():
        got[x.scene] = got.get(x.scene, 0) + x.n
    assert got == {x.scene: x["count"] for x in domain.ortho_px(spark, sf_dir).groupBy("scene").count().collect()}


def grid(spark, gray, rgb=None, valid=None, scene=0):
    """A raster table of arrays."""
    rgb = np.stack([gray] * 3, -1) if rgb is None else rgb
    r, c = np.indices(gray.shape)
    table = pd.DataFrame({"scene": scene, "row": r.ravel(), "col": c.ravel(), "gray": gray.ravel(), "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel()})
    table["valid"] = True if valid is None else valid.ravel()
    return spark.createDataFrame(table).withColumn("scene", F.col("scene").cast("int"))


def pixels(df, flag, shape):
    found = np.zeros(shape, dtype=bool)
    for x in df.where(flag).select("row", "col").collect():
        found[x.row, x.col] = True
    return found


def test_clouds_and_their_shadows(spark):
    """A soft cloud and its shadow 300 m away are found, over textured ground with a lone dark field far off any cloud."""
    rng = np.random.default_rng(0)
    gray = 0.32 + rng.normal(size=(150, 150)) * 0.01
    cloud, shadow = np.zeros(gray.shape, bool), np.zeros(gray.shape, bool)
    cloud[30:60, 30:65], shadow[62:92, 40:75] = True, True
    gray[cloud], gray[shadow] = 0.86, 0.12
    got = imagery.cloud_mask(grid(spark, gray), 10.0)
    found_cloud, found_shadow = pixels(got, "cloud", gray.shape), pixels(got, "shadow", gray.shape)
    assert found_cloud[cloud].mean() > 0.95 and found_shadow[shadow].mean() > 0.85
    far = ~(found_cloud | found_shadow)
    near = np.zeros(gray.shape, bool)
    near[20:102, 20:85] = True
    assert far[~near].mean() > 0.95
    overcast = np.full((60, 60), 0.9) + rng.normal(size=(60, 60)) * 0.005
    assert pixels(imagery.cloud_mask(grid(spark, overcast), 10.0), "cloud", overcast.shape).mean() > 0.9
    dark = np.full((60, 60), 0.32)
    dark[20:40, 20:40] = 0.1
    assert not pixels(imagery.cloud_mask(grid(spark, dark), 10.0), "shadow", dark.shape).any()


def test_roofs_in_strips_of_other_exposure(spark):
    gray = 0.3 + np.random.default_rng(1).normal(size=(80, 80)) * 0.004
    roofs = np.zeros(gray.shape, bool)
    for at in ((10, 10), (10, 50), (50, 20)):
        roofs[at[0] : at[0] + 6, at[1] : at[1] + 6] = True
    gray[roofs] = 0.6
    gray[:, 40:] *= 0.7
    valid = np.ones(gray.shape, bool)
    valid[50:56, 20:26] = False
    got = pixels(imagery.roof_mask(grid(spark, gray, valid=valid), 2.0), "roof", gray.shape)
    assert got[10:16, 10:16].mean() > 0.6 and got[10:16, 50:56].mean() > 0.6 and not got[50:56, 20:26].any()
    assert got[~roofs].mean() < 0.05


def test_zones_of_strips(spark):
    """Three strips of other gain are three zones, tiny ones are absorbed, and the correction takes the seams away."""
    from skylattice.operators import rasters

    rng = np.random.default_rng(2)
    base = 0.4 + rng.normal(size=(96, 96)) * 0.02
    gain = np.repeat([1.0, 0.72, 1.25], [48, 24, 24])
    rgb = np.stack([base, base * 0.95, base * 0.9], -1) * gain[None, :, None]
    gray = rgb @ np.array([0.299, 0.587, 0.114])
    gray[0:8, 0:8], rgb[0:8, 0:8] = 0.95, 0.95  # one odd block
    px = grid(spark, gray, rgb)
    stats = rasters.block_stats(px, 8)
    zoned = imagery.zones(stats, rasters.like_blocks(stats), 0.02)
    found = {(x.br, x.bc): (x.zone, x.zone_blocks) for x in zoned.collect()}
    assert len(found) == 144 and {z for z, _ in found.values()} == {0, 1, 2} and found[(0, 0)][0] == found[(5, 2)][0] == 0
    assert found[(5, 7)][0] != found[(5, 10)][0]
    even = imagery.normalize_zones(px, zoned, 8).toPandas()
    means = [even[(even.col >= a) & (even.col < b) & (even.row >= 16)].gray.mean() for a, b in ((0, 48), (48, 72), (72, 96))]
    assert max(means) - min(means) < 0.01
    assert abs(even.r.mean() / even.b.mean() - 1 / 0.9) < 0.05


@pytest.mark.parametrize("whole", [50_000, 100])
def test_exact_quantiles(spark, whole, monkeypatch):
    from skylattice.operators import quantiles
    from skylattice.operators.quantiles import exact_quantiles

    monkeypatch.setattr(quantiles, "WHOLE", whole)  # large groups, and what crowds in one of their ranges
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"k": rng.integers(0, 4, 3000), "v": np.where(rng.random(3000) < 0.4, 7.5, rng.lognormal(size=3000) * 100)})
    table.loc[table.k == 3, "v"] = 2.0
    df = spark.createDataFrame(table).unionByName(spark.createDataFrame([(0, None), (9, None)], "k long, v double"))
    wanted = {"a": 0.0, "b": 0.5, "c": 0.937, "d": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, values in table.groupby("k").v:
        assert np.allclose([got[k][name] for name in wanted], np.quantile(values, list(wanted.values())))
    whole = exact_quantiles(df, [], "v", {"mid": 0.5}).collect()
    assert np.allclose(whole[0].mid, np.median(table.v)) and exact_quantiles(df.where("false"), [], "v", {"mid": 0.5}).count() == 0


def test_hook_does_not_depend_on_tiles(spark):
    from skylattice.operators import imagery
    from skylattice.plans.imagery import smooth_depth

    r = np.random.default_rng(6)
    gray = r.random((100, 90)) * (r.random((100, 90)) < 0.8)
    px = spark.createDataFrame([(0, i + 5, j + 40, float(gray[i, j])) for i in range(100) for j in range(90) if gray[i, j]], "scene int, row long, col long, gray double")
    want = smooth_depth(gray)
    for size in (32, 64, 25):
        got = {(x.row - 5, x.col - 40): x.depth for x in imagery.tiles_through(px, smooth_depth, "depth", size).collect()}
        assert len(got) == (gray > 0).sum() and all(abs(v - want[at]) < 1e-12 for at, v in got.items())
    assert imagery.tiles_through(px, None, "depth", 32).where("not isnan(depth)").count() == 0


def test_quantiles_of_values_that_crowd_in_a_sliver(spark):
    """99 % of the values lie in a millionth of the span: ranges still hold about as many distinct values each."""
    from skylattice.operators import quantiles

    rng = np.random.default_rng(5)
    values = np.where(rng.random(60_000) < 0.99, 1000 + rng.random(60_000), rng.random(60_000) * 1e6)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    wanted = {"a": 0.003, "b": 0.5, "c": 0.95, "d": 0.999}
    got = quantiles.exact_quantiles(df, [], "v", wanted).first()
    assert np.allclose([got[k] for k in wanted], np.quantile(values, list(wanted.values())))
    kinds = len(set(values))
    near = df.select(F.lit(0).alias("g"), F.col("v").alias("__v"), F.lit(1).cast("long").alias("__k"), F.lit(kinds).alias("__kinds"))
    for sample in (quantiles.SAMPLE, 12_000):  # also where the sample is a small part
        quantiles.SAMPLE, kept = sample, quantiles.SAMPLE
        try:
            in_part = [r["count"] for r in quantiles.parts(near, ["g"]).groupBy("__part").count().collect()]
            got = quantiles.exact_quantiles(df, [], "v", wanted).first()
        finally:
            quantiles.SAMPLE = kept
        assert len(in_part) >= 0.98 * quantiles.PARTS and max(in_part) <= (2 if sample == kept else 3) * kinds / quantiles.PARTS
        assert np.allclose([got[k] for k in wanted], np.quantile(values, list(wanted.values())))


def test_clusters(spark):
    """Three colours of two scenes are found, the most frequent first; shades of one material are one chromatic cluster."""
    rng = np.random.default_rng(4)
    rows = []
    for scene in (0, 1):
        for n, colour in ((300, (0.2, 0.3, 0.8)), (200, (0.8, 0.7, 0.2)), (100, (0.1, 0.8, 0.3))):
            rows += [(scene, *[float(x) for x in np.array(colour) + rng.normal(size=3) * 0.01]) for _ in range(n)]
    df = spark.createDataFrame(rows, "scene int, r double, g double, b double")
    got = imagery.kmeans(df, ["scene"], ["r", "g", "b"], 3).groupBy("scene", "cluster").agg(F.count("*").alias("n"), F.avg("b").alias("b")).collect()
    assert sorted((x.scene, x.cluster, x.n) for x in got) == [(s, k, n) for s in (0, 1) for k, n in enumerate((300, 200, 100))]
    assert all(abs(x.b - (0.8, 0.2, 0.3)[x.cluster]) < 0.02 for x in got)
    shades = spark.createDataFrame([(0, 0.6 * f, 0.3 * f, 0.1 * f) for f in np.linspace(0.5, 1, 50).tolist()] + [(0, 0.1, 0.1, 0.8)] * 10, "scene int, r double, g double, b double")
    total = F.col("r") + F.col("g") + F.col("b")
    chrom = shades.withColumn("x", F.col("r") / total).withColumn("y", F.col("g") / total)
    assert sorted(r["count"] for r in imagery.kmeans(chrom, ["scene"], ["x", "y"], 2).groupBy("cluster").count().collect()) == [10, 50]
    assert imagery.kmeans(df.where("false"), ["scene"], ["r"], 2).count() == 0


def test_view_agreement(spark):
    """A view agrees with itself; where depth is unknown the outlines and the sky decide."""
    px = [(0, r, c, float("inf") if r < 4 else 10.0 + r, r >= 4 and c < 8, r == 15, False) for r in range(16) for c in range(16)]
    df = spark.createDataFrame(px, "view_id long, r long, c long, depth double, building boolean, water boolean, vegetation boolean")
    side = lambda k, d=F.col("depth"): df.select("view_id", "r", "c", d.alias(f"{k}_depth"), *[F.col(x).alias(f"{k}_{x}") for x in ("building", "water")])
    same = imagery.view_alignment(side("a").join(side("b"), ["view_id", "r", "c"])).first()
    assert abs(same.score - 1) < 1e-9 and same.depth == 1
    off = imagery.view_alignment(side("a").join(side("b", F.col("depth") * 1.25), ["view_id", "r", "c"])).first()
    assert abs(off.depth - 0.5) < 1e-9 and abs(off.score - (0.4 + 0.25 * 0.5 + 0.15 + 0.2)) < 1e-9
    d = np.array(imagery.view_descriptor(df, 16, 16).first().descriptor)
    assert len(d) == 36 and abs((d * d).sum() - 1) < 1e-9 and d[20:28].min() == d[20:28].max() > 0 and not d[28:].any()

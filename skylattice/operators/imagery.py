"""Imagery statistics: clouds, zones, roofs, palettes, shadows, views, flow fits, and hooks for caller's models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from skylattice.functions import raster
from skylattice.operators import rasters, tiles
from skylattice.operators.graph import connected_components, written
from skylattice.operators.quantiles import exact_quantiles


#: Fixed values of the cloud test: least brightness, largest channel spread, and the drop below the scene that is shadow.
CLOUD_LUM, CLOUD_SURE, CLOUD_SPREAD, SHADOW_DROP = 0.60, 0.72, 0.16, 0.62


def cloud_mask(px: DataFrame, res: float) -> DataFrame:
    """Cloud and shadow pixels of each scene (``res``: metres a pixel).

    Clouds are bright against the scene's median and hardly coloured; texture speaks against all but the brightest.
    Shadows are dark against the median and lie within 1200 m of a cloud. Both are opened, then grown by 30 m or five
    pixels. Windows are squares. All of them are computed in one pass over tiles that see as far as they reach together.
    """
    odd = lambda m, least: max(least, int(m / res) | 1)
    mid = exact_quantiles(px, ["scene"], "gray", {"mid": 0.5})
    rows = px.join(F.broadcast(mid), "scene")  # a row per scene
    g, wide = F.col("gray"), F.round(F.greatest("r", "g", "b") - F.least("r", "g", "b"), 9)
    bright = F.round(g - F.greatest(F.lit(CLOUD_LUM), F.least(F.col("mid") + 0.15, F.lit(CLOUD_SURE))), 9) > 0
    shadow = (F.round(g - F.col("mid") * SHADOW_DROP, 9) < 0) & (wide < CLOUD_SPREAD + 0.06)
    flag = lambda x: F.coalesce(F.when(x, tiles.YES).otherwise(F.when(~x, tiles.NO)), F.lit(tiles.UNKNOWN)).cast("byte")
    flags = [flag(x).alias(k) for k, x in (("bright", bright & (wide < CLOUD_SPREAD)), ("sure", g > CLOUD_SURE), ("shadow", shadow))]
    rows = rows.select("scene", "row", "col", g.cast("double").alias("gray"), *flags)
    weights, texture, grow, near = rasters.gaussian(max(1.0, 2.0 / res)), 4, odd(30.0, 11) // 2, odd(1200.0, 3) // 2

    def found(table: pa.Table) -> pa.Table:
        row, col, gray, bright, sure, shadow = (table[k].to_numpy() for k in ("row", "col", "gray", "bright", "sure", "shadow"))
        tile, state = tiles.Tile(row, col), lambda unknown, yes: np.where(unknown, tiles.UNKNOWN, np.where(yes, tiles.YES, tiles.NO))
        edge = tile.edges(tile.blurred(gray.astype(float), weights))
        rough = tile.share(state(np.isnan(edge), np.round(edge, 9) > 0.10), texture)
        cloud = np.minimum(bright, np.maximum(state(np.isnan(rough), np.round(rough, 9) < 0.35), sure))
        cloud = tile.grown(tile.opened(cloud, 1), grow)
        shadow = np.minimum(tile.opened(shadow, 1), tile.grown(cloud, near))
        shadow = tile.grown(shadow, grow)
        shown = [pa.array(x == tiles.YES, mask=x == tiles.UNKNOWN) for x in (cloud, shadow)]
        return pa.table([*[table[k] for k in ("scene", "row", "col")], *shown], names=["scene", "row", "col", "cloud", "shadow"])

    types = dict(rows.dtypes)
    reach = len(weights) - 1 + 2 + texture + 2 + grow + near + grow
    return rasters.over_tiles(rows, reach, ("scene",), found, ", ".join(f"{k} {types[k]}" for k in ("scene", "row", "col")) + ", cloud boolean, shadow boolean")


def zones(stats: DataFrame, edges: DataFrame, least: float = 0.01) -> DataFrame:
    """Zone of each block: components of like neighbours. Zones of fewer than ``least`` blocks (below 1: than that share
    of a scene's blocks) are given to the zone that most of a block's neighbours belong to (the larger one where these
    are as many), ring by ring until every block has one. ``zone`` is the rank by size of the components within the scene, the largest being 0."""
    code = lambda s, r, c: (F.col(s) * 1_000_000 + F.col(r)) * 1_000_000 + F.col(c)
    blocks = stats.select("scene", "br", "bc", code("scene", "br", "bc").alias("node"))
    found = connected_components(edges.select(code("scene", "br", "bc").alias("x"), code("scene", "nr", "nc").alias("y")), "x", "y")
    label = written(blocks.join(found, "node", "left").select("scene", "br", "bc", F.coalesce("component", "node").alias("label")))
    sizes = label.groupBy("scene", "label").agg(F.count("*").alias("k"))
    total = label.groupBy("scene").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("k"), "label")) - 1  # over a row per component
    sizes = sizes.join(total, "scene").withColumn("zone", rank).where((F.col("k") >= (least * F.col("n") if least < 1 else F.lit(least))) | (F.col("zone") == 0))
    label = written(label.join(sizes.select("scene", "label", "zone"), ["scene", "label"], "left").select("scene", "br", "bc", "zone"))
    open_ = label.where("zone is null").count()
    while open_:
        label = written(rings(label))
        now = label.where("zone is null").count()
        if now == open_:  # parts of the scene without any zone beside them
            label, now = label.fillna(0, ["zone"]), 0
        open_ = now
    counted = label.groupBy("scene", "zone").agg(F.count("*").alias("zone_blocks"))
    return label.join(counted, ["scene", "zone"]).select("scene", "br", "bc", "zone", "zone_blocks")


#: Rings that one pass adds, and blocks along a tile.
RINGS = 1024


def rings(label: DataFrame, reach: int = RINGS) -> DataFrame:
    """``label`` (scene, br, bc, zone) with the blocks without a zone filled up to ``reach`` rings from those that have one. A
    tile sees ``reach`` blocks around it, further than anything that can get to its own blocks in that many rings."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r, c = (g[k].to_numpy() for k in ("br", "bc"))
        r0, c0, wide = r.min() - 1, c.min() - 1, int(c.max() - c.min()) + 3
        at = (r - r0) * wide + c - c0
        zone = np.full((int(r.max() - r.min()) + 3) * wide, -2, dtype=np.int64)  # -2: no block, -1: no zone
        zone[at] = g["zone"].fillna(-1).to_numpy(dtype=np.int64)
        steps, edge = np.array([1, -1, wide, -wide]), at[zone[at] >= 0]
        for _ in range(reach):
            near = np.unique(edge[:, None] + steps)
            near = near[zone[near] == -1]
            if not len(near):
                break
            seen = zone[near[:, None] + steps]
            votes = np.where(seen >= 0, (seen[:, :, None] == seen[:, None, :]).sum(axis=2), 0)
            most = votes == votes.max(axis=1, keepdims=True)
            zone[near] = np.where(most, seen, np.iinfo(np.int64).max).min(axis=1)
            edge = near
        own = ((r // reach == g["tr"].to_numpy()) & (c // reach == g["tc"].to_numpy())).nonzero()[0]
        out = g.iloc[own][["scene", "br", "bc"]].copy()
        out["zone"] = pd.array(zone[at[own]], dtype="Int64").astype("Int64")
        out.loc[out["zone"] < 0, "zone"] = pd.NA
        return out

    tiles = lambda k: F.explode(F.array_distinct(F.array(*[F.floor((F.col(k) + x) / reach) for x in (-reach, 0, reach)])))
    return label.withColumn("tr", tiles("br")).withColumn("tc", tiles("bc")).groupBy("scene", "tr", "tc").applyInPandas(run, label.schema)


def normalize_zones(px: DataFrame, zoned: DataFrame, size: int) -> DataFrame:
    """Brings each zone's median, spread and channel medians to those of its scene's zone with most pixels, and then its
    colours to the brightness that this gives."""
    rows = px.where("valid").withColumn("br", F.floor(F.col("row") / size)).withColumn("bc", F.floor(F.col("col") / size))
    rows = written(rows.join(zoned.select("scene", "br", "bc", "zone"), ["scene", "br", "bc"]))
    keys = ["scene", "zone"]
    own = rasters.spread(rows, keys, "gray").join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    for k in "rgb":
        own = own.join(exact_quantiles(rows, keys, k, {f"mid_{k}": 0.5}), keys)
    ref = own.groupBy("scene").agg(F.max_by(F.struct("mid", "mad", "mid_r", "mid_g", "mid_b"), F.struct("n", (-F.col("zone")).alias("z"))).alias("ref"))
    floor = lambda k: F.when(F.col(k) > 0, F.col(k)).otherwise(1e-3)
    cut = lambda x: raster.clip(x, 0.5, 2.0)
    known = own.join(ref, "scene").select(
        *keys, "mid", F.col("ref.mid").alias("ref_mid"), cut(floor("ref.mad") / floor("mad")).alias("scale"), *[cut(F.col(f"ref.mid_{k}") / F.greatest(f"mid_{k}", F.lit(1e-3))).alias(f"gain_{k}") for k in "rgb"]
    )
    gray = raster.clip((F.col("gray") - F.col("mid")) * F.col("scale") + F.col("ref_mid"), 0.0, 1.0)
    gained = {k: raster.clip(F.col(k) * F.col(f"gain_{k}"), 0.0, 1.0) for k in "rgb"}
    out = rows.join(F.broadcast(known), keys).select("scene", "row", "col", "zone", gray.alias("gray"), *[v.alias(k) for k, v in gained.items()])  # a row per zone
    ratio = cut(F.col("gray") / F.greatest(raster.luminance(F.col("r"), F.col("g"), F.col("b")), F.lit(1e-3)))
    return out.select("scene", "row", "col", "zone", "gray", *[raster.clip(F.col(k) * ratio, 0.0, 1.0).alias(k) for k in "rgb"])


def roof_mask(px: DataFrame, res: float) -> DataFrame:
    """Valid pixels whose blurred brightness is above that of the 150 m around by 2.5 mean deviations, and by 0.06 at
    least; closed, then opened, by 3 m or three pixels."""
    keys, odd = ("scene",), lambda m, least: max(least, int(m / res) | 1)
    rows = rasters.blur(px, "gray", max(1.0, 1.0 / res), keys, "smooth")
    rows = rasters.box_mean(rows, "smooth", odd(150.0, 15) // 2, keys, "local")
    rows = rasters.box_mean(rows.withColumn("away", F.abs(F.col("smooth") - F.col("local"))), "away", odd(150.0, 15) // 2, keys, "mad")
    roof = (F.round(F.col("smooth") - F.col("local") - F.greatest(F.lit(0.06), 2.5 * F.col("mad")), 9) > 0) & F.col("valid")
    rows = rows.select("scene", "row", "col", roof.alias("roof"))
    return rasters.opened(rasters.closed(rows, "roof", odd(3.0, 3) // 2, keys), "roof", odd(3.0, 3) // 2, keys)


def blobs(components: DataFrame, keys: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Area, centroid and extent of each component."""
    rows = components.groupBy(*keys, "component").agg(
        F.count("*").alias("area"), F.avg(row).alias("mid_r"), F.avg(col).alias("mid_c"), F.min(row).alias("r0"), F.max(row).alias("r1"), F.min(col).alias("c0"), F.max(col).alias("c1")
    )
    return rows.withColumn("fill", F.col("area") / ((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)))


def kmeans(px: DataFrame, keys: list[str], columns: list[str], k: int, rounds: int = 25) -> DataFrame:
    """``px`` with the ``cluster`` of each row among its group's (a scene's, say), the largest cluster being 0.

    All groups move together: a round is one pass with partial sums over the distinct values, each with its number of rows,
    and ``k`` centres of each group reach the driver.
    The first centres are the values with the lowest hash; an empty cluster keeps its centre.
    """
    spark, dims = px.sparkSession, range(len(columns))
    rows = px.withColumn("__v", F.array(*[F.col(c).cast("double") for c in columns]))
    values = written(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("__v"), "__v"))
    first = values.select(*keys, "__v").withColumn("__k", number).where(F.col("__k") <= k).orderBy("__k").collect()
    centres: dict[tuple, list[list[float]]] = {}
    for r in first:
        centres.setdefault(tuple(r[c] for c in keys), []).append(list(r["__v"]))
    if not centres:
        return rows.drop("__v").withColumn("cluster", F.lit(0))
    schema = px.select(*keys).schema.add("__centres", ArrayType(ArrayType(DoubleType())))

    def moved_to(rows: DataFrame) -> DataFrame:
        table = F.broadcast(spark.createDataFrame([(*key, c) for key, c in centres.items()], schema))  # a row per group
        away = F.transform("__centres", lambda c: F.round(sum(((F.col("__v")[i] - c[i]) * (F.col("__v")[i] - c[i]) for i in dims), F.lit(0.0)), 12))
        return rows.join(table, keys).withColumn("__away", away).withColumn("cluster", (F.array_position("__away", F.array_min("__away")) - 1).cast("int")).drop("__away", "__centres")

    for _ in range(rounds):
        means = moved_to(values).groupBy(*keys, "cluster").agg(*[(F.sum(F.col("__v")[i] * F.col("__n")) / F.sum(F.when(F.col("__v")[i].isNotNull(), F.col("__n")))).alias(f"__{i}") for i in dims]).collect()
        moved = {key: [list(c) for c in cs] for key, cs in centres.items()}
        for r in means:
            moved[tuple(r[c] for c in keys)][r["cluster"]] = [round(r[f"__{i}"], 12) for i in dims]
        if moved == centres:
            break
        centres = moved
    out = written(moved_to(rows).drop("__v"))
    sizes = moved_to(values).groupBy(*keys, "cluster").agg(F.sum("__n").alias("__n"))
    rank = sizes.select(*keys, "cluster", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), "cluster")) - 1).alias("__rank"))
    return out.join(F.broadcast(rank), [*keys, "cluster"]).drop("cluster").withColumnRenamed("__rank", "cluster")  # k rows a group


def shadow_runs(rays: DataFrame, dark: Column) -> DataFrame:
    """Last dark step of each (building, ray) before two lit steps in a row. ``rays`` has id, ray, step."""
    w = Window.partitionBy("id", "ray").orderBy("step")
    rows = rays.withColumn("lit", ~dark)
    stop = F.min(F.when(F.col("lit") & F.lag("lit").over(w), F.col("step"))).over(Window.partitionBy("id", "ray"))
    rows = rows.withColumn("stop", stop)
    return rows.where(~F.col("lit") & (F.col("stop").isNull() | (F.col("step") < F.col("stop")))).groupBy("id", "ray").agg(F.max("step").alias("reach"))


def rigid_fit(matches: DataFrame, trims: int = 3, keep: float = 2.0) -> DataFrame:
    """Rotation and shift of each pair of frames from matched points, refitted without its outliers ``trims`` times.

    ``matches`` has pair, id, x, y (before) and u, v (after). The fit is in closed form from grouped sums.
    """
    rows = matches
    for k in range(trims + 1):
        fit = rows.groupBy("pair").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.count("*").alias("inliers"))
        d = rows.join(fit, "pair")
        dx, dy, du, dv = (F.col(a) - F.col(f"m{a}") for a in "xyuv")
        turn = d.groupBy("pair").agg(F.atan2(F.sum(dx * dv - dy * du), F.sum(dx * du + dy * dv)).alias("turn"))
        fit = fit.join(turn, "pair")
        if k == trims:
            break
        d = d.join(turn, "pair")
        ru = dx * F.cos("turn") - dy * F.sin("turn") - du
        rv = dx * F.sin("turn") + dy * F.cos("turn") - dv
        d = d.withColumn("away", F.sqrt(ru * ru + rv * rv))
        bound = d.groupBy("pair").agg((keep * F.median("away") + 1e-6).alias("bound"))
        rows = written(d.join(bound, "pair").where(F.col("away") <= F.col("bound")).select("pair", "id", "x", "y", "u", "v"))
    shift_e = F.col("mu") - (F.col("mx") * F.cos("turn") - F.col("my") * F.sin("turn"))
    shift_n = F.col("mv") - (F.col("mx") * F.sin("turn") + F.col("my") * F.cos("turn"))
    return fit.select("pair", F.degrees("turn").alias("turn_deg"), shift_e.alias("de"), shift_n.alias("dn"), "inliers")


def constellation_scores(points: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """Score of (query, hypothesis) point sets: greedy matching nearest first, matched share times exp(-3 * mean rest).

    Sets are centred and scaled by their mean distance, so the score does not depend on scale. Fewer than two query
    points score 0.5 (neutral), fewer than two model points 0.0 (veto). ``points`` has query, hypothesis, side, x, y.
    """

    def norm(p: np.ndarray) -> np.ndarray:
        p = p - p.mean(0)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        return p / max(d[np.triu_indices(len(p), 1)].mean(), 1e-9)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g.loc[g["side"] == s, ["x", "y"]].sort_values(["x", "y"]).to_numpy() for s in (0, 1))
        value = 0.5 if len(a) < 2 else 0.0
        if len(a) >= 2 and len(b) >= 2:
            d = np.sqrt(((norm(a)[:, None] - norm(b)[None]) ** 2).sum(-1))
            rest = []
            while d.size and d.min() < tolerance:
                i, j = np.unravel_index(d.argmin(), d.shape)
                rest.append(d[i, j])
                d = np.delete(np.delete(d, i, 0), j, 1)
            value = len(rest) / len(a) * float(np.exp(-3 * np.mean(rest))) if rest else 0.0
        return pd.DataFrame({"query": [g["query"].iloc[0]], "hypothesis": [g["hypothesis"].iloc[0]], "score": [float(value)]})

    return points.groupBy("query", "hypothesis").applyInPandas(score, "query long, hypothesis long, score double")


def view_descriptor(px: DataFrame, width: int, height: int) -> DataFrame:
    """Per view: shares of 12 logarithmic depths up to exp(8.5) - 1, class shares of the top and bottom half (8), the
    height of the highest building pixel in 16 bands; scaled to length one."""
    finite = F.col("depth") < float("inf")
    at = F.log1p("depth") * (12 / 8.5)
    bin_ = F.when(finite & (at >= 0) & (at <= 12), F.least(F.lit(11), F.floor(at)))
    depth = [(F.count_if(bin_ == k) / F.greatest(F.lit(1), F.count_if(finite))).alias(f"d{k}") for k in range(12)]
    halves = (F.col("r") < height // 2, F.col("r") >= height // 2)
    kinds = {"building": F.col("building"), "vegetation": F.col("vegetation"), "sky": ~finite, "water": F.col("water")}
    classes = [F.avg(F.when(half, kind.cast("double"))).alias(f"{name}{i}") for name, kind in kinds.items() for i, half in enumerate(halves)]
    first, more = divmod(width, 16)  # bands of almost one width, the wider ones first
    edges = [0]
    for k in range(16):
        edges.append(edges[-1] + first + (k < more))
    sky = [(1 - F.min(F.when(F.col("building") & (F.col("c") >= a) & (F.col("c") < z), F.col("r"))) / F.lit(float(height))).alias(f"s{k}") for k, (a, z) in enumerate(zip(edges, edges[1:]))]
    rows = px.groupBy("view_id").agg(*depth, *classes, *sky)
    names = [c for c in rows.columns if c != "view_id"]
    values = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in names])
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("view_id", F.transform(values, lambda x: F.when(length > 0, x / length).otherwise(x)).alias("descriptor"))


def view_alignment(pairs: DataFrame) -> DataFrame:
    """Agreement of a query view (columns a_*) with another one (b_*), joined on their pixels: overlap of buildings and
    of water, equal sky, and depth, from their relative difference's median. Water counts only where the query shows
    some, depth only where both have it; the other cues then weigh more."""

    def overlap(k: str) -> Column:
        a, b = F.col(f"a_{k}"), F.col(f"b_{k}")
        return F.coalesce(F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0)), F.lit(1.0))

    sky_a, sky_b = F.col("a_depth") == float("inf"), F.col("b_depth") == float("inf")
    apart = F.when(~sky_a & ~sky_b, F.abs(F.col("a_depth") - F.col("b_depth")) / F.greatest(F.col("a_depth"), F.lit(1.0)))
    rows = pairs.groupBy("view_id").agg(
        overlap("building").alias("silhouette"), F.avg((sky_a == sky_b).cast("double")).alias("sky"), F.when(F.count_if("a_water") > 0, overlap("water")).alias("water"), raster.clip(1 - 2 * F.median(apart), 0.0, 1.0).alias("depth")
    )
    mix = lambda **w: sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
    water, depth = F.col("water").isNotNull(), F.col("depth").isNotNull()
    score = F.when(depth & water, mix(silhouette=0.4, depth=0.25, sky=0.15, water=0.2)).when(depth, mix(silhouette=0.5, depth=0.3, sky=0.2))
    return rows.withColumn("score", score.when(water, mix(silhouette=0.45, sky=0.25, water=0.3)).otherwise(mix(silhouette=0.65, sky=0.35)))


def batched(rows: DataFrame, model: Callable[[np.ndarray], np.ndarray], schema: str, vector: str, batch: int = 64) -> DataFrame:
    """Applies a caller's model to a vector column in batches; ``schema`` is id and the model's output array."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = np.stack(p[vector].to_numpy()) if len(p) else np.zeros((0, 1))
            out = [model(x[i : i + batch]) for i in range(0, len(x), batch)]
            yield pd.DataFrame({"id": p["id"], "out": list(np.concatenate(out)) if out else []})

    return rows.select("id", vector).mapInPandas(run, schema)


def tiles_through(px: DataFrame, hook: Callable[[np.ndarray], np.ndarray] | None, value: str, size: int, halo: int = 16, reach: int = 4) -> DataFrame:
    """Gives each tile of ``size`` x ``size`` pixels, with ``halo`` pixels around it, to a hook (image -> value per pixel), and
    blends where tiles overlap; NaN where there is no hook.

    A tile's values count more the further they are from its edge, and not at all within ``reach`` pixels of it, where the
    hook lacks what lies beyond. So the result of a hook that looks no further than ``reach`` does not depend on the tiles.
    At the image's own edge every tile sees that edge; pixels that are missing are 0. ``reach`` is below ``halo``; with both 0, tiles stand for themselves.
    """
    if hook is None:
        return px.select("scene", "row", "col", F.lit(float("nan")).alias(value))
    if not (0 <= reach < halo <= size or halo == reach == 0):
        raise ValueError("reach must be below halo, and halo at most the size of a tile")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        one = g.iloc[0]
        r0, c0 = (max(int(one[k] * size - halo), int(one[low])) for k, low in (("tr", "r_low"), ("tc", "c_low")))
        r1, c1 = (min(int((one[k] + 1) * size + halo), int(one[high]) + 1) for k, high in (("tr", "r_high"), ("tc", "c_high")))
        r, c = (g["row"] - r0).to_numpy(), (g["col"] - c0).to_numpy()
        image = np.zeros((r1 - r0, c1 - c0))
        image[r, c] = g["gray"]
        found = np.asarray(hook(image), dtype=float)[r, c]
        away = lambda x, t: np.minimum(x - (t * size - halo), (t + 1) * size + halo - 1 - x) + 1 - reach
        weight = np.maximum(away(g["row"].to_numpy(), one["tr"]), 0.0) * np.maximum(away(g["col"].to_numpy(), one["tc"]), 0.0)
        out = pd.DataFrame({"scene": g["scene"], "row": g["row"], "col": g["col"], "v": found * weight, "w": weight})
        return out[out["w"] > 0]

    tiles = lambda k: F.explode(F.array_distinct(F.transform(F.array(*[F.lit(x) for x in (-halo, 0, halo)]), lambda x: F.floor((F.col(k) + x) / size))))
    low, high = (lambda k, name: F.min(k).alias(name)), (lambda k, name: F.max(k).alias(name))
    bounds = px.groupBy("scene").agg(low("row", "r_low"), high("row", "r_high"), low("col", "c_low"), high("col", "c_high"))
    tiled = px.select("scene", "row", "col", "gray").withColumn("tr", tiles("row")).withColumn("tc", tiles("col")).join(F.broadcast(bounds), "scene")  # a row per scene
    parts = tiled.groupBy("scene", "tr", "tc").applyInPandas(run, "scene int, row long, col long, v double, w double")
    return parts.groupBy("scene", "row", "col").agg((F.sum("v") / F.sum("w")).alias(value))


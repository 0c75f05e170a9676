"""Distinctiveness of raster cells, separated peaks, composites of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators import profiles
from skylattice.operators.graph import written

#: Lower bounds of the height classes (fixed values).
BINS = (0, 3, 6, 10, 15, 25, 40, 70)


def cell_saliency(texels: DataFrame, cell: int) -> DataFrame:
    """Relief, height entropy, skyline rarity, landmark flag and capture density of each whole cell of ``cell`` texels.

    Rarity compares height profiles, of which there are few kinds: cells of one profile are counted together, and only
    different profiles are compared, by matrix products with pruning (``profiles``).
    """
    last = texels.agg(F.floor((F.max("row") + 1) / cell).alias("whole"))  # one row
    t = texels.withColumn("cr", F.floor(F.col("row") / cell)).withColumn("cc", F.floor(F.col("col") / cell)).crossJoin(F.broadcast(last)).where("cr < whole")
    bin_ = F.lit(len(BINS) - 1)
    for k in range(len(BINS) - 1, 0, -1):
        bin_ = F.when(F.col("build_h") < BINS[k], k - 1).otherwise(bin_)
    t = t.select("cr", "cc", "ground", "build_h", bin_.alias("bin"))
    built = F.when(F.col("build_h") > 1, F.col("build_h"))
    base = t.groupBy("cr", "cc").agg(
        F.stddev_pop("ground").alias("relief"),
        (F.max(built) > 3 * F.greatest(F.median(built), F.lit(1.0))).alias("landmark"),
        *[F.count_if(F.col("bin") == k).alias(f"k{k}") for k in range(len(BINS))],
        *[F.count_if((F.col("bin") == k) & (F.col("build_h") > 1)).alias(f"b{k}") for k in range(len(BINS))],
    )
    tall = F.array(*[F.col(f"b{k}") for k in range(len(BINS))])
    total = F.aggregate(tall, F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda x: x / F.col("total")
    base = base.withColumn("total", total)
    entropy = F.aggregate(tall, F.lit(0.0), lambda a, x: a - F.when(x > 0, share(x) * F.ln(share(x))).otherwise(0.0))
    profile = F.array(*[F.col(f"k{k}") for k in range(len(BINS))])
    base = base.withColumn("entropy", F.when(F.col("total") > 0, entropy).otherwise(0.0)).withColumn("profile", profile)

    kinds = base.groupBy("profile").agg(F.count("*").alias("cells"))
    length = F.sqrt(F.aggregate("profile", F.lit(0.0), lambda a, x: a + x * x))
    kinds = written(kinds.withColumn("id", F.monotonically_increasing_id()))
    unit = kinds.select("id", F.transform("profile", lambda x: x / length).alias("v"))
    near = profiles.nearest_profiles(unit, len(BINS)).select("id", "s")
    twin = F.when(F.col("cells") > 1, 1.0)
    rarity = kinds.join(near, "id", "left").select("profile", (1 - F.coalesce(twin, F.col("s"))).alias("rarity"))
    out = base.join(rarity, "profile").withColumn("landmark", F.coalesce("landmark", F.lit(False)))
    one = lambda x: F.least(F.lit(1.0), x)
    distinct = one(F.col("relief") / 15) * 0.35 + one(F.col("entropy") / 1.6) * 0.30 + one(F.col("rarity") / 0.5) * 0.20 + F.when(F.col("landmark"), 0.15).otherwise(0.0)
    density = F.greatest(F.lit(0.5), F.least(F.lit(2.2), 1.35 - distinct))
    return out.select("cr", "cc", "relief", "entropy", "rarity", "landmark", density.alias("density"))


def separated_peaks(texels: DataFrame, n: int, apart: float, least: float = 2.0) -> DataFrame:
    """The ``n`` tallest texels, tallest first, each farther than ``apart`` from those before.

    The greedy choice looks at the ``n`` * 400 tallest texels, which is the operator's own bound on its search.
    """
    import pandas as pd

    best = texels.where(F.col("build_h") >= least).select("row", "col", "build_h").orderBy(F.desc("build_h"), "row", "col").limit(n * 400)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        picked: list = []
        rows = rows[["row", "col", "build_h"]]
        for row, col, h in rows.sort_values(["build_h", "row", "col"], ascending=[False, True, True]).itertuples(index=False):
            if all((row - a) ** 2 + (col - b) ** 2 > apart * apart for a, b, _ in picked):
                picked.append((row, col, h))
                if len(picked) == n:
                    break
        return pd.DataFrame(picked, columns=["row", "col", "build_h"])

    return best.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, "row long, col long, build_h double")


def first_valid(px: DataFrame) -> DataFrame:
    """Gray value and number of the first scene that shows each texel."""
    seen = F.when(F.col("valid"), F.struct(F.col("scene"), "gray"))
    return px.groupBy("row", "col").agg(F.min(seen).alias("x")).select("row", "col", F.col("x.scene").alias("first"), "x.gray")


def composite_fills(px: DataFrame, done: float = 0.005) -> DataFrame:
    """For each scene, in order: texels that it is the first to show, the share of holes before and after it, and whether
    it is used. Scenes that come when the share of holes is ``done`` or less are left out. The first scene is always used."""
    first = first_valid(px).groupBy("first").agg(F.count("*").alias("k"))  # a row per scene
    all_ = first.agg(F.sum("k").alias("total"))
    scenes = px.select(F.col("scene")).distinct().join(first, F.col("scene") == F.col("first"), "left").crossJoin(F.broadcast(all_))
    fills = F.coalesce("k", F.lit(0)).alias("fills")
    shown = F.sum("fills").over(Window.orderBy("scene"))  # over a row per scene
    out = scenes.select("scene", "total", fills).withColumn("holes_after", 1 - shown / F.col("total"))
    out = out.withColumn("holes_before", F.col("holes_after") + F.col("fills") / F.col("total")).withColumn("lead", F.min("scene").over(Window.partitionBy()))
    late = (F.col("scene") > F.col("lead")) & (F.round("holes_before", 9) <= done)
    return out.where(~late).select("scene", "fills", "holes_before", "holes_after", ((F.col("scene") == F.col("lead")) | (F.col("fills") > 0)).alias("used"))

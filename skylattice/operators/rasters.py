"""Raster algebra on texel tables: sampling, burning, windows, zones, masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.graph import dealt, written
from skylattice.operators.quantiles import exact_quantiles


def resample(texels: DataFrame, size: int, width: int) -> DataFrame:
    """Nearest-texel resampling to ``size`` x ``size`` with the ground scaled to 16 bits."""
    low = texels.agg(F.min("ground").alias("low"), F.greatest(F.max("ground") - F.min("ground"), F.lit(1)).alias("span"), F.max("row").alias("last"))
    ticks = texels.sparkSession.range(size)  # two small index tables
    rows = ticks.crossJoin(F.broadcast(low)).select(F.col("id").alias("i"), (F.col("id") * F.col("last") / F.lit(float(size - 1))).cast("long").alias("row"), "low", "span")
    cols = ticks.select(F.col("id").alias("j"), (F.col("id") * (width - 1) / F.lit(float(size - 1))).cast("long").alias("col"))
    return texels.join(F.broadcast(rows), "row").join(F.broadcast(cols), "col").select("i", "j", ((F.col("ground") - F.col("low")) / F.col("span") * 65535).cast("int").alias("height"))


def bilinear(points: DataFrame, texels: DataFrame, value: str) -> DataFrame:
    """Value at fractional (x = column, y = row): four equi-joined neighbours, weighted. Points whose neighbours are
    missing are weighted over those that exist. ``points`` has id, x, y."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    near = points.withColumn("o", F.explode(corners)).select(
        "id",
        (F.floor("y") + F.col("o.a")).alias("row"),
        (F.floor("x") + F.col("o.b")).alias("col"),
        (F.abs(1 - F.col("o.a") - (F.col("y") - F.floor("y"))) * F.abs(1 - F.col("o.b") - (F.col("x") - F.floor("x")))).alias("w"),
    )
    found = near.join(texels.select("row", "col", F.col(value).alias("v")), ["row", "col"])
    return found.groupBy("id").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias(value))


#: Rows of a raster that one task holds of a column.
TALL = 512


def over_rows(raster: DataFrame, reach: int, keys: tuple, make) -> DataFrame:
    """Adds the columns that ``make`` gives for a window down each column. The rows are cut into blocks, each with the
    ``reach`` rows around it, so a column of any length is spread over many tasks."""
    high = max(TALL, reach)
    of = lambda x: F.floor(x / high)
    blocks = F.array_distinct(F.array(of(F.col("row") - reach), of(F.col("row")), of(F.col("row") + reach)))
    halo = raster.withColumn("__block", F.explode(blocks))
    w = Window.partitionBy(*keys, "col", "__block").orderBy("row")
    return halo.withColumns(make(w)).where(F.col("__block") == of(F.col("row"))).drop("__block")


#: Rows, and columns, of a tile.
TILE = 512


def over_tiles(raster: DataFrame, reach: int, keys: tuple, make, schema: str) -> DataFrame:
    """What ``make`` gives for square tiles of a raster (Arrow tables with the ``reach`` pixels around, in one shuffle), as far
    as it lies in the tile itself. ``schema`` names ``keys``, row and col first. Pixels without a row or column go."""
    size, ends = max(TILE, reach), raster.agg(*[f(k) for k in ("row", "col") for f in (F.min, F.max)]).first()
    of = lambda x: F.floor(x / size).cast("long")

    def blocks(k: str, low: int | None, high: int | None) -> Column:
        """The tile of a place, and those that it is beside; none that lie outside of the raster."""
        near = F.array(F.greatest(of(F.col(k) - reach), of(F.lit(low or 0))), of(F.col(k)), F.least(of(F.col(k) + reach), of(F.lit(high or 0))))
        return F.explode(F.array_distinct(near))

    def run(key, table):
        import pyarrow.compute as pc

        found = make(table)
        own = [pc.equal(pc.floor(pc.divide(pc.cast(found[k], "double"), float(size))), float(at.as_py())) for k, at in zip(("row", "col"), key[-2:])]
        return found.filter(pc.and_(*own))

    halo = raster.where("row is not null and col is not null").withColumn("__tr", blocks("row", ends[0], ends[1])).withColumn("__tc", blocks("col", ends[2], ends[3]))
    return halo.groupBy(*keys, "__tr", "__tc").applyInArrow(run, schema)


def over_columns(raster: DataFrame, keys: tuple, make) -> DataFrame:
    """The same along each row."""
    return raster.withColumns(make(Window.partitionBy(*keys, "row").orderBy("col")))


def box_mean(raster: DataFrame, value: str, radius: int, keys: tuple = (), name: str = "mean") -> DataFrame:
    """Mean over a square window, as two windows over rows and columns; windows are cut at the raster's edge."""
    near = lambda w: w.rangeBetween(-radius, radius)
    across = over_columns(raster, keys, lambda w: {"__s": F.sum(value).over(near(w)), "__n": F.count(value).over(near(w))})
    return over_rows(across, radius, keys, lambda w: {name: F.sum("__s").over(near(w)) / F.sum("__n").over(near(w))}).drop("__s", "__n")


def weighted(value: str, weights: list[float], w) -> Column:
    """Mean of the texels at distance 0, 1, ... before and after along a window, by weight; missing ones don't count."""
    at = lambda k: F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else F.col(value)
    steps = range(1 - len(weights), len(weights))
    total = sum((F.coalesce(at(k) * weights[abs(k)], F.lit(0.0)) for k in steps), F.lit(0.0))
    return total / sum((F.when(at(k).isNotNull(), weights[abs(k)]).otherwise(0.0) for k in steps), F.lit(0.0))


def gaussian(sigma: float) -> list[float]:
    """Weights at distance 0, 1, ... up to three sigma."""
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(math.ceil(3 * sigma) + 1)]


def blur(raster: DataFrame, value: str, sigma: float, keys: tuple = (), name: str = "blurred") -> DataFrame:
    """Gaussian blur of a raster without gaps within rows and columns."""
    g = gaussian(sigma)
    across = over_columns(raster, keys, lambda w: {"__across": weighted(value, g, w)})
    return over_rows(across, len(g) - 1, keys, lambda w: {name: weighted("__across", g, w)}).drop("__across")


def dilate(raster: DataFrame, flag: str, radius: int, keys: tuple = (), shrink: bool = False) -> DataFrame:
    """Grows a flag by a square of ``radius`` (or shrinks it), as separable maxima (or minima)."""
    of = F.min if shrink else F.max
    near = lambda w: {flag: of(flag).over(w.rangeBetween(-radius, radius))}
    return over_rows(over_columns(raster, keys, near), radius, keys, near)


def opened(raster: DataFrame, flag: str, radius: int, keys: tuple = ()) -> DataFrame:
    return dilate(dilate(raster, flag, radius, keys, shrink=True), flag, radius, keys)


def closed(raster: DataFrame, flag: str, radius: int, keys: tuple = ()) -> DataFrame:
    return dilate(dilate(raster, flag, radius, keys), flag, radius, keys, shrink=True)


def beside(raster: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """Adds ``left``, ``right``, ``up`` and ``down``: the value of the next texels; null at the edge or over a gap."""

    def of(along: str, before: str, after: str):
        lag = lambda w: F.when(F.col(along) - F.lag(along).over(w) == 1, F.lag(value).over(w))
        lead = lambda w: F.when(F.lead(along).over(w) - F.col(along) == 1, F.lead(value).over(w))
        return lambda w: {before: lag(w), after: lead(w)}

    return over_rows(over_columns(raster, keys, of("col", "left", "right")), 1, keys, of("row", "up", "down"))


def edges(raster: DataFrame, value: str, keys: tuple = (), name: str = "edge") -> DataFrame:
    """Gradient by 3 x 3 differences, weighted 1, 2, 1 across their direction; beyond the edge the raster goes on as a mirror."""
    next_ = lambda v, w, k: F.coalesce(F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w), F.lag(v, k).over(w) if k > 0 else F.lead(v, -k).over(w))
    smooth = lambda v, w: next_(v, w, -1) + 2 * F.col(v) + next_(v, w, 1)
    diff = lambda v, w: next_(v, w, 1) - next_(v, w, -1)
    across = over_columns(raster, keys, lambda w: {"__d": diff(value, w), "__m": smooth(value, w)})
    down = over_rows(across, 2, keys, lambda w: {"__x": smooth("__d", w), "__y": diff("__m", w)})
    return down.withColumn(name, F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y"))).drop("__d", "__m", "__x", "__y")


def burn(texels: DataFrame, shapes: DataFrame, inside: Column, seq: str, values: list[str], block: int = 64) -> DataFrame:
    """The last shape (by ``seq``) that covers each texel, for axis-aligned extents r0..r1, c0..c1 and a residual test.

    Shapes are cut into blocks of ``block`` x ``block`` texels and dealt by block, so a large shape is spread over many tasks;
    each piece lists its own texels, and partial maxima leave one row for each texel of a task.
    """
    of = lambda k: F.floor(F.col(k) / block)
    pieces = shapes.withColumn("br", F.explode(F.sequence(of("r0"), of("r1")))).withColumn("bc", F.explode(F.sequence(of("c0"), of("c1"))))
    within = lambda k, low, high: F.explode(F.sequence(F.greatest(F.col(low), F.col(k) * block), F.least(F.col(high), F.col(k) * block + block - 1)))
    near = pieces.repartition("br", "bc", F.pmod(F.xxhash64(*shapes.columns), F.lit(64))).withColumn("row", within("br", "r0", "r1")).withColumn("col", within("bc", "c0", "c1"))
    top = near.where(inside).groupBy("row", "col").agg(F.max_by(F.struct(*values), seq).alias("top"))
    return top.join(dealt(texels.select("row", "col")), ["row", "col"], "left_semi").select("row", "col", "top.*")


def block_stats(px: DataFrame, size: int) -> DataFrame:
    """Median, median absolute deviation and channel medians of each block of valid pixels."""
    rows = px.where("valid").withColumn("br", F.floor(F.col("row") / size)).withColumn("bc", F.floor(F.col("col") / size))
    keys = ["scene", "br", "bc"]
    mid = rows.groupBy(*keys).agg(F.median("gray").alias("mid"), *[F.median(k).alias(f"mid_{k}") for k in "rgb"])
    apart = rows.join(mid.select(*keys, "mid"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("gray") - F.col("mid"))).alias("mad"), F.count("*").alias("n"))
    return mid.join(apart, keys)


#: Differences of block medians (brightness, channels) that part two zones.
LUM_SPLIT, CHAN_SPLIT = 0.055, 0.045


def like_blocks(stats: DataFrame) -> DataFrame:
    """Neighbouring blocks of like brightness and colour, each with its right and lower one, by equi-joins on shifted
    keys. Differences on the bound count as like."""
    kept = stats.select("scene", "br", "bc", "mid", "mid_r", "mid_g", "mid_b")
    steps = F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
    near = kept.withColumn("s", F.explode(steps)).withColumn("nr", F.col("br") + F.col("s.a")).withColumn("nc", F.col("bc") + F.col("s.b")).drop("s")
    other = kept.select("scene", F.col("br").alias("nr"), F.col("bc").alias("nc"), *[F.col(k).alias(f"o{k}") for k in ("mid", "mid_r", "mid_g", "mid_b")])
    apart = lambda k: F.round(F.abs(F.col(k) - F.col(f"o{k}")), 9)
    like = (apart("mid") <= LUM_SPLIT) & (F.greatest(*[apart(f"mid_{k}") for k in "rgb"]) <= CHAN_SPLIT)
    return near.join(other, ["scene", "nr", "nc"]).where(like).select("scene", "br", "bc", "nr", "nc")


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median (``mid``) and median absolute deviation (``mad``) of each group, however large."""
    mid = exact_quantiles(rows, keys, value, {"mid": 0.5})
    away = rows.join(mid, keys).withColumn("__away", F.abs(F.col(value) - F.col("mid")))
    return mid.join(exact_quantiles(away, keys, "__away", {"mad": 0.5}), keys)


def scene_gains(px: DataFrame, reference: DataFrame, least: int = 500) -> DataFrame:
    """What brings each scene to the reference on the pixels that both show: medians, the scale of their spreads and a
    gain for each channel, each cut to 0.5 to 2. Scenes that share fewer than ``least`` pixels have no row.

    ``px`` has scene, row, col, gray, r, g, b; ``reference`` has row, col and the same values.
    """
    both = px.join(reference.select("row", "col", *[F.col(k).alias(f"ref_{k}") for k in ("gray", "r", "g", "b")]), ["row", "col"])
    both = written(both)  # ten quantiles are taken of it
    n = both.groupBy("scene").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own, ref = spread(both, ["scene"], "gray"), spread(both, ["scene"], "ref_gray").select("scene", F.col("mid").alias("ref_mid"), F.col("mad").alias("ref_mad"))
    out = n.join(own, "scene").join(ref, "scene")
    floor = lambda k: F.when(F.col(k) > 0, F.col(k)).otherwise(1e-3)
    cut = lambda x: F.greatest(F.lit(0.5), F.least(F.lit(2.0), x))
    out = out.withColumn("scale", cut(floor("ref_mad") / floor("mad")))
    for k in "rgb":
        mids = exact_quantiles(both, ["scene"], k, {"a": 0.5}).join(exact_quantiles(both, ["scene"], f"ref_{k}", {"b": 0.5}), "scene")
        out = out.join(mids.select("scene", cut(F.col("b") / F.greatest("a", F.lit(1e-3))).alias(f"gain_{k}")), "scene")
    return out.drop("mad", "ref_mad")

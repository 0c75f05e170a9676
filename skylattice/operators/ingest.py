"""Cells, caches, manifests and generated plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions import geo


def cells_of_boxes(boxes: DataFrame, cell_m: float = geo.CELL_M) -> DataFrame:
    """A row for each grid cell that a box (south, west, north, east) meets; the upper edges are open."""
    step = cell_m / geo.METRES_PER_DEGREE
    span = lambda low, high: F.sequence(F.floor(F.col(low) / step), F.floor((F.col(high) - 1e-12) / step))
    rows = boxes.withColumn("ilat", F.explode(span("south", "north"))).withColumn("ilon", F.explode(span("west", "east")))
    return rows.withColumn("cell", geo.cell_id(F.col("ilat"), F.col("ilon"), cell_m))


def dem_tiles(boxes: DataFrame) -> DataFrame:
    whole = lambda low, high: F.sequence(F.floor(low), F.floor(high))
    rows = boxes.withColumn("lat", F.explode(whole("south", "north"))).withColumn("lon", F.explode(whole("west", "east")))
    return rows.withColumn("tile", geo.dem_tile(F.col("lat"), F.col("lon")))


def web_tiles(boxes: DataFrame, zoom: int, most: int = 400) -> DataFrame:
    """Tiles of each box; a box of more than ``most`` tiles is an error."""
    x0, y1 = geo.web_tile(F.col("south"), F.col("west"), F.lit(zoom))
    x1, y0 = geo.web_tile(F.col("north"), F.col("east"), F.lit(zoom))
    rows = boxes.withColumn("x0", x0).withColumn("x1", x1).withColumn("y0", y0).withColumn("y1", y1)
    count = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    fine = F.when(count <= most, count).otherwise(F.raise_error(F.lit("too many tiles: lower the zoom")).cast("long"))
    rows = rows.withColumn("n_tiles", fine).where("n_tiles > 0")
    return rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))


def tile_grid(bounds: DataFrame, tile_m: float) -> DataFrame:
    """Even tiles over bounds (e0, n0, e1, n1); at least one each way."""
    count = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / tile_m))
    rows = bounds.withColumn("ke", count("e0", "e1")).withColumn("kn", count("n0", "n1"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ke") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kn") - 1)))
    edge = lambda a, b, i, k: F.col(a) + i * (F.col(b) - F.col(a)) / F.col(k)
    return rows.select(
        F.concat(F.lit("t"), F.col("i").cast("string"), F.lit("_"), F.col("j").cast("string")).alias("tile"),
        (F.col("i") * F.col("kn") + F.col("j")).alias("seq"),
        edge("e0", "e1", F.col("i"), "ke").alias("e_min"),
        edge("e0", "e1", F.col("i") + 1, "ke").alias("e_max"),
        edge("n0", "n1", F.col("j"), "kn").alias("n_min"),
        edge("n0", "n1", F.col("j") + 1, "kn").alias("n_max"),
    )


def pending(requested: DataFrame, cached: DataFrame, skipped: DataFrame, key: str = "cell") -> DataFrame:
    """Requested cells that are neither cached nor skipped."""
    return requested.join(cached.select(key), key, "left_anti").join(skipped.select(key), key, "left_anti")


def last_of_each(features: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row a key: the last value wins, the first position is kept."""
    rest = [k for k in features.columns if k not in key]
    return features.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("last"), F.min(seq).alias("first_seq")).select(*key, "last.*", "first_seq")


def numbered(rows: DataFrame, order: list[str], first: Column | int = 0, size: int = 512, buckets: int = 64) -> DataFrame:
    """Global index in order, with its shard and the place in it.

    Rows are counted per range bucket of the leading key, the few bucket totals are summed, and rows are numbered within
    their bucket, so no task sorts them all.
    """
    lead = order[0]
    ranges = rows.agg(F.min(lead).alias("low"), F.max(lead).alias("high"))  # one row
    spread = (F.col(lead) - F.col("low")) * F.lit(float(buckets)) / (F.col("high") - F.col("low") + 1)
    placed = rows.crossJoin(F.broadcast(ranges)).withColumn("bucket", F.floor(spread)).drop("low", "high")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over ``buckets`` rows
    offset = placed.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    out = placed.withColumn("within", within).join(F.broadcast(offset), "bucket")
    index = F.col("before") + F.col("within") - 1 + first
    return out.withColumn("index", index).withColumn("shard", F.floor(F.col("index") / size)).withColumn("pos", F.col("index") % size).drop("bucket", "within", "before")


def lawnmower(bounds: DataFrame, spacing: float, altitudes: list[float], yaws: int, density: Column) -> DataFrame:
    """Stations on a grid that is finer than ``spacing`` and thinned by a hash to the density; four yaws or more each.

    ``density`` is a multiplier in terms of x and z, 2.2 at most.
    """
    step = spacing / 2.2**0.5
    axis = lambda a, b: F.sequence(F.lit(0).cast("long"), F.floor((F.col(b) - F.col(a) + 1e-6) / step))
    grid = bounds.withColumn("i", F.explode(axis("x0", "x1"))).withColumn("j", F.explode(axis("z0", "z1")))
    grid = grid.select((F.col("x0") + F.col("i") * step).alias("x"), (F.col("z0") + F.col("j") * step).alias("z"))
    part = lambda k, m: (F.col(k) * 7.31).cast("long") * m
    chance = part("x", 73856093).bitwiseXOR(part("z", 19349663)).bitwiseAND(F.lit(65535)) / 65535.0
    kept = grid.where(chance <= density / 2.2)
    kept = kept.withColumn("agl", F.explode(F.array(*[F.lit(a) for a in altitudes])))
    return kept.withColumn("yaw", F.explode(F.array(*[F.lit(360.0 * k / yaws) for k in range(yaws)])))


def orbit(points: DataFrame, radius: float, steps: int, altitudes: list[float]) -> DataFrame:
    """Poses on a ring around each point (x, z), facing it, at the first two altitudes."""
    import math

    turn = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("ang", F.col("k") * (2 * math.pi / steps))
    placed = turn.withColumn("px", F.col("x") + radius * F.sin("ang")).withColumn("pz", F.col("z") + radius * F.cos("ang"))
    yaw = geo.heading_deg(F.col("x") - F.col("px"), F.col("z") - F.col("pz"))
    placed = placed.withColumn("yaw", yaw).withColumn("agl", F.explode(F.array(*[F.lit(a) for a in altitudes[:2]])))
    return placed.select("id", "k", F.col("px").alias("x"), F.col("pz").alias("z"), "agl", "yaw")


def allocate(cells: DataFrame, total: int) -> DataFrame:
    """Captures per weighted cell by largest remainders; they add up to ``total``. Ties go to the smaller cell."""
    whole = cells.agg(F.sum(F.greatest("weight", F.lit(1e-6))).alias("all"))  # one row
    rows = cells.crossJoin(F.broadcast(whole)).withColumn("want", F.greatest("weight", F.lit(1e-6)) / F.col("all") * total)
    rows = rows.withColumn("base", F.floor("want")).withColumn("rest", F.round(F.col("want") - F.col("base"), 9))
    missing = int(rows.agg(F.lit(total) - F.sum("base")).first()[0] or 0)  # fewer than there are cells, and than ``total``
    more = rows.orderBy(F.desc("rest"), "ce", "cn").limit(missing).select("ce", "cn", F.lit(1).alias("more"))
    rows = rows.join(more, ["ce", "cn"], "left").withColumn("n", (F.col("base") + F.coalesce("more", F.lit(0))).cast("long"))
    return rows.drop("all", "want", "base", "rest", "more")


def targeted_poses(cells: DataFrame, size: float, seed: int) -> DataFrame:
    """The allocated captures of each cell (``ce``, ``cn``, ``n``) as poses spread over the cell by hashes of their number."""
    unit = lambda k: F.pmod(F.xxhash64("ce", "cn", "number", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    rows = cells.where("n > 0").withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select("ce", "cn", "number", ((F.col("ce") + unit(1)) * size).alias("e"), ((F.col("cn") + unit(2)) * size).alias("n"), (360 * unit(3)).alias("yaw"))


def probes(bounds: DataFrame, n: int, seed: int, low: float, high: float) -> DataFrame:
    """``n`` poses spread by hashes of their number, so that a plan can be made again."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    span = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (0.1 + 0.8 * unit(k))
    rows = bounds.crossJoin(bounds.sparkSession.range(n))  # one row of bounds
    return rows.select("id", span("x0", "x1", 1).alias("x"), span("z0", "z1", 2).alias("z"), (F.lit(low * 0.9) + (high * 1.1 - low * 0.9) * unit(3)).alias("agl"), (360 * unit(4)).alias("yaw"))


def shuffled(poses: DataFrame, key: str, seed: int, cap: int) -> DataFrame:
    """The first ``cap`` poses in a seeded order."""
    return poses.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(cap)


def tile_of(rows: DataFrame, bounds: DataFrame, e: str, n: str, across: int, up: int) -> DataFrame:
    """Adds ``inside`` (the first tile of an even grid that holds the row's place; edges belong to both neighbours) and
    ``nearest`` (the tile whose centre is nearest), by arithmetic on the grid's bounds. ``bounds`` is one row (e0, e1, n0, n1)."""
    at = lambda x, low, high, k: F.ceil((F.col(x) - F.col(low)) * k / F.greatest(F.col(high) - F.col(low), F.lit(1e-9))) - 1
    clamped = lambda x, k: F.greatest(F.lit(0), F.least(F.lit(k - 1), x))
    i, j = clamped(at(e, "e0", "e1", across), across), clamped(at(n, "n0", "n1", up), up)
    name = F.concat(F.lit("t"), i.cast("string"), F.lit("_"), j.cast("string"))
    held = F.col(e).between(F.col("e0"), F.col("e1")) & F.col(n).between(F.col("n0"), F.col("n1"))
    out = rows.crossJoin(F.broadcast(bounds)).withColumn("nearest", name)
    return out.withColumn("inside", F.when(held, F.col("nearest"))).drop("e0", "e1", "n0", "n1")

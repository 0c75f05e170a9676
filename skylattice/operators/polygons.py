"""Burning polygons with holes into a raster: an edge table, crossings by raster row, even-odd spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RINGS = "array<array<struct<x: double, y: double>>>"


def ring_edges(rings: Column) -> Column:
    """Edges (ax, ay, bx, by) of all rings; an open ring is closed. Rings of fewer than three points have none."""

    def of(ring: Column) -> Column:
        whole = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
        pairs = F.arrays_zip(F.slice(whole, 1, F.size(whole) - 1).alias("a"), F.slice(whole, 2, F.size(whole) - 1).alias("b"))
        edge = lambda p: F.struct(p["a"]["x"].alias("ax"), p["a"]["y"].alias("ay"), p["b"]["x"].alias("bx"), p["b"]["y"].alias("by"))
        return F.when(F.size(ring) >= 3, F.transform(pairs, edge)).otherwise(F.array().cast("array<struct<ax: double, ay: double, bx: double, by: double>>"))

    return F.flatten(F.transform(rings, of))


def spans(shapes: DataFrame, key: str, rings: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """Runs of texels (``key``, row, c0, c1) whose centres lie inside of each shape by the even-odd rule.

    ``rings`` is an array of rings in texel units: outer rings and holes alike. A texel (row, col) has its centre at
    (col + 0.5, row + 0.5). An edge crosses the rows whose centre line lies in [low, high) of it, so that a vertex counts
    once, and a run holds the centres in [left, right). Edges are spread over their rows before anything is put in order,
    so a large shape is many small groups: those of one shape and row. ``rows`` cuts edges to the raster's own rows.
    """
    edges = shapes.select(key, F.explode(ring_edges(F.col(rings))).alias("s")).select(key, "s.*")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    if rows is not None:
        first, last = F.greatest(first, F.lit(rows[0])), F.least(last, F.lit(rows[1]))
    edges = edges.withColumn("first", first).withColumn("last", last).where(F.col("first") <= F.col("last"))
    crossed = edges.withColumn("row", F.explode(F.sequence("first", "last")))
    at = F.col("ax") + (F.col("row") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    w = Window.partitionBy(key, "row").orderBy("x")
    paired = crossed.select(key, "row", at.alias("x")).withColumn("next", F.lead("x").over(w)).withColumn("k", F.row_number().over(w))
    runs = paired.where("k % 2 = 1").select(key, "row", F.ceil(F.col("x") - 0.5).alias("c0"), (F.ceil(F.col("next") - 0.5) - 1).alias("c1"))
    return runs.where("c0 <= c1")


def burn_polygons(texels: DataFrame, shapes: DataFrame, seq: str, values: list[str], rings: str = "rings", block: int = 64) -> DataFrame:
    """The last shape (by ``seq``, which is unique) that covers each of ``texels`` (row, col), with its ``values``.

    Runs are cut into blocks of ``block`` columns and joined with the texels of their row and block: a texel meets only
    runs beside it, and a wide run is spread over many tasks.
    """
    runs = spans(shapes, seq, rings)
    runs = runs.join(shapes.select(seq, *[v for v in values if v != seq]), seq)
    pieces = runs.withColumn("bc", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor(F.col("c1") / block))))
    near = texels.select("row", "col").withColumn("bc", F.floor(F.col("col") / block)).join(pieces, ["row", "bc"])
    hit = near.where(F.col("col").between(F.col("c0"), F.col("c1")))
    return hit.groupBy("row", "col").agg(F.max_by(F.struct(*values), seq).alias("top")).select("row", "col", "top.*")


def to_texels(rings: Column, lon0: float, lat0: float, res: float) -> Column:
    """Rings of (lat, lon) in texel units of a raster whose corner is at (lon0, lat0), in the flat-earth plane."""
    from skylattice.functions import geo

    def point(p: Column) -> Column:
        e, n = geo.lonlat_to_plane(p["lon"], p["lat"], lon0, lat0)
        return F.struct((e / res).alias("x"), (n / res).alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, point))

"""Open map themes as Parquet tables laid out along a space-filling curve, and scans of them by box.

A theme's table has nested extents ``bbox`` (xmin, xmax, ymin, ymax) and nested geometry (polygons of rings of points, or
lines of points). Rows are put in the order of the Z curve over the middle of their extents, so that a file and a row group
hold neighbours and have small extents of their own: a box filter on ``bbox`` then prunes by both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import features

POINT = "struct<x: double, y: double>"
POLYGONS, LINES = f"array<array<array<{POINT}>>>", f"array<array<{POINT}>>"
BITS = 16
#: Ground kinds of land and land use.
GREEN_OF_CLASS = {
    "forest": "forest_broadleaf", "wood": "forest_broadleaf", "tree": "forest_broadleaf", "shrub": "green", "shrubbery": "green", "scrub": "green", "grass": "green", "grassland": "green", "meadow": "green",
    "park": "green", "garden": "green", "cemetery": "green", "recreation_ground": "green", "golf_course": "green", "vineyard": "green", "orchard": "green", "allotments": "green", "village_green": "green",
}


def z_order(x: Column, y: Column) -> Column:
    """Place on the Z curve of two shares (0 to 1): their bits in turn."""

    def spaced(share: Column) -> Column:
        n = F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
        out = F.lit(0).cast("long")
        for k in range(BITS):
            out = out + F.shiftleft(F.shiftright(n, k).bitwiseAND(F.lit(1).cast("long")), 2 * k)
        return out

    return spaced(x) + 2 * spaced(y)


def write_theme(rows: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """Writes ``rows`` (with ``bbox``) along the curve; ``group_bytes`` is the size of a row group."""
    held = lambda f, k: f(F.col(f"bbox.{k}")).alias(k)
    whole = rows.agg(held(F.min, "xmin"), held(F.max, "xmax"), held(F.min, "ymin"), held(F.max, "ymax"))  # one row
    share = lambda a, b: F.when(F.col(b) > F.col(a), ((F.col(f"bbox.{a}") + F.col(f"bbox.{b}")) / 2 - F.col(a)) / (F.col(b) - F.col(a))).otherwise(0.0)
    placed = rows.crossJoin(F.broadcast(whole)).withColumn("__z", z_order(share("xmin", "xmax"), share("ymin", "ymax")))
    ordered = placed.repartitionByRange("__z").sortWithinPartitions("__z").select(*rows.columns)
    ordered.write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 2000).parquet(path)


def scan(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose extent meets the box (west, south, east, north), edges included."""
    west, south, east, north = box
    return spark.read.parquet(path).where((F.col("bbox.xmax") >= west) & (F.col("bbox.xmin") <= east) & (F.col("bbox.ymax") >= south) & (F.col("bbox.ymin") <= north))


def buildings(rows: DataFrame) -> DataFrame:
    """A row per polygon: id, part_no, ring, holes, height_m, source, cls, of rows with height, num_floors, class, subtype."""
    height, source = features.open_height(F.col("height"), F.col("num_floors"))
    parts = rows.select("id", height.alias("height_m"), source.alias("source"), features.open_class(F.col("class"), F.col("subtype")).alias("cls"), F.posexplode("geometry").alias("part_no", "p"))
    return parts.select("id", "part_no", F.col("p")[0].alias("ring"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("holes"), "height_m", "source", "cls")


def landcover(land: DataFrame, land_use: DataFrame, water: DataFrame, segments: DataFrame) -> DataFrame:
    """One table of ground features, a row per polygon or line: theme, id, part_no, kind, width_m, points."""
    kind = F.coalesce(features.lookup(F.lower("class"), GREEN_OF_CLASS), features.lookup(F.lower("subtype"), GREEN_OF_CLASS))
    width = features.lookup(F.lower(F.coalesce("class", F.lit("unknown"))), features.SEGMENT_WIDTHS, 5.0)
    none = F.lit(None).cast("double")

    def areas(rows: DataFrame, theme: str, of: Column) -> DataFrame:
        found = rows.select(F.lit(theme).alias("theme"), "id", of.alias("kind"), F.posexplode("geometry").alias("part_no", "p")).where("kind is not null")
        return found.select("theme", "id", "part_no", "kind", none.alias("width_m"), F.col("p")[0].alias("points"))

    roads = segments.where("subtype = 'road'").select(F.lit("segment").alias("theme"), "id", F.lit("road").alias("kind"), width.alias("width_m"), F.posexplode("geometry").alias("part_no", "points"))
    out = areas(land, "land", kind).unionByName(areas(land_use, "land_use", kind)).unionByName(areas(water, "water", F.lit("water")))
    return out.unionByName(roads.select("theme", "id", "part_no", "kind", "width_m", "points"))

"""Vector features: parsing map elements, matching, imputation, burning parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions import features, geo

POINT = "struct<lat: double, lon: double>"
ELEMENTS = (
    f"elements array<struct<type: string, id: bigint, lat: double, lon: double, center: {POINT}, tags: map<string, string>, geometry: array<{POINT}>, "
    f"members: array<struct<type: string, role: string, geometry: array<{POINT}>>>>>"
)


def read_elements(spark, path: str, multi_line: bool = False) -> DataFrame:
    """One row per element of map-element JSON documents: one document a line, or a file with ``multi_line``."""
    return spark.read.schema(ELEMENTS).option("multiLine", multi_line).option("mode", "FAILFAST").json(path).select(F.explode("elements").alias("el")).select("el.*")


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def parse_buildings(elements: DataFrame) -> DataFrame:
    """A row per outer ring: ways have one, relations one for each outer member, with the inner ones as holes."""
    el = elements.where(tag("building").isNotNull() | tag("building:part").isNotNull())
    way = F.when((F.col("type") == "way") & F.col("geometry").isNotNull(), F.array("geometry"))
    of = lambda role: F.transform(F.filter("members", lambda m: (m["role"] == role) & m["geometry"].isNotNull()), lambda m: m["geometry"])
    outers = F.coalesce(way, F.when(F.col("type") == "relation", of("outer")))
    holes = F.when(F.col("type") == "relation", of("inner"))
    rows = el.withColumn("holes", F.coalesce(holes, F.array().cast(f"array<array<{POINT}>>"))).withColumn("outers", outers)
    rows = rows.select("id", "tags", "holes", F.posexplode("outers").alias("part_no", "ring"))
    height, source = features.tag_height(tag("height"), tag("building:height"), tag("building:levels"))
    return rows.select(
        F.col("id").alias("osm_id"), "part_no", "ring", "holes", height.alias("height_m"), source.alias("height_source"),
        features.building_class(tag("building"), tag("man_made")).alias("cls"), tag("roof:shape").alias("roof_shape"), features.roof_height(tag("roof:height"), tag("roof:levels")).alias("roof_m"),
    )


def closed(ring: Column) -> Column:
    """At least four points, the last one equal to the first."""
    return (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def landcover_kinds(ring_closed: Column) -> Column:
    """Kinds and widths of a way, by the first tag that applies; a bridge adds a second feature."""
    bridge = F.coalesce(tag("bridge").isin("yes", "viaduct"), F.lit(False)) | F.coalesce(tag("man_made") == "bridge", F.lit(False))
    width = features.lookup(tag("highway"), features.ROAD_WIDTHS, 4.0)
    one = lambda kind, w=F.lit(None).cast("double"): F.struct(F.lit(kind).alias("kind"), w.alias("width_m"))
    none = F.array().cast("array<struct<kind: string, width_m: double>>")
    with_bridge = lambda kind, w: F.when(bridge, F.array(one(kind, w), one("bridge", w + 2.0))).otherwise(F.array(one(kind, w)))
    area = lambda kind: F.when(ring_closed, F.array(one(kind))).otherwise(none)
    is_ = lambda key, *values: F.coalesce(tag(key).isin(*values), F.lit(False))
    forest = F.when(F.coalesce(tag("leaf_type"), F.lit("broadleaved")).contains("needle"), area("forest_conifer")).otherwise(area("forest_broadleaf"))
    return (
        F.when(tag("highway").isNotNull(), with_bridge("road", width))
        .when(tag("railway").isNotNull(), with_bridge("rail", F.lit(5.0)))
        .when(is_("natural", "water") | is_("waterway", "riverbank"), area("water"))
        .when(is_("amenity", "parking"), area("parking"))
        .when(is_("landuse", "forest") | is_("natural", "wood", "scrub"), forest)
        .otherwise(area("green"))
    )


def parse_landcover(elements: DataFrame) -> DataFrame:
    ways = elements.where((F.col("type") == "way") & F.col("geometry").isNotNull())
    rows = ways.withColumn("f", F.explode(landcover_kinds(closed(F.col("geometry")))))
    return rows.select(F.col("id").alias("osm_id"), "f.kind", "f.width_m", F.col("geometry").alias("points"))


def parse_pois(elements: DataFrame) -> DataFrame:
    """Points of interest: at the node, the centre, or the mean of the vertices."""
    mean = lambda k: F.aggregate("geometry", F.lit(0.0), lambda a, p: a + p[k]) / F.size("geometry")
    at = lambda k: F.when(F.col("type") == "node", F.col(k)).otherwise(F.coalesce(F.col(f"center.{k}"), F.when(F.size("geometry") > 0, mean(k))))
    arch = features.archetype_of_tags(F.col("tags"))
    rows = elements.where(F.col("tags").isNotNull() & ~((F.col("type") == "way") & tag("building:part").isNotNull() & F.col("geometry").isNotNull()))
    rows = rows.select("id", tag("name").alias("name"), tag("wikidata").alias("wikidata"), arch.alias("archetype"), at("lon").alias("lon"), at("lat").alias("lat"), "tags")
    return rows.where(F.col("lon").isNotNull() & (tag("historic").isNotNull() | tag("tourism").isNotNull() | F.col("archetype").isNotNull()))


def parse_parts(elements: DataFrame) -> DataFrame:
    """Building parts with their height (6 m by default) and the height they begin at."""
    height, _ = features.tag_height(tag("height"), tag("building:height"), tag("building:levels"))
    low = F.split(F.coalesce(tag("min_height"), tag("building:min_level")), r"\s+")[0].try_cast("double")
    low = F.when(tag("min_height").isNull() & tag("building:min_level").isNotNull(), low * 3).otherwise(low)
    rows = elements.where((F.col("type") == "way") & tag("building:part").isNotNull() & F.col("geometry").isNotNull())
    return rows.select("id", F.col("geometry").alias("ring"), F.coalesce(height, F.lit(6.0)).alias("height_m"), F.coalesce(low, F.lit(0.0)).alias("min_m"))


def ring_area(ring: Column, x: str = "e", y: str = "n") -> Column:
    """Shoelace area of a closed ring."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"][x] * p["b"][y] - p["b"][x] * p["a"][y])) / 2


def neighbour_heights(buildings: DataFrame, radius: float = 250.0, least: int = 3) -> DataFrame:
    """Missing heights from the median of the known ones in the 3 x 3 cells around, where there are ``least`` or more.

    Only heights that were known at first count, so the result does not depend on an order. A cell's heights go to its
    nine neighbours as the list of its own values; buildings look their cell up once.
    """
    placed = buildings.select("*", *[x.alias(k) for k, x in zip(("ci", "cj"), geo.plane_cell(F.col("e"), F.col("n"), radius))])
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    known = placed.where("height_m is not null").withColumn("s", F.explode(steps))
    around = known.select((F.col("ci") + F.col("s.a")).alias("ci"), (F.col("cj") + F.col("s.b")).alias("cj"), "height_m")
    near = around.groupBy("ci", "cj").agg(F.median("height_m").alias("near"), F.count("*").alias("k")).where(F.col("k") >= least)
    out = placed.join(near, ["ci", "cj"], "left")
    fill = F.col("height_m").isNull() & F.col("near").isNotNull()
    return (
        out.withColumn("height_source", F.when(fill, "neighbor_median").otherwise(F.col("height_source")))
        .withColumn("height_m", F.coalesce("height_m", "near"))
        .drop("ci", "cj", "near", "k")
    )


def burn_height(height: Column, cls: Column, cap: float = 400.0) -> Column:
    """Height to burn: the known one, else the class's; ``cap`` at most."""
    return F.least(F.coalesce(height, features.lookup(cls, features.CLASS_HEIGHTS, 6.0)), F.lit(cap))

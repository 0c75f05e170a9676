"""Map features as column expressions: tags, heights, classes, colours, keys, failure policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CLASS_OF_TAG = {
    "residential": "residential", "house": "residential", "apartments": "residential", "detached": "residential", "terrace": "residential",
    "industrial": "industrial", "warehouse": "industrial", "factory": "industrial", "commercial": "commercial", "retail": "commercial", "office": "commercial",
    "church": "landmark", "cathedral": "landmark", "tower": "landmark", "castle": "landmark", "campanile": "landmark",
}
CLASS_OF_SUBTYPE = {"residential": "residential", "industrial": "industrial", "commercial": "commercial", "religious": "landmark", "civic": "commercial", "outbuilding": "generic"}
CLASS_HEIGHTS = {"generic": 6.0, "residential": 7.0, "industrial": 9.0, "commercial": 12.0, "landmark": 25.0}
CLASS_IDS = {"generic": 10, "residential": 11, "industrial": 12, "commercial": 13, "landmark": 14}
ROAD_WIDTHS = {"motorway": 16.0, "trunk": 14.0, "primary": 10.0, "secondary": 8.0, "tertiary": 7.0, "residential": 6.0, "unclassified": 5.0, "service": 4.0}
SEGMENT_WIDTHS = {"motorway": 16.0, "trunk": 14.0, "primary": 10.0, "secondary": 8.0, "tertiary": 7.0, "residential": 6.0, "unknown": 5.0}
ARCHETYPE_OF_TAG = [
    ("man_made", "tower", "spire_tower"), ("man_made", "water_tower", "cap_tower"), ("man_made", "chimney", "spire_tower"), ("historic", "castle", "crenellated"),
    ("historic", "fort", "crenellated"), ("historic", "tower", "crenellated_tower"), ("building", "church", "dome"), ("building", "cathedral", "dome"),
    ("building", "mosque", "dome"), ("building", "tower", "spire_tower"),
]
ARCHETYPE_OF_CATEGORY = [
    ("castle", "crenellated"), ("fortress", "crenellated"), ("fort", "crenellated"), ("church", "dome"), ("cathedral", "dome"), ("basilica", "dome"),
    ("mosque", "dome"), ("synagogue", "dome"), ("tower", "spire_tower"), ("lighthouse", "spire_tower"), ("monument", "spire_tower"), ("landmark", None),
    ("tourist_attraction", None), ("historic", None), ("government_building", None), ("city_hall", None),
]
ERROR_TOKENS = ["504", "503", "502", "429", "timed out", "timeout", "Connection"]
BLOCK_STATUS = [403, 429]
RETRY_STATUS = [403, 406, 429, 500, 502, 503, 504]


def lookup(key: Column, table: dict, default: Column | float | str | None = None) -> Column:
    """A small fixed table as a folded expression."""
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([\d.]+)", 1).try_cast("double")


def tag_height(height: Column, building_height: Column, levels: Column) -> list[Column]:
    """Metres and provenance: a leading number in a height tag, else levels of 3 m each, else none."""
    tagged = leading_number(F.coalesce(F.nullif(height, F.lit("")), building_height))
    by_level = leading_number(levels) * 3
    source = F.when(tagged.isNotNull(), "tag_height").when(by_level.isNotNull(), "tag_levels").otherwise("none")
    return [F.coalesce(tagged, by_level), source]


def roof_height(height: Column, levels: Column) -> Column:
    first = lambda c: F.split(F.trim(c), r"\s+")[0].try_cast("double")
    return F.coalesce(first(height), first(levels) * 2.5)


def building_class(building: Column, man_made: Column) -> Column:
    tower = F.when(man_made.isin("tower", "chimney", "water_tower"), "landmark").otherwise("generic")
    return lookup(F.lower(F.coalesce(building, F.lit("yes"))), CLASS_OF_TAG, tower)


def open_class(class_: Column, subtype: Column) -> Column:
    kind = F.lower(F.coalesce(F.nullif(class_, F.lit("")), subtype, F.lit("")))
    return lookup(kind, CLASS_OF_TAG, lookup(F.lower(F.coalesce(subtype, F.lit(""))), CLASS_OF_SUBTYPE, "generic"))


def open_height(height: Column, floors: Column) -> list[Column]:
    by_floor = F.when(floors != 0, floors * 3.0)
    source = F.when(height > 0, "tag_height").when(by_floor.isNotNull(), "tag_levels").otherwise("none")
    return [F.when(height > 0, height).otherwise(by_floor), source]


def archetype_of_tags(tags: Column) -> Column:
    return F.coalesce(*[F.when(F.try_element_at(tags, F.lit(k)) == v, F.lit(a)) for k, v, a in ARCHETYPE_OF_TAG])


def category_hit(primary: Column, alternates: Column, fragment: str) -> Column:
    return F.coalesce(F.lower(primary).contains(fragment), F.lit(False)) | F.coalesce(F.exists(alternates, lambda c: F.lower(c).contains(fragment)), F.lit(False))


def archetype_of_category(primary: Column, alternates: Column) -> list[Column]:
    """Whether a place is a landmark, and its archetype if a fragment names one."""
    hits = [(category_hit(primary, alternates, f), a) for f, a in ARCHETYPE_OF_CATEGORY]
    relevant = hits[0][0]
    for h, _ in hits[1:]:
        relevant = relevant | h
    return [relevant, F.coalesce(*[F.when(h, F.lit(a)) for h, a in hits if a])]


def hex_colour(text: Column) -> list[Column]:
    """Red, green and blue as shares of 255, null unless six hexadecimal digits."""
    digits = F.regexp_replace(F.trim(text), "^#+", "")
    fine = digits.rlike("^[0-9A-Fa-f]{6}$")
    return [F.when(fine, F.conv(F.substring(digits, k, 2), 16, 10).cast("double") / 255) for k in (1, 3, 5)]


def ring_key(ring: Column) -> Column:
    """Size and end points of a ring of (lon, lat), to six places."""
    point = lambda p: F.concat(F.format_string("%.6f", p["lon"]), F.lit(","), F.format_string("%.6f", p["lat"]))
    return F.when(F.size(ring) < 1, "-").otherwise(
        F.concat_ws(":", F.size(ring).cast("string"), point(F.element_at(ring, 1)), point(F.element_at(ring, -1)))
    )


def error_signature(message: Column, kind: Column) -> Column:
    out = F
    for token in ERROR_TOKENS:
        out = out.when(message.contains(token), token)
    return out.otherwise(kind)


def failure_action(policy: Column) -> Column:
    """The policy's action; null for an unknown policy."""
    return F.when(policy.isin("defer", "skip", "abort", "fallback"), F.upper(policy))


def scene_of(name: Column) -> list[Column]:
    """Tile and day of a scene's name; the day is null if the name has another form."""
    parts = F.split(name, "_")
    fits = (F.size(parts) >= 3) & (F.length(F.get(parts, F.lit(2))) == 8)
    return [F.get(parts, F.lit(1)), F.when(fits, F.try_to_date(F.get(parts, F.lit(2)), "yyyyMMdd"))]


def rate_limited(status: Column, body: Column) -> Column:
    words = F.lower(F.substring(body, 1, 2000))
    said = words.contains("rate_limited") | words.contains("too many requests")
    return status.isin(BLOCK_STATUS) | (status.isin(RETRY_STATUS) & F.coalesce(said, F.lit(False)))

"""Texels, colours and shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.functions.features import lookup

# Fixed values.
CLASS_COLOURS = {
    0: (0.52, 0.49, 0.42), 1: (0.30, 0.44, 0.24), 2: (0.10, 0.20, 0.34), 3: (0.22, 0.22, 0.24), 4: (0.30, 0.26, 0.24), 5: (0.45, 0.44, 0.42),
    6: (0.20, 0.35, 0.16), 7: (0.14, 0.28, 0.18), 10: (0.64, 0.42, 0.30), 11: (0.68, 0.40, 0.27), 12: (0.56, 0.57, 0.62), 13: (0.58, 0.48, 0.38), 14: (0.80, 0.73, 0.58),
}
SPECKLE = {2: 0.015, 3: 0.05, 4: 0.06}
SPECKLE_ELSE = 0.12
CANOPY = {6: 16.0, 7: 22.0}
CANOPY_GAPS = 0.18
WALLS = [(0.80, 0.78, 0.72), (0.74, 0.70, 0.62), (0.66, 0.64, 0.60), (0.86, 0.84, 0.80)]
#: Colours of walls and roofs that no image shows.
DEFAULT_WALLS = [(0.85, 0.80, 0.70), (0.90, 0.87, 0.80), (0.78, 0.70, 0.58)]
DEFAULT_ROOFS = [(0.64, 0.42, 0.30), (0.55, 0.36, 0.28), (0.48, 0.45, 0.44)]
LUMA = (0.299, 0.587, 0.114)


def texel_bits(row: Column, col: Column) -> Column:
    return (row.cast("long") * 73856093).bitwiseXOR(col.cast("long") * 19349663).bitwiseAND(F.lit(65535))


def texel_hash(row: Column, col: Column) -> Column:
    """0 to 1, the same for a texel everywhere."""
    return texel_bits(row, col) / 65535.0


def wall_index(row: Column, col: Column, res: float, walls: int = len(WALLS)) -> Column:
    """Tone of a facade, one for each block of 16 m."""
    block = max(1, int(16 / res))
    part = lambda c: F.floor(c / block)
    return F.pmod((part(row) * 40503).bitwiseXOR(part(col) * 30011), F.lit(walls))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def texel_colour(row: Column, col: Column, cls: Column, step: Column, res: float) -> list[Column]:
    """Red, green, blue: the class's colour, blended towards a facade tone by the height step, with speckle."""
    share = clip(step / 6.0, 0.0, 1.0)
    noise = (texel_hash(row, col) - 0.5) * lookup(cls, SPECKLE, SPECKLE_ELSE)
    tone = wall_index(row, col, res)
    out = []
    for k in range(3):
        base = lookup(cls, {c: v[k] for c, v in CLASS_COLOURS.items()})
        wall = lookup(tone, {i: w[k] for i, w in enumerate(WALLS)}) * 0.92
        out.append(clip(base * (1 - share) + wall * share + noise, 0.03, 0.97))
    return out


def canopy_height(row: Column, col: Column, cls: Column, build_h: Column) -> Column:
    noise = texel_hash(row, col)
    grown = lookup(cls, CANOPY, 0.0) * (0.7 + 0.5 * noise)
    return F.when((build_h > 0) | (noise < CANOPY_GAPS), 0.0).otherwise(grown)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue (degrees), saturation and value of components in 0 to 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, F.pmod(60 * F.try_divide(g - b, span), F.lit(360.0))).when(top == g, 60 * F.try_divide(b - r, span) + 120).otherwise(60 * F.try_divide(r - g, span) + 240)
    return [hue, F.coalesce(F.try_divide(span, top), F.lit(0.0)), top]


#: Bounds of wall and roof colours, hues as parts of the circle.
WALL_SATURATION, WALL_VALUE, SKY_HUE, GREEN_HUE = 0.38, (0.42, 0.97), (0.52, 0.72), (0.18, 0.45)
ROOF_HUE, ROOF_SATURATION, ROOF_VALUE = (0.12, 0.93), 0.25, (0.20, 0.95)


def _gates(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue as a part of the circle, saturation and value; what lies on a bound counts as being on it."""
    h, s, v = hsv(r, g, b)
    return [F.round(x, 6) for x in (h / 360, s, v)]


def wall_candidate(r: Column, g: Column, b: Column) -> Column:
    """Pale and not too dark or bright: plaster. Sky and plants are not."""
    h, s, v = _gates(r, g, b)
    within = lambda x, a, z: (x > a) & (x < z)
    sky, green = within(h, *SKY_HUE) & (s > 0.15), within(h, *GREEN_HUE) & (s > 0.22)
    return (s < WALL_SATURATION) & within(v, *WALL_VALUE) & ~sky & ~green


def roof_candidate(r: Column, g: Column, b: Column) -> Column:
    """Warm and saturated, not too dark or bright: tiles."""
    h, s, v = _gates(r, g, b)
    return ((h < ROOF_HUE[0]) | (h > ROOF_HUE[1])) & (s > ROOF_SATURATION) & (v > ROOF_VALUE[0]) & (v < ROOF_VALUE[1])


def to_byte(x: Column, scene_max: Column) -> Column:
    """A component as 0 to 255; scenes in 0 to 1 and in 0 to 255 are told apart by their maximum."""
    return F.bround(clip(F.when(scene_max <= 1.5, x * 255).otherwise(x), 0.0, 255.0)).cast("int")


def splat_weights(cls: Column) -> list[Column]:
    """Base, green, hard and water layer of a class, 0 or 255."""
    on = lambda c: F.when(c, 255).otherwise(0)
    green, hard, water = on(cls.isin(1, 6, 7)), on(cls.isin(3, 4, 5)), on(cls == 2)
    return [255 - F.greatest(green, hard, water), green, hard, water]


def archetype_height(archetype: Column, h: Column, radius: Column, max_radius: Column, angle: Column, res: float) -> Column:
    """Height of a landmark's texel by its distance and angle from the footprint's centre; null for other archetypes."""
    near = clip(1 - radius / max_radius, 0.0, 1.0)
    bowl = lambda r: F.sqrt(clip(1 - F.pow(radius / r, 2), 0.0, 1.0))
    tooth = (F.pmod(F.floor(angle * max_radius / 2 / max(2.0, 2 * res)), F.lit(2)) == 0) & (radius > max_radius * 0.72)
    return (
        F.when(archetype == "spire_tower", h * (1 + 0.45 * near))
        .when(archetype == "cap_tower", h * (1 + 0.2 * bowl(max_radius)))
        .when(archetype == "dome", h + 0.5 * h * bowl(max_radius * 0.6))
        .when(archetype.isin("crenellated", "crenellated_tower"), F.when(tooth, h * 1.15).otherwise(h))
    )


def roof(shape: Column, roof_h: Column, cls: Column, width: Column, area: Column, holes: Column, fill: Column, height: Column) -> list[Column]:
    """Roof shape and height; a shape that is not given is guessed, and irregular footprints get a flat one."""
    given = F.lower(F.coalesce(shape, F.lit("")))
    guess = F.when(cls.isin("residential", "generic") & (width < 20) & (area < 650) & (holes == 0), "gabled").otherwise("flat")
    wanted = F.when(given.isin("", "no", "unknown"), guess).otherwise(given)
    kept = F.when((fill < 0.8) | (holes > 0) | (width < 4), "flat").otherwise(wanted)
    high = F.coalesce(F.nullif(roof_h, F.lit(0.0)), clip(0.3 * width, 2.0, 7.0))
    return [kept, F.when(kept == "flat", 0.0).otherwise(F.least(high, F.greatest(height - 2, F.lit(0.0))))]

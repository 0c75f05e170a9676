"""Estimates, measurements and guidance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.functions.geo import heading_deg
from skylattice.functions.raster import clip


def within_probability(target_m: float, sigma: Column) -> Column:
    """Probability of a horizontal error below ``target_m`` (Rayleigh)."""
    return 1 - F.exp(-(target_m**2) / (2 * sigma * sigma))


def confidence(initialized: Column, sigma: Column, health: Column, target_m: float, floor_m: float) -> Column:
    p = within_probability(target_m, F.greatest(sigma, F.lit(floor_m))) * (0.3 + 0.7 * health)
    return F.when(initialized, clip(p, 0.0, 1.0)).otherwise(0.0)


def sigma_floor(p95_a: Column, p95_b: Column) -> Column:
    """From the better of two measured errors; 3 m at least, and if there is none."""
    return F.greatest(F.lit(3.0), F.coalesce(0.35 * F.least(p95_a, p95_b), F.lit(3.0)))


def fuse(ra: list[Column], sigma_a: Column, rb: list[Column], sigma_b: Column, target_m: float) -> dict[str, Column]:
    """Inverse-variance fusion of two fixes, with their agreement and the confidence it leaves."""
    sa, sb = F.greatest(sigma_a, F.lit(2.0)), F.greatest(sigma_b, F.lit(2.0))
    wa, wb = 1 / (sa * sa), 1 / (sb * sb)
    apart = F.sqrt((ra[0] - rb[0]) * (ra[0] - rb[0]) + (ra[1] - rb[1]) * (ra[1] - rb[1]))
    agreement = F.exp(-0.5 * F.pow(apart / F.sqrt(sa * sa + sb * sb), 2))
    effective = F.sqrt(1 / (wa + wb)) / F.greatest(agreement, F.lit(0.05))
    mixed = [(a * wa + b * wb) / (wa + wb) for a, b in zip(ra, rb)]
    return {"e": mixed[0], "n": mixed[1], "u": mixed[2], "agreement": agreement, "sigma": effective, "confidence": within_probability(target_m, effective) * (0.5 + 0.5 * agreement)}


def target_confidence(spread: Column, disagreement: Column) -> Column:
    return clip(1 / (1 + spread / 30 + disagreement / 100), 0.0, 1.0)


def regression_covariance(sigma: Column, scale: float, floor_m: float) -> list[Column]:
    """Variances (east, north, up); altitude counts as the weakest axis."""
    s = F.greatest(sigma * scale, F.lit(floor_m))
    return [s * s, s * s, 2 * s * s]


def velocity_sigma(inliers: Column) -> Column:
    return clip(6 / F.sqrt(F.greatest(inliers, F.lit(1))), 0.6, 3.0)


def guidance(drone: list[Column], target: list[Column], fallback_deg: Column, standoff: float, arrival: float, altitude: float) -> dict[str, Column]:
    """Goal at the stand-off distance on the drone's side of the target, and how to get there."""
    dx, dy = target[0] - drone[0], target[1] - drone[1]
    far = F.sqrt(dx * dx + dy * dy)
    back = F.radians(F.pmod(fallback_deg + 180, F.lit(360.0)))
    ax = F.when(far > 1e-6, F.try_divide(-dx, far)).otherwise(F.sin(back))
    ay = F.when(far > 1e-6, F.try_divide(-dy, far)).otherwise(F.cos(back))
    ge, gn = target[0] + ax * standoff, target[1] + ay * standoff
    te, tn, tu = ge - drone[0], gn - drone[1], target[2] - drone[2]
    left = F.sqrt(te * te + tn * tn)
    return {
        "goal_e": ge, "goal_n": gn, "goal_u": target[2], "bearing": F.when(left > 1e-6, heading_deg(te, tn)).otherwise(fallback_deg), "goal_dist": left, "alt_delta": tu,
        "target_dist": far, "at_goal": (left < arrival) & (F.abs(tu) < altitude), "violation": far < standoff * 0.98,
    }


def level_ray(px: Column, py: Column, width: int, height: int, focal: float, pitch_deg: float) -> list[Column]:
    """Right, forward and up of a pixel's ray after the camera's tilt is taken out."""
    import math

    s, c = math.sin(math.radians(pitch_deg)), math.cos(math.radians(pitch_deg))
    x, y = (px - width / 2) / focal, (height / 2 - py) / focal
    return [x, F.lit(c) - s * y, c * y + s]


def body_to_world(right: Column, forward: Column, heading: Column) -> list[Column]:
    s, c = F.sin(F.radians(heading)), F.cos(F.radians(heading))
    return [right * c + forward * s, forward * c - right * s]


def regression_output(scaled: list[Column], log_var: Column, hx: Column, hy: Column, log_var_heading: Column, scale_m: float) -> dict[str, Column]:
    """A scaled network output in metres and degrees."""
    return {
        "e": scaled[0] * scale_m, "n": scaled[1] * scale_m, "u": scaled[2] * scale_m, "heading": heading_deg(hx, hy),
        "sigma": F.exp(0.5 * log_var) * scale_m / 3**0.5, "sigma_heading": clip(F.degrees(F.exp(0.5 * log_var_heading)), 1.0, 90.0),
    }


def success(declared: Column, dist_at_arrival: Column, violation: Column, collided: Column, tolerance_m: float) -> Column:
    return declared & (dist_at_arrival <= tolerance_m) & ~violation & ~collided


def retrieval_covariance(variances: tuple[Column, Column, Column], floor_m: float) -> tuple[Column, Column, Column]:
    """Variances of a retrieved position: the consensus' own spread and, added to it, the square of the least sigma."""
    return tuple(v + floor_m * floor_m for v in variances)

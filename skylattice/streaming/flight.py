"""Stateful operators over sensor frames: stream joins, newest frames, particle filter, tile hand-off, sinks, metrics.

The error-state filter is in ``fusion``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.streaming.fusion import by_drone, flown

# Fixed values.
WATERMARK = "10 seconds"  # 50 frames at 5 Hz


def join_truth(sensor: DataFrame, truth: DataFrame) -> DataFrame:
    """Sensor frames with the truth of the same number and about the same time; later truth is given up.

    Both sides carry ``frame_id`` and the timestamp ``ts``; state is dropped once the watermark has passed.
    """
    left = sensor.withWatermark("ts", WATERMARK)
    right = truth.select(F.col("frame_id").alias("truth_id"), F.col("ts").alias("truth_ts"), *[c for c in truth.columns if c not in ("frame_id", "ts")])
    right = right.withWatermark("truth_ts", WATERMARK)
    on = (F.col("frame_id") == F.col("truth_id")) & F.col("truth_ts").between(F.col("ts") - F.expr(f"INTERVAL {WATERMARK}"), F.col("ts") + F.expr(f"INTERVAL {WATERMARK}"))
    return left.join(right, on).drop("truth_id", "truth_ts")


def newest_per_batch(batch: DataFrame, key: str = "drone") -> DataFrame:
    """Newest frame of each drone in a micro-batch and how many were dropped for it."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), "frame_id").alias("x"), (F.count("*") - 1).alias("dropped")).select(key, "x.*", "dropped")


def fix_score(xy: np.ndarray, yaw: np.ndarray, fix: np.ndarray, heading: float, sigma: float) -> np.ndarray:
    """Score (0 to 1) of particles against a fix: near it and turned like it."""
    turn = (yaw - heading + 180) % 360 - 180
    return np.exp(-0.5 * ((xy - fix) ** 2).sum(1) / sigma**2 - 0.5 * (turn / 20) ** 2)


def particle_flights(frames: DataFrame, particles: int = 500, seed: int = 0, beta: float = 8.0, score=fix_score) -> DataFrame:
    """Particle filter per drone over places and headings: seeded around the first fix, moved by the odometry between
    frames in body axes, weighed by exp(beta * score), resampled systematically when few particles carry the weight.
    A fix far off all particles seeds them anew. ``score`` takes places, headings, the fix, its heading and its sigma."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for new, rows in by_drone(batches):
            held = (np.random.default_rng([seed, int(rows["drone"].iloc[0])]), None, None, np.full(particles, 1 / particles), None, None) if new else held
            held, out = part(rows, *held)
            yield pd.DataFrame(out, columns=["drone", "frame_id", "e", "n", "yaw", "spread", "effective"])

    def part(rows: pd.DataFrame, rng, xy, yaw, w, last, last_turned) -> tuple[tuple, list]:
        """Some frames of a drone, after those that left these particles and the last fix and heading."""
        at = rows[["est_e", "est_n"]].to_numpy(dtype=float)
        turned, sigmas = rows["est_heading"].to_numpy(dtype=float), rows["sigma"].to_numpy(dtype=float)
        out = []
        for k, (drone, frame) in enumerate(zip(rows["drone"], rows["frame_id"])):
            fix, heading, sigma = at[k], turned[k], sigmas[k]
            if xy is None or np.hypot(*(w @ xy - fix)) > 6 * sigma + 60:
                xy, yaw, w = fix + rng.normal(size=(particles, 2)) * sigma, heading + rng.normal(size=particles) * 15, np.full(particles, 1 / particles)
            else:
                moved, was = fix - last, np.radians(last_turned)
                forward, right = moved @ (np.sin(was), np.cos(was)), moved @ (np.cos(was), -np.sin(was))
                rad = np.radians(yaw)
                xy = xy + np.stack([forward * np.sin(rad) + right * np.cos(rad), forward * np.cos(rad) - right * np.sin(rad)], 1) + rng.normal(size=xy.shape) * 3.0
                yaw = yaw + heading - last_turned + rng.normal(size=particles) * 2.0
            w = w * np.exp(beta * np.clip(score(xy, yaw, fix, heading, sigma), 0.0, 1.0))
            w = w / w.sum()
            mean, rad = w @ xy, np.radians(yaw)
            effective = 1 / (w * w).sum()
            spread = math.sqrt(max(float((w[:, None] * (xy - mean) ** 2).sum()), 0.0))
            out.append((drone, frame, mean[0], mean[1], math.degrees(math.atan2(w @ np.sin(rad), w @ np.cos(rad))) % 360, spread, effective))
            if effective < particles / 2:
                kept = resample(w, rng.random())
                xy, yaw, w = xy[kept], yaw[kept], np.full(particles, 1 / particles)
            last, last_turned = fix, heading
        return (rng, xy, yaw, w, last, last_turned), out

    return flown(frames).mapInPandas(run, "drone long, frame_id long, e double, n double, yaw double, spread double, effective double")


def resample(weights: np.ndarray, offset: float) -> np.ndarray:
    """Systematic resampling: indices at evenly spaced places of the cumulative weights."""
    places = (np.arange(len(weights)) + offset) / len(weights)
    return np.minimum(np.searchsorted(np.cumsum(weights), places), len(weights) - 1)


def route(frames: DataFrame, bounds: DataFrame, across: int, up: int) -> DataFrame:
    """Tile of each frame of an even grid and whether it was handed over from another tile.

    A drone that has no tile yet, or is lost, is routed by its coarse fix, to the nearest tile where that lies outside of
    all; otherwise its fine estimate decides, and outside of all tiles it keeps the one it has. ``frames`` has drone,
    frame_id, t, est_e, est_n, coarse_e, coarse_n and lost.
    """
    from pyspark.sql import Window

    from skylattice.operators.ingest import tile_of

    fine = tile_of(frames, bounds, "est_e", "est_n", across, up).withColumn("fine", F.col("inside")).drop("inside", "nearest")
    both = tile_of(fine, bounds, "coarse_e", "coarse_n", across, up)
    w = Window.partitionBy("drone").orderBy("t", "frame_id")
    wanted = F.when(F.col("lost") | (F.row_number().over(w) == 1), F.col("nearest")).otherwise(F.col("fine"))
    rows = both.withColumn("wanted", wanted).withColumn("tile", F.last("wanted", ignorenulls=True).over(w))
    handed = F.coalesce(F.col("tile") != F.lag("tile").over(w), F.lit(False))
    return rows.select("drone", "frame_id", "tile", handed.alias("handed"))


def sink_estimates(estimates: DataFrame, path: str, progress: str) -> None:
    """Hands every estimate of a stream to a table, once: a micro-batch writes to a folder of its own number, so that one
    that is run again replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    estimates.writeStream.foreachBatch(put).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


#: Sums that accuracy statistics are made of; they add up over micro-batches.
SUMS = ("n", "near", "err", "err2", "alt")


def batch_sums(batch: DataFrame, target_m: float) -> DataFrame:
    """Per drone: frames, those within the target, and sums of errors, of their squares and of altitude errors."""
    err = F.sqrt(F.pow(F.col("est_e") - F.col("truth_e"), 2) + F.pow(F.col("est_n") - F.col("truth_n"), 2))
    rows = batch.select("drone", err.alias("e"), F.abs(F.col("est_u") - F.col("truth_u")).alias("a"))
    return rows.groupBy("drone").agg(F.count("*").alias("n"), F.count_if(F.col("e") < target_m).alias("near"), F.sum("e").alias("err"), F.sum(F.col("e") * F.col("e")).alias("err2"), F.sum("a").alias("alt"))


def sums_to_metrics(sums: DataFrame) -> DataFrame:
    """Accuracy per drone from the sums of all micro-batches so far."""
    s = sums.groupBy("drone").agg(*[F.sum(k).alias(k) for k in SUMS])
    mean = lambda k: F.col(k) / F.col("n")
    return s.select("drone", "n", mean("err").alias("mean_error"), F.sqrt(mean("err2")).alias("rmse"), mean("alt").alias("alt_mae"), mean("near").alias("within_target"))

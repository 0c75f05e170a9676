"""Evaluation of estimates against truth: splits, error statistics, calibration, stop rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators.quantiles import exact_quantiles, with_quantiles

# Fixed values.
RAYLEIGH = {0.5: 1.1774, 0.68: 1.5096, 0.9: 2.1460, 0.95: 2.4477}


def spatial_split(df: DataFrame, cell_m: float, seed: int, share: float) -> DataFrame:
    """Adds the cell's bucket in [0, 1) and the split it falls into; a cell lies in one split as a whole."""
    ce, cn = geo.plane_cell(F.col("e"), F.col("n"), cell_m)
    digest = F.sha1(F.concat_ws(":", ce.cast("string"), cn.cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("ce", ce).withColumn("cn", cn).withColumn("bucket", bucket).withColumn("split", F.when(F.col("bucket") < share, "validation").otherwise("train"))


def horizontal_error() -> Column:
    return geo.distance(F.col("est_e"), F.col("est_n"), F.col("truth_e"), F.col("truth_n"))


def heading_error() -> Column:
    return F.abs(geo.wrap_deg(F.col("est_heading") - F.col("truth_heading")))


def accuracy(frames: DataFrame, target_m: float, key: str = "run") -> DataFrame:
    """Error statistics per ``key`` over initialized frames; a key without any has null statistics."""
    on = F.col("initialized")
    err, alt, turn = (F.when(on, x) for x in (horizontal_error(), F.abs(F.col("est_u") - F.col("truth_u")), heading_error()))
    part = frames.select(key, on.alias("on"), err.alias("err"), alt.alias("alt"), turn.alias("turn"), F.when(on, F.col("confidence")).alias("conf"))
    return part.groupBy(key).agg(
        F.count("*").alias("n_frames"),
        F.count_if("on").alias("n_initialized"),
        F.percentile("err", 0.5).alias("pos_p50"),
        F.percentile("err", 0.95).alias("pos_p95"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("pos_rmse"),
        F.avg("alt").alias("alt_mae"),
        F.percentile("turn", 0.5).alias("heading_p50"),
        F.avg("conf").alias("mean_confidence"),
        F.avg((F.col("err") < target_m).cast("double")).alias("within_target"),
    )


def reliability(frames: DataFrame, target_m: float, bins: int = 5, least: int = 5) -> DataFrame:
    """Mean confidence and share of frames within the target per confidence bin (the last one is closed)."""
    hit = (horizontal_error() < target_m).cast("double")
    rows = frames.where("initialized").select(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin"), "confidence", hit.alias("hit"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_conf"), F.avg("hit").alias("empirical")).where(F.col("n") >= least)


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("empirical"))) / F.sum("n")).alias("ece"))


def reach(episodes: DataFrame, success: Column, key: str) -> DataFrame:
    rows = episodes.withColumn("ok", success)
    fit = F.col("ok") & (F.col("path_m") > 1)
    return rows.groupBy(key).agg(
        F.count("*").alias("n_episodes"),
        F.avg(F.col("ok").cast("double")).alias("success_rate"),
        F.avg(F.col("declared").cast("double")).alias("declared_rate"),
        F.avg(F.when(F.col("ok"), F.col("duration_s"))).alias("mean_duration"),
        F.avg(F.when(fit, F.col("straight_m") / F.col("path_m"))).alias("path_efficiency"),
        F.count_if("violation").alias("violations"),
        F.count_if("collided").alias("collisions"),
    )


def sigma_scale(errors: DataFrame, least: int = 20) -> DataFrame:
    """Factor that makes 90 % of the errors fall within the claimed spread's 90 % radius; 1 below ``least`` rows."""
    ratio = errors.select((F.col("err") / F.greatest("sigma", F.lit(1e-3))).alias("ratio"))
    found = with_quantiles(errors.agg(F.count("*").alias("n")), ratio, [], {"ratio": {"q": 0.9}})
    return found.select(F.when(F.col("n") >= least, F.greatest(F.lit(0.2), F.least(F.lit(50.0), F.col("q") / RAYLEIGH[0.9]))).otherwise(1.0).alias("scale"))


def quantile_ece(errors: DataFrame, scale: float) -> DataFrame:
    z = F.col("err") / F.greatest(F.greatest("sigma", F.lit(1e-3)) * scale, F.lit(1e-3))
    gaps = [F.abs(F.avg((z < q).cast("double")) - p) for p, q in RAYLEIGH.items()]
    return errors.agg((sum(gaps[1:], gaps[0]) / len(gaps)).alias("ece"))


def cell_p95(errors: DataFrame, cell_m: float) -> DataFrame:
    ce, cn = geo.plane_cell(F.col("e"), F.col("n"), cell_m)
    return errors.groupBy(ce.alias("ce"), cn.alias("cn")).agg(F.percentile("err", 0.95).alias("p95"))


def excess_weights(cells: DataFrame, threshold_m: float, cell_m: float) -> DataFrame:
    """Cells whose error exceeds the threshold, with a weight that grows with the excess; the weights sum to one.

    The maximum and the sum are one-row results joined back, so the cells stay where they are.
    """
    over = cells.where(F.col("p95") > threshold_m).withColumn("excess", F.col("p95") - threshold_m)
    most = over.agg(F.greatest(F.max("excess"), F.lit(1e-6)).alias("most"))
    raised = over.crossJoin(F.broadcast(most)).withColumn("raised", F.exp(F.col("excess") / F.col("most")))  # one row
    total = raised.agg(F.sum("raised").alias("total"))
    raised = raised.crossJoin(F.broadcast(total))  # one row
    return raised.select(((F.col("ce") + 0.5) * cell_m).alias("e"), ((F.col("cn") + 0.5) * cell_m).alias("n"), (F.col("raised") / F.col("total")).alias("weight"))


def step_delta(frames: DataFrame, key: str = "run") -> DataFrame:
    """Time and distance since the frame before, by ``key``."""
    w = Window.partitionBy(key).orderBy("t", "frame_id")
    moved = geo.distance(F.col("truth_e"), F.col("truth_n"), F.lag("truth_e").over(w), F.lag("truth_n").over(w))
    return frames.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("moved", moved)


def streaks(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Length of the unbroken run of true flags that ends at each row."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("__group", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    within = Window.partitionBy(key, "__group").orderBy(*order)
    return rows.withColumn("streak", F.sum(F.when(F.col(flag), 1).otherwise(0)).over(within)).drop("__group")


def stop_reason(p95: Column, alt_p95: Column, ece: Column, plateau: Column, used: Column, round_: Column, limits: dict) -> Column:
    """Why a capture loop stops at a round; null where it goes on."""
    return (
        F.when((p95 <= limits["p95"]) & (alt_p95 <= limits["alt_p95"]) & (ece <= limits["ece"]), "converged")
        .when(plateau >= limits["plateau_rounds"], "plateau")
        .when(used >= limits["budget"], "budget_exhausted")
        .when(round_ >= limits["max_rounds"], "max_rounds")
    )


@dataclass(frozen=True)
class LoopPlan:
    """Budget and stop rules of a capture loop; ``first`` captures before the first round, ``more`` after each other one."""

    budget: int = 4000
    first: int = 1600
    more: int = 560
    max_rounds: int = 6
    p95: float = 12.0
    alt_p95: float = 6.0
    ece: float = 0.15
    epsilon: float = 0.05
    plateau_rounds: int = 2
    cell_m: float = 150.0


def capture_loop(probes: Callable[[int], DataFrame], plan: LoopPlan, capture: Callable[[DataFrame, int, int], int]) -> list[dict]:
    """History of a capture loop: evaluate a round's probes, stop or plan the next captures, in the cells whose error is
    above the threshold (``capture`` takes their weights and a number; it says how many it took), or all over the area
    where no cell is. The next round needs the decision of this one, so rounds run one after the other; a round is a few
    aggregates of which one row and the number of cells reach the driver.
    """
    history: list[dict] = []
    used, before, plateau = plan.first, None, 0
    for k in range(1, plan.max_rounds + 1):
        rows = probes(k).withColumn("err", horizontal_error()).withColumn("alt", F.abs(F.col("est_u") - F.col("truth_u")))
        p95, alt = (exact_quantiles(rows, [], x, {"q": 0.95}).first()["q"] for x in ("err", "alt"))
        ece = expected_calibration_error(reliability(rows, plan.p95)).first()["ece"] or 0.0
        plateau = plateau + 1 if before is not None and (before - p95) / max(before, 1e-6) < plan.epsilon else 0
        stop = "converged" if p95 <= plan.p95 and alt <= plan.alt_p95 and ece <= plan.ece else None
        stop = stop or ("plateau" if plateau >= plan.plateau_rounds else "budget_exhausted" if used >= plan.budget else "max_rounds" if k >= plan.max_rounds else None)
        entry = {"round": k, "captures": used, "p95": p95, "alt_p95": alt, "ece": ece, "stop": stop, "targets": 0, "planned": 0}
        history.append(entry)
        if stop:
            break
        n, before = min(plan.more, plan.budget - used), p95
        weights = excess_weights(cell_p95(rows.select(F.col("truth_e").alias("e"), F.col("truth_n").alias("n"), "err"), plan.cell_m), plan.p95, plan.cell_m)
        cells = weights.select(*[x.alias(name) for name, x in zip(("ce", "cn"), geo.plane_cell(F.col("e"), F.col("n"), plan.cell_m))], "weight")
        entry["targets"] = cells.count()
        entry["planned"] = capture(cells, n, k) if entry["targets"] else n
        used += entry["planned"]
    return history

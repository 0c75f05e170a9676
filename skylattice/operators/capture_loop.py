"""Capture rounds on evidence: a growing landmark table, probes located against it, new captures where they miss.

A round takes fresh random probes, encodes them and looks each up among all landmarks of the rounds so far; errors are
those of the poses found. Where a stop rule holds the loop ends; otherwise new poses are planned in the cells whose error is
above the threshold, or all over the area where no cell is, cut to the area, encoded and appended. Landmarks are a table
of Parquet folders by round: a round adds its own and never encodes the earlier ones again. The next round needs the
decision of this one, so rounds run one after the other; one row and the number of cells reach the driver in each.

Defined results: a table without landmarks locates nothing and the loop stops as ``no_landmarks``; ties of similarity go to
the smaller landmark number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import evaluate, ingest
from skylattice.operators.evaluate import LoopPlan
from skylattice.operators.graph import written
from skylattice.operators.quantiles import exact_quantiles
from skylattice.operators.retrieval import dot

BLOCKS = 8
HISTORY = "round long, captures long, p95 double, alt_p95 double, ece double, stop string, targets long, planned long"


@dataclass(frozen=True)
class Area:
    """East and north bounds, and altitudes, of probes and captures."""

    x0: float
    x1: float
    z0: float
    z1: float
    low: float = 40.0
    high: float = 100.0
    probes: int = 300
    seed: int = 7
    plan: LoopPlan = field(default_factory=LoopPlan)


def locate(probes: DataFrame, landmarks: DataFrame) -> DataFrame:
    """The most similar landmark of each probe (number, e, n, u, v): a stated query set against all rows, in blocks that each
    keep their best."""
    spread = landmarks.select(F.col("number").alias("mark"), F.col("e").alias("est_e"), F.col("n").alias("est_n"), F.col("u").alias("est_u"), F.col("v").alias("mv"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("mark"), F.lit(BLOCKS)).cast("int"))
    asked = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    both = asked.join(spread, "block").select("number", F.round(dot(F.col("v"), F.col("mv")), 12).alias("sim"), "mark", "est_e", "est_n", "est_u")
    best = both.groupBy("number").agg(F.max_by(F.struct("sim", "est_e", "est_n", "est_u"), F.struct("sim", -F.col("mark"))).alias("x"))
    return probes.drop("v").join(best.select("number", "x.*"), "number")


def run(area: Area, first: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str) -> list[dict]:
    """History of the loop. ``first`` are the captures before the first round (e, n, u); ``encode`` adds the unit vector
    ``v`` to poses. Landmarks go to ``path``/landmarks by round, located probes to ``path``/probes."""
    spark, plan = first.sparkSession, area.plan
    inside = F.col("e").between(area.x0, area.x1) & F.col("n").between(area.z0, area.z1)
    bounds = spark.createDataFrame([(area.x0, area.x1, area.z0, area.z1)], "x0 double, x1 double, z0 double, z1 double")
    random = lambda n, seed: ingest.probes(bounds, n, seed, area.low, area.high).select(F.col("id").alias("number"), F.col("x").alias("e"), F.col("z").alias("n"), F.col("agl").alias("u"))

    def add(poses: DataFrame, k: int, base: int) -> int:
        """Appends a round's captures, numbered after ``base``, and says how many they are."""
        kept = written(poses.where(inside).select("e", "n", "u"))
        numbers = ingest.numbered(kept, ["e", "n", "u"], base).select(F.col("index").alias("number"), "e", "n", "u")
        encode(numbers).write.parquet(f"{path}/landmarks/round={k}")
        return kept.count()

    used, before, plateau, history = add(first, 0, 0), None, 0, []
    for k in range(1, plan.max_rounds + 1):
        marks = spark.read.parquet(f"{path}/landmarks")
        asked = encode(random(area.probes, area.seed + k))
        found = locate(written(asked), marks)
        found.select("number", F.col("e").alias("truth_e"), F.col("n").alias("truth_n"), F.col("u").alias("truth_u"), "est_e", "est_n", "est_u", "sim").write.parquet(f"{path}/probes/round={k}")
        rows = spark.read.parquet(f"{path}/probes/round={k}").withColumn("initialized", F.lit(True)).withColumn("confidence", F.exp((F.col("sim") - 1) / 0.01))
        rows = rows.withColumn("err", evaluate.horizontal_error()).withColumn("alt", F.abs(F.col("est_u") - F.col("truth_u")))
        if not used:
            history.append({"round": k, "captures": 0, "p95": None, "alt_p95": None, "ece": None, "stop": "no_landmarks", "targets": 0, "planned": 0})
            break
        p95, alt = (exact_quantiles(rows, [], x, {"q": 0.95}).first()["q"] for x in ("err", "alt"))
        ece = evaluate.expected_calibration_error(evaluate.reliability(rows, plan.p95)).first()["ece"] or 0.0
        plateau = plateau + 1 if before is not None and (before - p95) / max(before, 1e-6) < plan.epsilon else 0
        stop = "converged" if p95 <= plan.p95 and alt <= plan.alt_p95 and ece <= plan.ece else None
        stop = stop or ("plateau" if plateau >= plan.plateau_rounds else "budget_exhausted" if used >= plan.budget else "max_rounds" if k >= plan.max_rounds else None)
        entry = {"round": k, "captures": used, "p95": p95, "alt_p95": alt, "ece": ece, "stop": stop, "targets": 0, "planned": 0}
        history.append(entry)
        if stop:
            break
        n, before = min(plan.more, plan.budget - used), p95
        errors = rows.select(F.col("truth_e").alias("e"), F.col("truth_n").alias("n"), "err")
        weights = evaluate.excess_weights(evaluate.cell_p95(errors, plan.cell_m), plan.p95, plan.cell_m)
        cells = written(weights.select(*[x.alias(name) for name, x in zip(("ce", "cn"), geo.plane_cell(F.col("e"), F.col("n"), plan.cell_m))], "weight"))
        entry["targets"] = cells.count()
        if entry["targets"]:
            high = F.lit(area.low) + (area.high - area.low) * F.pmod(F.xxhash64("ce", "cn", "number", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
            poses = ingest.targeted_poses(ingest.allocate(cells, n), plan.cell_m, area.seed + 1000 + k).withColumn("u", high)
        else:  # errors are diffuse
            poses = random(n, area.seed + 500 + k)
        entry["planned"] = add(poses, k, used)
        used += entry["planned"]
    return history

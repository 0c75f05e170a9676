"""The capture loop's history against a plain loop over its landmarks and probes."""

import math

import numpy as np

from skylattice.operators import capture_loop
from skylattice.operators.evaluate import LoopPlan
from skylattice.plans.streams import encoded


def plain(spark, path, plan):
    marks, probes = spark.read.parquet(f"{path}/landmarks").toPandas(), spark.read.parquet(f"{path}/probes").toPandas()
    code = lambda d: np.stack([f(d[k] / w) / 2 for w in (300.0, 70.0) for k in d.columns[:2] for f in (np.cos, np.sin)], 1)
    history, before, plateau = [], None, 0
    for k in range(1, probes["round"].max() + 1):
        seen = marks[marks["round"] < k].sort_values("number").reset_index(drop=True)
        asked = probes[probes["round"] == k]
        sims = np.round(code(asked[["truth_e", "truth_n"]]) @ code(seen[["e", "n"]]).T, 12)
        best = seen.iloc[sims.argmax(1)]
        err = np.hypot(best.e.to_numpy() - asked.truth_e.to_numpy(), best.n.to_numpy() - asked.truth_n.to_numpy())
        p95, alt = np.quantile(err, 0.95), np.quantile(np.abs(best.u.to_numpy() - asked.truth_u.to_numpy()), 0.95)
        conf = np.exp((sims.max(1) - 1) / 0.01)
        bins, gap, total = np.minimum(4, np.floor(conf * 5)), 0.0, 0
        for b in range(5):
            on = bins == b
            if on.sum() >= 5:
                gap, total = gap + on.sum() * abs(conf[on].mean() - (err[on] < plan.p95).mean()), total + on.sum()
        plateau = plateau + 1 if before is not None and (before - p95) / max(before, 1e-6) < plan.epsilon else 0
        used = len(seen)
        stop = "converged" if p95 <= plan.p95 and alt <= plan.alt_p95 and gap / max(total, 1) <= plan.ece else None
        stop = stop or ("plateau" if plateau >= plan.plateau_rounds else "budget_exhausted" if used >= plan.budget else "max_rounds" if k >= plan.max_rounds else None)
        cells = {}
        for e, n, x in zip(asked.truth_e, asked.truth_n, err):
            cells.setdefault((math.floor(e / plan.cell_m), math.floor(n / plan.cell_m)), []).append(x)
        targets = 0 if stop else sum(np.quantile(v, 0.95) > plan.p95 for v in cells.values())
        history.append((k, used, round(p95, 6), round(alt, 6), round(gap / max(total, 1), 6), stop, targets, 0 if stop else int((marks["round"] == k).sum())))
        before = p95
    return history


def test_history_equals_a_plain_loop(spark, tmp_path):
    r = np.random.default_rng(2)
    for name, plan in (("a", LoopPlan(budget=260, first=60, more=80, max_rounds=4, p95=60.0, alt_p95=5.0)), ("b", LoopPlan(budget=900, first=400, more=50, max_rounds=3, p95=300.0, alt_p95=300.0, ece=1.0))):
        first = spark.createDataFrame([(float(a), float(b), 60.0) for a, b in r.uniform(-600, 600, size=(plan.first, 2))], "e double, n double, u double")
        area = capture_loop.Area(-600.0, 600.0, -600.0, 600.0, probes=150, plan=plan)
        path = f"file://{tmp_path}/{name}"
        history = capture_loop.run(area, first, encoded, path)
        got = [(h["round"], h["captures"], round(h["p95"], 6), round(h["alt_p95"], 6), round(h["ece"], 6), h["stop"], h["targets"], h["planned"]) for h in history]
        assert got == plain(spark, path, plan)
        assert history[-1]["stop"] == ("converged" if name == "b" else "budget_exhausted") or history[-1]["stop"] in ("plateau", "max_rounds")
        marks = spark.read.parquet(f"{path}/landmarks")
        assert marks.count() == marks.select("number").distinct().count() and marks.where("abs(e) > 600 or abs(n) > 600").count() == 0
    assert capture_loop.run(area, first.where("false"), encoded, f"file://{tmp_path}/none")[-1]["stop"] == "no_landmarks"

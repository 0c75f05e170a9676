"""Queries of evaluation: joins of estimates and truth, error metrics, calibration, windows over frames, stop rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import evaluate, telemetry
from skylattice.operators.quantiles import with_quantiles
from skylattice.plans.base import r
from skylattice.registry import query
from skylattice.sources import domain
from skylattice.sources.domain import with_tables

c = lambda name: F.col(name)
ERR = "sqrt((est_e - truth_e) ** 2 + (est_n - truth_n) ** 2)"
TURN = "abs((est_heading - truth_heading + 540) % 360 - 180)"


def rounded(df, keys):
    """All double columns but ``keys`` to four places."""
    return df.select(*[r(c(k)).alias(k) if t == "double" and k not in keys else c(k) for k, t in df.dtypes])


J01 = ", truth AS (SELECT frame_id, truth_e, truth_n, truth_u, truth_heading FROM frames WHERE frame_id % 97 <> 0)"


@query("J01_estimate_truth", with_tables("frames", J01 + f" SELECT f.frame_id, f.run, round({ERR.replace('truth', 't.truth').replace('est_', 'f.est_')}, 4) AS err FROM frames f JOIN truth t USING (frame_id)"))
def estimate_truth(spark, sf_dir):
    """Both sides are projections of one table by its key; truth is missing for some frames."""
    frames = domain.frames(spark, sf_dir)
    sensor = frames.select("frame_id", "run", "est_e", "est_n")
    truth = frames.where("frame_id % 97 <> 0").select("frame_id", "truth_e", "truth_n")
    return sensor.join(truth, "frame_id").select("frame_id", "run", r(evaluate.horizontal_error()).alias("err"))


A01 = f"""SELECT run, count(*) AS n_frames, count(*) FILTER (initialized) AS n_initialized,
  round(quantile_cont({ERR}, 0.5) FILTER (initialized), 4) AS pos_p50, round(quantile_cont({ERR}, 0.95) FILTER (initialized), 4) AS pos_p95,
  round(sqrt(avg({ERR} ** 2) FILTER (initialized)), 4) AS pos_rmse, round(avg(abs(est_u - truth_u)) FILTER (initialized), 4) AS alt_mae,
  round(quantile_cont({TURN}, 0.5) FILTER (initialized), 4) AS heading_p50, round(avg(confidence) FILTER (initialized), 4) AS mean_confidence,
  round(avg(CASE WHEN {ERR} < 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (initialized), 4) AS within_target FROM frames GROUP BY run"""


@query("A01_accuracy_metrics", with_tables("frames", A01))
def accuracy_metrics(spark, sf_dir):
    return rounded(evaluate.accuracy(domain.frames(spark, sf_dir), 12.0), [])


A02 = """, e AS (SELECT *, declared AND dist_at_arrival <= 60 AND NOT violation AND NOT collided AS ok FROM episodes)
SELECT run, count(*) AS n_episodes, round(avg(ok::INT::DOUBLE), 4) AS success_rate, round(avg(declared::INT::DOUBLE), 4) AS declared_rate, round(avg(duration_s) FILTER (ok), 4) AS mean_duration,
  round(avg(straight_m / path_m) FILTER (ok AND path_m > 1), 4) AS path_efficiency, count(*) FILTER (violation) AS violations, count(*) FILTER (collided) AS collisions FROM e GROUP BY run"""


@query("A02_reach_metrics", with_tables("episodes", A02))
def reach_metrics(spark, sf_dir):
    from skylattice.functions.estimates import success

    ok = success(c("declared"), c("dist_at_arrival"), c("violation"), c("collided"), 60.0)
    return rounded(evaluate.reach(domain.episodes(spark, sf_dir), ok, "run"), [])


BINS = f""", b AS (SELECT least(CAST(floor(confidence * 5) AS BIGINT), 4) AS bin, confidence, CASE WHEN {ERR} < 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM frames WHERE initialized),
bins AS (SELECT bin, count(*) AS n, avg(confidence) AS mean_conf, avg(hit) AS empirical FROM b GROUP BY bin HAVING count(*) >= 5)
"""


@query("A03_reliability_bins", with_tables("frames", BINS + "SELECT bin, n, round(mean_conf, 4) AS mean_conf, round(empirical, 4) AS empirical FROM bins"))
def reliability_bins(spark, sf_dir):
    return rounded(evaluate.reliability(domain.frames(spark, sf_dir), 12.0), [])


@query("A03_confidence_ece", with_tables("frames", BINS + "SELECT round(sum(n * abs(mean_conf - empirical)) / sum(n), 4) AS ece FROM bins"))
def confidence_ece(spark, sf_dir):
    return rounded(evaluate.expected_calibration_error(evaluate.reliability(domain.frames(spark, sf_dir), 12.0)), [])


def errors(spark, sf_dir):
    """Regression errors of the captures, as (id, e, n, err, alt, turn, sigma)."""
    p = domain.preds(spark, sf_dir)
    return p.select(
        "id", "e", "n", geo.distance(c("pe"), c("pn"), c("e"), c("n")).alias("err"), F.abs(c("pu") - c("u")).alias("alt"), F.abs(geo.wrap_deg(c("ph") - c("heading"))).alias("turn"), "sigma"
    )


ERRORS = ", errors AS (SELECT id, e, n, sqrt((pe - e) ** 2 + (pn - n) ** 2) AS err, abs(pu - u) AS alt, abs((ph - heading + 540) % 360 - 180) AS turn, sigma FROM preds)\n"


@query(
    "A04_regression_errors",
    with_tables("preds", ERRORS + """SELECT count(*) AS n_eval, round(quantile_cont(err, 0.5), 4) AS p50, round(quantile_cont(err, 0.95), 4) AS p95, round(sqrt(avg(err * err)), 4) AS rmse,
  round(quantile_cont(alt, 0.95), 4) AS alt_p95, round(quantile_cont(turn, 0.5), 4) AS heading_p50 FROM errors"""),
)
def regression_errors(spark, sf_dir):
    e = errors(spark, sf_dir)
    sums = e.agg(F.count("*").alias("n_eval"), F.sqrt(F.avg(c("err") * c("err"))).alias("rmse"))
    return rounded(with_quantiles(sums, e, [], {"err": {"p50": 0.5, "p95": 0.95}, "alt": {"alt_p95": 0.95}, "turn": {"heading_p50": 0.5}}), ["n_eval"])


@query("A06_sigma_scale", with_tables("preds", ERRORS + "SELECT round(greatest(0.2, least(50, quantile_cont(err / sigma, 0.9) / CAST(2.1460 AS DOUBLE))), 4) AS scale FROM errors"))
def sigma_scale(spark, sf_dir):
    return rounded(evaluate.sigma_scale(errors(spark, sf_dir)), [])


_GAP = " + ".join(f"abs(avg(CASE WHEN err / (sigma * 2) < CAST({q} AS DOUBLE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - CAST({p} AS DOUBLE))" for p, q in evaluate.RAYLEIGH.items())


@query("A07_quantile_ece", with_tables("preds", ERRORS + f"SELECT round(({_GAP}) / 4, 4) AS ece FROM errors"))
def quantile_ece(spark, sf_dir):
    return rounded(evaluate.quantile_ece(errors(spark, sf_dir), 2.0), [])


CELLS = ERRORS + ", cells AS (SELECT CAST(floor(e / 150) AS BIGINT) AS ce, CAST(floor(n / 150) AS BIGINT) AS cn, quantile_cont(err, 0.95) AS p95 FROM errors GROUP BY 1, 2)\n"


@query("A08_cell_error_map", with_tables("preds", CELLS + "SELECT ce, cn, round(p95, 4) AS p95 FROM cells"))
def cell_error_map(spark, sf_dir):
    return rounded(evaluate.cell_p95(errors(spark, sf_dir), 150.0), [])


@query(
    "A55_excess_weights",
    with_tables("preds", CELLS + """, over AS (SELECT *, p95 - 6 AS excess FROM cells WHERE p95 > 6), w AS (SELECT *, exp(excess / (SELECT max(excess) FROM over)) AS raised FROM over)
SELECT round((ce + CAST(0.5 AS DOUBLE)) * 150, 4) AS e, round((cn + CAST(0.5 AS DOUBLE)) * 150, 4) AS n, round(raised / (SELECT sum(raised) FROM w), 6) AS weight FROM w"""),
)
def excess_weights(spark, sf_dir):
    w = evaluate.excess_weights(evaluate.cell_p95(errors(spark, sf_dir), 150.0), 6.0, 150.0)
    return w.select(r(c("e")).alias("e"), r(c("n")).alias("n"), r(c("weight"), 6).alias("weight"))


@query("A52_pass_verdict", with_tables("frames", f", a AS ({A01}) SELECT run, coalesce(pos_p95 <= 15 AND within_target >= CAST(0.6 AS DOUBLE), false) AS passed FROM a"))
def pass_verdict(spark, sf_dir):
    a = rounded(evaluate.accuracy(domain.frames(spark, sf_dir), 12.0), [])
    return a.select("run", F.coalesce((c("pos_p95") <= 15) & (c("within_target") >= 0.6), F.lit(False)).alias("passed"))


@query("A53_better_cue", with_tables("frames", f", a AS ({A01}) SELECT run, least(pos_p95, alt_mae * 40) AS p95 FROM a"))
def better_cue(spark, sf_dir):
    a = rounded(evaluate.accuracy(domain.frames(spark, sf_dir), 12.0), [])
    return a.select("run", F.least(c("pos_p95"), c("alt_mae") * 40).alias("p95"))


LEADER = f""", s AS (SELECT run AS combo, quantile_cont({ERR}, 0.5) AS median, quantile_cont({ERR}, 0.9) AS p90 FROM frames GROUP BY run),
g AS (SELECT *, p90 <= CAST(1.5 AS DOUBLE) * (SELECT p90 FROM s WHERE combo = 0) AS kept FROM s)
SELECT combo, round(median, 4) AS median, round(p90, 4) AS p90, kept, combo = (SELECT arg_min(combo, median) FROM g WHERE kept) AS winner FROM g"""


@query("A54_leaderboard", with_tables("frames", LEADER))
def leaderboard(spark, sf_dir):
    """Combinations by median error; those whose p90 is far above the baseline's (combination 0) cannot win."""
    e = domain.frames(spark, sf_dir).select(c("run").alias("combo"), evaluate.horizontal_error().alias("err"))
    s = e.groupBy("combo").agg(F.percentile("err", 0.5).alias("median"), F.percentile("err", 0.9).alias("p90"))
    guard = s.where("combo = 0").select(c("p90").alias("base"))  # one row
    s = s.crossJoin(F.broadcast(guard)).withColumn("kept", c("p90") <= 1.5 * c("base")).drop("base")
    winner = s.where("kept").agg(F.min_by("combo", "median").alias("best"))  # one row
    return s.crossJoin(F.broadcast(winner)).select("combo", r(c("median")).alias("median"), r(c("p90")).alias("p90"), "kept", (c("combo") == c("best")).alias("winner"))


@query(
    "A57_tile_rollup",
    with_tables("episodes", "SELECT CAST(sum(k) AS BIGINT) AS captures, max(k) AS most, count(*) AS tiles FROM (SELECT run, count(*) AS k FROM episodes GROUP BY run)"),
)
def tile_rollup(spark, sf_dir):
    runs = domain.episodes(spark, sf_dir).groupBy("run").agg(F.count("*").alias("k"))
    return runs.agg(F.sum("k").alias("captures"), F.max("k").alias("most"), F.count("*").alias("tiles"))


@query(
    "A61_cue_counts",
    with_tables("frames", "SELECT cue, initialized AS accepted, count(*) AS n, round(arg_max(confidence, (t, frame_id)), 4) AS last FROM frames GROUP BY cue, initialized"),
)
def cue_counts(spark, sf_dir):
    return domain.frames(spark, sf_dir).groupBy("cue", c("initialized").alias("accepted")).agg(F.count("*").alias("n"), r(F.max_by("confidence", F.struct("t", "frame_id"))).alias("last"))


@query(
    "A64_split_counts",
    with_tables("captures", """, b AS (SELECT CAST('0x' || substr(sha1(CAST(floor(e / 150) AS BIGINT) || ':' || CAST(floor(n / 150) AS BIGINT) || ':7'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS k FROM captures)
SELECT CASE WHEN k < CAST(0.2 AS DOUBLE) THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM b GROUP BY 1"""),
)
def split_counts(spark, sf_dir):
    return evaluate.spatial_split(domain.captures(spark, sf_dir), 150.0, 7, 0.2).groupBy("split").agg(F.count("*").alias("n"))


@query("U04_split_disjoint", with_tables("captures", """, k AS (SELECT DISTINCT CAST(floor(e / 150) AS BIGINT) AS ce, CAST(floor(n / 150) AS BIGINT) AS cn FROM captures),
s AS (SELECT ce, cn, ('0x' || substr(sha1(ce || ':' || cn || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE AS held FROM k)
SELECT count(*) FILTER (NOT held) AS train_cells, count(*) FILTER (held) AS validation_cells, (SELECT count(*) FROM (SELECT ce, cn FROM s WHERE held INTERSECT SELECT ce, cn FROM s WHERE NOT held)) AS shared_cells FROM s"""))  # fmt: skip
def split_disjoint(spark, sf_dir):
    """Cells of each split, and those that are in both: none."""
    s = evaluate.spatial_split(domain.captures(spark, sf_dir), 150.0, 7, 0.2)
    cells = lambda name: s.where(c("split") == name).select("ce", "cn").distinct()
    counted = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  one row each
    train, held = cells("train"), cells("validation")
    return counted(train, "train_cells").crossJoin(counted(held, "validation_cells")).crossJoin(counted(train.intersect(held), "shared_cells"))


STEPS = ", s AS (SELECT *, t - lag(t) OVER w AS dt, sqrt((truth_e - lag(truth_e) OVER w) ** 2 + (truth_n - lag(truth_n) OVER w) ** 2) AS moved FROM frames WINDOW w AS (PARTITION BY run ORDER BY t, frame_id))\n"


@query("W01_step_delta", with_tables("frames", STEPS + "SELECT frame_id, round(dt, 4) AS dt, round(moved, 4) AS moved FROM s"))
def step_delta(spark, sf_dir):
    return evaluate.step_delta(domain.frames(spark, sf_dir)).select("frame_id", r(c("dt")).alias("dt"), r(c("moved")).alias("moved"))


@query(
    "W02_path_length",
    with_tables("frames", STEPS + """SELECT run, round(sum(moved), 4) AS path, round(sqrt((arg_max(truth_e, (t, frame_id)) - arg_min(truth_e, (t, frame_id))) ** 2
  + (arg_max(truth_n, (t, frame_id)) - arg_min(truth_n, (t, frame_id))) ** 2), 4) AS straight FROM s GROUP BY run"""),
)
def path_length(spark, sf_dir):
    s = evaluate.step_delta(domain.frames(spark, sf_dir))
    at = F.struct("t", "frame_id")
    ends = geo.distance(F.max_by("truth_e", at), F.max_by("truth_n", at), F.min_by("truth_e", at), F.min_by("truth_n", at))
    return s.groupBy("run").agg(r(F.sum("moved")).alias("path"), r(ends).alias("straight"))


@query(
    "W03_streaks",
    with_tables("frames", """, g AS (SELECT *, sum(CASE WHEN confidence >= CAST(0.3 AS DOUBLE) THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS grp FROM frames)
SELECT frame_id, CAST(sum(CASE WHEN confidence >= CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY run, grp ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g"""),
)
def streaks(spark, sf_dir):
    rows = domain.frames(spark, sf_dir).withColumn("good", c("confidence") >= 0.3)
    return evaluate.streaks(rows, "run", ["t", "frame_id"], "good").select("frame_id", "streak")


@query("W04_first_fix", with_tables("frames", f"SELECT run, round(min(t) FILTER (initialized AND {ERR} < 24) - min(t), 4) AS seconds FROM frames GROUP BY run"))
def first_fix(spark, sf_dir):
    good = c("initialized") & (evaluate.horizontal_error() < 24)
    return domain.frames(spark, sf_dir).groupBy("run").agg(r(F.min(F.when(good, c("t"))) - F.min("t")).alias("seconds"))


@query(
    "W05_recovery",
    with_tables("frames", f""", k AS (SELECT run, min(t) FILTER (lost) AS event FROM frames GROUP BY run)
SELECT run, round(min(t) FILTER (t > event AND initialized AND {ERR} < 24) - min(event), 4) AS seconds FROM frames JOIN k USING (run) GROUP BY run"""),
)
def recovery(spark, sf_dir):
    """Seconds from the first loss to the first good frame strictly after it."""
    frames = domain.frames(spark, sf_dir)
    event = F.min(F.when(c("lost"), c("t"))).over(Window.partitionBy("run"))
    good = (c("t") > c("event")) & c("initialized") & (evaluate.horizontal_error() < 24)
    return frames.withColumn("event", event).groupBy("run").agg(r(F.min(F.when(good, c("t"))) - F.min("event")).alias("seconds"))


@query(
    "W06_rolling_health",
    with_tables("frames", "SELECT frame_id, round(avg(initialized::INT::DOUBLE) OVER (PARTITION BY run ORDER BY t, frame_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS health FROM frames"),
)
def rolling_health(spark, sf_dir):
    w = Window.partitionBy("run").orderBy("t", "frame_id").rowsBetween(-19, 0)
    return domain.frames(spark, sf_dir).select("frame_id", r(F.avg(c("initialized").cast("double")).over(w)).alias("health"))


@query(
    "W07_running_minimum",
    with_tables("frames", "SELECT frame_id, round(min(sqrt(truth_e ** 2 + truth_n ** 2)) OVER (PARTITION BY run ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING), 4) AS nearest FROM frames"),
)
def running_minimum(spark, sf_dir):
    w = Window.partitionBy("run").orderBy("t", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    return domain.frames(spark, sf_dir).select("frame_id", r(F.min(geo.distance(c("truth_e"), c("truth_n"), F.lit(0.0), F.lit(0.0))).over(w)).alias("nearest"))


ROUNDS = """, rounds AS (SELECT run, CAST(floor(frame_id / 400) AS BIGINT) AS round, quantile_cont(sqrt((est_e - truth_e) ** 2 + (est_n - truth_n) ** 2), 0.95) AS p95, count(*) AS k FROM frames GROUP BY 1, 2),
imp AS (SELECT *, (lag(p95) OVER w - p95) / greatest(lag(p95) OVER w, 1e-6) AS improvement, CAST(sum(k) OVER (PARTITION BY run ORDER BY round ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM rounds WINDOW w AS (PARTITION BY run ORDER BY round)),
fl AS (SELECT *, sum(CASE WHEN coalesce(improvement < CAST(0.03 AS DOUBLE), false) THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY round ROWS UNBOUNDED PRECEDING) AS grp FROM imp),
pl AS (SELECT *, CAST(sum(CASE WHEN coalesce(improvement < CAST(0.03 AS DOUBLE), false) THEN 1 ELSE 0 END) OVER (PARTITION BY run, grp ORDER BY round ROWS UNBOUNDED PRECEDING) AS BIGINT) AS plateau FROM fl)
"""


def rounds(spark, sf_dir):
    """Error per capture round of each run, with the improvement and the run of rounds without one."""
    f = domain.frames(spark, sf_dir).select("run", F.floor(c("frame_id") / 400).alias("round"), evaluate.horizontal_error().alias("err"))
    g = f.groupBy("run", "round").agg(F.percentile("err", 0.95).alias("p95"), F.count("*").alias("k"))
    w = Window.partitionBy("run").orderBy("round")
    before = F.lag("p95").over(w)
    g = g.withColumn("improvement", (before - c("p95")) / F.greatest(before, F.lit(1e-6))).withColumn("used", F.sum("k").over(w))
    g = g.withColumn("flat", F.coalesce(c("improvement") < 0.03, F.lit(False)))
    return evaluate.streaks(g, "run", ["round"], "flat").withColumnRenamed("streak", "plateau")


@query("W08_improvement", with_tables("frames", ROUNDS + "SELECT run, round, round(improvement, 4) AS improvement, plateau FROM pl"))
def improvement(spark, sf_dir):
    return rounds(spark, sf_dir).select("run", "round", r(c("improvement")).alias("improvement"), "plateau")


@query(
    "W09_stop_reason",
    with_tables("frames", ROUNDS + """, why AS (SELECT run, round, CASE WHEN p95 <= 12 THEN 'converged' WHEN plateau >= 2 THEN 'plateau' WHEN used >= 800 THEN 'budget_exhausted' WHEN round >= 20 THEN 'max_rounds' END AS reason FROM pl)
SELECT run, min(round) AS round, arg_min(reason, round) AS reason FROM why WHERE reason IS NOT NULL GROUP BY run"""),
)
def stop_reason(spark, sf_dir):
    """First round at which each run stops."""
    limits = {"p95": 12.0, "alt_p95": 6.0, "ece": 0.15, "plateau_rounds": 2, "budget": 800, "max_rounds": 20}
    why = evaluate.stop_reason(c("p95"), F.lit(0.0), F.lit(0.0), c("plateau"), c("used"), c("round"), limits)
    return rounds(spark, sf_dir).withColumn("reason", why).where("reason is not null").groupBy("run").agg(F.min("round").alias("round"), F.min_by("reason", "round").alias("reason"))


@query("W18_displacement_velocity", with_tables("frames", STEPS + "SELECT frame_id, round(moved / greatest(dt, CAST(0.001 AS DOUBLE)), 4) AS speed, round(greatest(0.6, least(3, 6 / sqrt(greatest(frame_id % 90, 1)))), 4) AS sigma FROM s WHERE dt IS NOT NULL"))
def displacement_velocity(spark, sf_dir):
    from skylattice.functions.estimates import velocity_sigma

    s = evaluate.step_delta(domain.frames(spark, sf_dir)).where("dt is not null")
    return s.select("frame_id", r(c("moved") / F.greatest(c("dt"), F.lit(1e-3))).alias("speed"), r(velocity_sigma(c("frame_id") % 90)).alias("sigma"))


@query("P05_initialized_frames", with_tables("frames", "SELECT frame_id, run FROM frames WHERE initialized"))
def initialized_frames(spark, sf_dir):
    return domain.frames(spark, sf_dir).where("initialized").select("frame_id", "run")


@query("P04_blind_projection", with_tables("frames", "SELECT frame_id, run, round(t, 3) AS t, cue FROM frames"))
def blind_projection(spark, sf_dir):
    """What a localizer may see of a frame: no pose."""
    return domain.frames(spark, sf_dir).select("frame_id", "run", r(c("t"), 3).alias("t"), "cue")


@query("P10_clip_poses", with_tables("captures", "SELECT id, greatest(-790, least(790, e)) AS e, greatest(-790, least(790, n)) AS n FROM captures"))
def clip_poses(spark, sf_dir):
    inside = lambda k: F.greatest(F.lit(-790.0), F.least(F.lit(790.0), c(k)))
    return domain.captures(spark, sf_dir).select("id", inside("e").alias("e"), inside("n").alias("n"))


@query(
    "P11_measurement_gate",
    with_tables("frames", "SELECT frame_id, confidence * 20 <= CASE frame_id % 3 WHEN 0 THEN 6.63::DOUBLE WHEN 1 THEN 9.21::DOUBLE ELSE 11.34::DOUBLE END * 2 OR frame_id % 11 = 0 AS accepted FROM frames"),
)
def measurement_gate(spark, sf_dir):
    """Squared innovation against the 99 % bound of its degrees of freedom, with the gate's margin; all pass in a transient."""
    bound = F.when(c("frame_id") % 3 == 0, 6.63).when(c("frame_id") % 3 == 1, 9.21).otherwise(11.34)  # fixed values
    return domain.frames(spark, sf_dir).select("frame_id", ((c("confidence") * 20 <= bound * 2) | (c("frame_id") % 11 == 0)).alias("accepted"))


HEALTH = """, o AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY source ORDER BY at_time DESC, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later,
  sum(ok::INT) OVER (PARTITION BY source) AS n FROM fetch_log),
h AS (SELECT source, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_fail, sum(latency * power(CAST(0.7 AS DOUBLE), later) * CASE WHEN later = n - 1 THEN 1 ELSE CAST(0.3 AS DOUBLE) END) FILTER (ok) AS ewma,
  count(*) FILTER (later = 0 AND blocked AND NOT ok) AS streak FROM o GROUP BY source),
health AS (SELECT *, (n_ok + 1) / CAST(n_ok + n_fail + 2 AS DOUBLE) AS rate, CASE WHEN streak > 0 THEN least(900, 120 * power(2, least(streak - 1, 10))) ELSE 0 END AS cooldown_s FROM h)
"""


@query("A51_source_health", with_tables("fetch_log", HEALTH + "SELECT source, n_ok, n_fail, round(ewma, 4) AS ewma, streak, round(rate, 4) AS rate, CAST(cooldown_s AS DOUBLE) AS cooldown_s FROM health"))
def source_health(spark, sf_dir):
    return rounded(telemetry.source_health(domain.fetch_log(spark, sf_dir), ["at", "seq"]), [])


@query("T05_source_order", with_tables("fetch_log", HEALTH + "SELECT source, row_number() OVER (ORDER BY source % 2, rate DESC, coalesce(nullif(ewma, 0), 5), source) AS rank FROM health WHERE cooldown_s = 0"))
def source_order(spark, sf_dir):
    health = telemetry.source_health(domain.fetch_log(spark, sf_dir), ["at", "seq"])
    return telemetry.source_order(health, c("source") % 2).select("source", "rank")


@query("W12_moving_latency", with_tables("fetch_log", HEALTH + "SELECT source, round(ewma, 4) AS ewma FROM health"))
def moving_latency(spark, sf_dir):
    return rounded(telemetry.source_health(domain.fetch_log(spark, sf_dir), ["at", "seq"]).select("source", "ewma"), [])


@query("T07_newest_rows", with_tables("frames", "SELECT service, frame_id FROM (SELECT run % 2 AS service, frame_id, row_number() OVER (PARTITION BY run % 2 ORDER BY t DESC, frame_id DESC) AS k, count(*) OVER (PARTITION BY run % 2) AS n FROM frames) WHERE n <= 4000 OR k <= 3000"))
def newest_rows(spark, sf_dir):
    """A service keeps its newest 3000 rows once it holds more than 4000."""
    rows = domain.frames(spark, sf_dir).withColumn("service", c("run") % 2)
    return telemetry.newest(rows, "service", ["t", "frame_id"], 3000, 4000).select("service", "frame_id")


@query("J32_labels_fixes", with_tables("frames preds", f"SELECT p.id, round(sqrt((f.est_e - p.pe) ** 2 + (f.est_n - p.pn) ** 2), 4) AS err FROM preds p JOIN frames f ON f.frame_id = p.id"))
def labels_fixes(spark, sf_dir):
    p, f = domain.preds(spark, sf_dir), domain.frames(spark, sf_dir)
    return p.join(f, p["id"] == f["frame_id"]).select("id", r(geo.distance(c("est_e"), c("est_n"), c("pe"), c("pn"))).alias("err"))


@query("A62_weighted_estimate", with_tables("frames", """SELECT run, round(sum(confidence * est_e) / sum(confidence), 4) AS e, round(sum(confidence * est_n) / sum(confidence), 4) AS n,
  round((degrees(atan2(sum(confidence * sin(radians(est_heading))), sum(confidence * cos(radians(est_heading))))) + 360) % 360, 4) AS heading,
  round(sum(confidence) ** 2 / sum(confidence * confidence), 4) AS effective FROM frames GROUP BY run"""))  # fmt: skip
def weighted_estimate(spark, sf_dir):
    from skylattice.operators.retrieval import circular_mean

    w = c("confidence")
    return domain.frames(spark, sf_dir).groupBy("run").agg(
        r(F.sum(w * c("est_e")) / F.sum(w)).alias("e"), r(F.sum(w * c("est_n")) / F.sum(w)).alias("n"), r(circular_mean(c("est_heading"), w)).alias("heading"), r(F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective")
    )

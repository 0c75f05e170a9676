"""Queries of stream operators, run over the whole table as one available-now stream, and of their batch twins."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skylattice.operators import capture_loop, evaluate, ingest
from skylattice.plans.base import r
from skylattice.plans.evaluation import ERR
from skylattice.plans.ingestion import NEAREST, TILES, bounds_of, table_path
from skylattice.registry import query
from skylattice.sources import domain
from skylattice.sources.domain import with_tables
from skylattice.streaming import flight, fusion

c = lambda name: F.col(name)


def sensor_rows(spark, sf_dir):
    ts = F.timestamp_micros((c("t") * 1e6).cast("long"))
    rows = domain.frames(spark, sf_dir).withColumn("ts", ts).withColumn("drone", c("run")).withColumn("sigma", 5.0 + c("frame_id") % 9).withColumn("altitude", c("est_u") + 0.5)
    return rows.select("drone", "frame_id", "t", "ts", "est_e", "est_n", "est_u", "est_heading", "sigma", "altitude")


def truth_rows(spark, sf_dir):
    ts = F.timestamp_micros((c("t") * 1e6).cast("long"))
    return domain.frames(spark, sf_dir).where("frame_id % 97 <> 0").withColumn("ts", ts).select("frame_id", "ts", "truth_e", "truth_n", "truth_u")


#: Rows that a micro-batch of an ordered stream brings.
ROWS = 2_000_000


def as_stream(spark, rows, files: int = 1, ordered: bool = False):
    """A table of ``rows`` read as a stream of Parquet files, in about ``files`` micro-batches. No task writes more than the
    split that it reads, or a slice.

    ``ordered``: micro-batches follow each other in time, in slices of about ``ROWS`` rows at most, so that what a stream
    keeps of them does not grow with the table."""
    path = table_path(spark, "stream")
    if ordered:
        n = rows.count()
        sliced(spark, rows, max(files, -(-n // ROWS)), path)
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    (rows.repartition(files) if rows.rdd.getNumPartitions() < files else rows).write.parquet(path)
    written = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-written // files))).parquet(path)


def sliced(spark, rows, slices: int, path: str, at=None, files: int = 1, wide=lambda x: x) -> None:
    """``rows`` as files that follow each other in time, of about equally many rows; rows of one time stay together. The time
    is ``at``, else ``ts``. With more ``files`` than one, each slice is a folder of just as many under ``path``. ``wide``
    gives the rows to write, so that columns which it adds need not be staged."""
    found, at = rows, c("ts").cast("double") if at is None else at
    if slices > 1:
        staged = table_path(spark, "staged")
        cuts = rows.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
        part = sum((F.when(at > cut, 1).otherwise(0) for cut in sorted(set(cuts))), F.lit(0))
        rows.withColumn("slice", part).repartition("slice", F.pmod(F.xxhash64("ts"), F.lit(8))).write.partitionBy("slice").parquet(staged)
        found = spark.read.schema(StructType([*rows.schema.fields, StructField("slice", IntegerType())])).parquet(staged)
    for k in range(slices):
        own = found.where(c("slice") == k).drop("slice") if slices > 1 else rows
        if files == 1:
            wide(own).coalesce(1).write.mode("append").parquet(path)
        else:
            spread(spark, wide(own.repartition(files)), f"{path}/{k}", files)


def spread(spark, rows, path: str, files: int) -> None:
    """``rows`` of so many partitions as just so many files in a folder of their own, of which some are empty where there are
    few rows."""
    rows.write.parquet(path)
    for _ in range(files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)


def drained(spark, stream, mode: str = "append", each=None):
    """Runs a stream over all its input and returns what it wrote as a table."""
    from pyspark.sql import DataFrame

    path, check = table_path(spark, "sink"), table_path(spark, "progress")
    if each is None and mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode(mode)
    else:
        def put(batch: DataFrame, number: int) -> None:
            (each(batch) if each else batch).write.mode("append" if mode != "complete" else "overwrite").parquet(path)

        writer = stream.writeStream.outputMode(mode).foreachBatch(put)
    writer.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("R01_stream_join", with_tables("frames", f"SELECT frame_id, round({ERR}, 4) AS err FROM frames WHERE frame_id % 97 <> 0"))
def stream_join(spark, sf_dir):
    joined = flight.join_truth(as_stream(spark, sensor_rows(spark, sf_dir), ordered=True), as_stream(spark, truth_rows(spark, sf_dir), ordered=True))
    return drained(spark, joined.select("frame_id", r(evaluate.horizontal_error()).alias("err")))


for name, body in {
    "S20_sensor_stream": "SELECT frame_id, run AS drone FROM frames",
    "S21_truth_stream": "SELECT frame_id, truth_e FROM frames WHERE frame_id % 97 <> 0",
}.items():

    @query(name, with_tables("frames", body))
    def read_stream(spark, sf_dir, name=name):
        if name.startswith("S20"):
            return drained(spark, as_stream(spark, sensor_rows(spark, sf_dir), 4).select("frame_id", "drone"))
        return drained(spark, as_stream(spark, truth_rows(spark, sf_dir), 4).select("frame_id", "truth_e"))


@query("R02_newest_frame", with_tables("frames", "SELECT run AS drone, max(frame_id) AS frame_id, count(*) - 1 AS dropped FROM frames GROUP BY run"))
def newest_frame(spark, sf_dir):
    """One backlog of all frames: each drone answers its newest one and drops the others."""
    rows = as_stream(spark, sensor_rows(spark, sf_dir).select("drone", "frame_id", "t"))
    return drained(spark, rows, each=flight.newest_per_batch).select("drone", "frame_id", "dropped")


@query("R08_stream_metrics", with_tables("frames", f"SELECT run AS drone, count(*) AS n, round(avg({ERR}), 4) AS mean_error, round(sqrt(avg({ERR} ** 2)), 4) AS rmse, round(avg(abs(est_u - truth_u)), 4) AS alt_mae, round(avg(CASE WHEN {ERR} < 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS within_target FROM frames WHERE frame_id % 97 <> 0 GROUP BY run"))
def stream_metrics(spark, sf_dir):
    """Accuracy of the joined stream, kept as sums that each micro-batch adds to."""
    joined = flight.join_truth(as_stream(spark, sensor_rows(spark, sf_dir), 3, True), as_stream(spark, truth_rows(spark, sf_dir), 2, True))
    m = flight.sums_to_metrics(drained(spark, joined, each=lambda batch: flight.batch_sums(batch, 12.0)))
    return m.select("drone", "n", *[r(c(k)).alias(k) for k in ("mean_error", "rmse", "alt_mae", "within_target")])


@query("K13_estimate_sink", with_tables("frames", "SELECT frame_id, run AS drone, round(est_e, 4) AS e, round(est_n, 4) AS n FROM frames"))
def estimate_sink(spark, sf_dir):
    """Every frame's estimate as the stream delivers it, once each."""
    path, progress = table_path(spark, "estimates"), table_path(spark, "progress")
    rows = as_stream(spark, sensor_rows(spark, sf_dir), 4).select("frame_id", "drone", r(c("est_e")).alias("e"), r(c("est_n")).alias("n"))
    flight.sink_estimates(rows, path, progress)
    return spark.read.schema("frame_id long, drone long, e double, n double, batch long").parquet(path).drop("batch")


def at_time(t):
    """Timestamp of seconds since the first flight."""
    return F.timestamp_micros(((t + 1.7e9) * 1e6).cast("long"))


def flight_paths(spark, sf_dir):
    """Flights along smooth paths at five frames a second. Every 1,500 frames, one time in four, the drones are carried 600 m
    away."""
    k, turn = c("frame_id"), c("frame_id") / 300.0
    rows = domain.frames(spark, sf_dir).select("frame_id", c("run").alias("drone"), (k * 0.2).alias("t"), at_time(k * 0.2).alias("ts"), ((F.floor(k / 1500) % 4) == 3).alias("carried"))
    e, n = 800.0 * F.sin(turn + c("drone")) + F.when(c("carried"), 600.0).otherwise(0.0), 800.0 * F.cos(turn + c("drone"))
    rows = rows.withColumn("e", e).withColumn("n", n).withColumn("u", 60.0 + 20.0 * F.sin(turn * 2)).withColumn("yaw", F.pmod(F.degrees(turn + c("drone")) + 90.0, F.lit(360.0)))
    return rows.drop("carried")


def with_measurements(paths):
    """Frames of ``flight_paths`` with their measurements in their order.

    Retrieval and regression are some metres off and every 17th regression far off; the sun is seen in every fifth frame, the
    ground in two of three, and odometry has few inliers at times.
    """
    k, none = c("frame_id"), F.lit(None)
    jitter = lambda a, m, scale: (k * a % m - m // 2) / scale

    def one(kind, value, sigma=none, cov=none, inliers=none):
        fields = {"kind": F.lit(kind), "value": F.array(*[x.cast("double") for x in value]), "sigma": sigma.cast("double"), "cov": cov.cast("array<double>"), "n": inliers.cast("int")}
        return F.struct(*[v.alias(name) for name, v in fields.items()])

    near = [c("e") + jitter(73, 101, 10.0), c("n") + jitter(37, 89, 9.0), c("u") + jitter(53, 61, 10.0)]
    far = F.when(k % 17 == 0, 300.0).otherwise(0.0)
    cov = F.array(*[F.lit(float(x)) for x in (36, 9, 0, 9, 25, 0, 0, 0, 49)])
    listed = F.array(
        one("retrieval", near, cov=cov), one("regression", [c("e") + jitter(29, 71, 10.0) + far, c("n") + jitter(91, 67, 11.0), c("u") + jitter(17, 41, 5.0)], 4.0 + k % 5),
        one("regression_yaw", [c("yaw") + jitter(41, 31, 2.0)], F.lit(9.0)), one("retrieval_yaw", [c("yaw") + jitter(19, 43, 1.0)], F.lit(20.0)), one("sun_yaw", [c("yaw") + jitter(23, 13, 2.0)], F.lit(4.0)),
        one("altitude", [c("u") + jitter(11, 7, 2.0)], F.lit(3.0)), one("odometry", [jitter(7, 11, 10.0), 2.667 * 8 * 0.2 + jitter(13, 9, 10.0)], inliers=20 + k % 30),
    )
    seen = F.filter(listed, lambda m: ((m["kind"] != "sun_yaw") | (k % 5 == 0)) & ((m["kind"] != "altitude") | (k % 3 != 0)))
    return paths.select("drone", "frame_id", "t", "ts", seen.alias("measurements"))


def flight_rows(spark, sf_dir):
    return with_measurements(flight_paths(spark, sf_dir))


@query("R03_error_state_filter")
def error_state_filter(spark, sf_dir):
    """Estimates of every frame of every flight."""
    return fusion.fuse_flights(flight_rows(spark, sf_dir)).select("drone", "frame_id", *[r(c(k)).alias(k) for k in ("e", "n", "u", "ve", "vn", "heading", "sigma", "confidence")])


@query("R04_lost_detection")
def lost_detection(spark, sf_dir):
    """Frames after which a filter is lost, and those that start it (anew) from a retrieval."""
    out = fusion.fuse_flights(flight_rows(spark, sf_dir)).where("lost or started")
    return out.select("drone", "frame_id", "lost", "started", r(c("e")).alias("e"), r(c("n")).alias("n"))


@query("R05_measurement_schedule")
def measurement_schedule(spark, sf_dir):
    """Each measurement in the order it was looked at, and whether the gate let it pass."""
    out = fusion.fuse_flights(flight_rows(spark, sf_dir)).select("drone", "frame_id", F.posexplode(F.split("used", ",")).alias("k", "x"))
    return out.select("drone", "frame_id", "k", F.split("x", ":")[0].alias("kind"), (F.split("x", ":")[1] == "1").alias("used"))


def landed(spark, rows, delay: int):
    """An empty frame per drone, well after all others: what lets the watermark pass the last frames of a finished flight."""
    last = rows.groupBy("drone").agg(F.max("t").alias("t"), F.max("frame_id").alias("frame_id"))
    high = rows.agg(F.max("t").alias("high"))
    end = last.crossJoin(F.broadcast(high)).withColumn("t", c("high") + 3 * delay)  # one row
    return end.select("drone", (c("frame_id") + 1).alias("frame_id"), "t", at_time(c("t")).alias("ts"), F.array().cast(f"array<{fusion.MEASUREMENT}>").alias("measurements"))


#: Frames that a micro-batch of the stream brings, and files that they come in.
SLICE, FILES = 1_000_000, 8


def late_stream(spark, paths):
    """Frames of ``flight_paths`` as a stream in which they come up to four seconds late, a micro-batch for each slice."""
    path, n, rows = table_path(spark, "stream"), paths.count(), with_measurements(paths)
    sliced(spark, paths, max(3, -(-n // SLICE)), path, c("t") + c("frame_id") * 7 % 40 / 10.0, FILES, with_measurements)
    landed(spark, paths, 10).coalesce(1).write.parquet(f"{path}/landed")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/*")


@query("R03_filter_stream")
def filter_stream(spark, sf_dir):
    """The same filter over a stream whose frames come out of order, with its state kept between micro-batches."""
    out = drained(spark, fusion.fuse_stream(late_stream(spark, flight_paths(spark, sf_dir))))
    return out.select("drone", "frame_id", *[r(c(k)).alias(k) for k in ("e", "n", "u", "ve", "vn", "heading", "sigma", "confidence")])


@query("R06_particle_filter")
def particle_filter(spark, sf_dir):
    out = flight.particle_flights(sensor_rows(spark, sf_dir).drop("ts"))
    return out.select("drone", "frame_id", *[r(c(k)).alias(k) for k in ("e", "n", "yaw", "spread")])


#: Particles beside each fix (metres east and north, degrees), and how they score: nearer and less turned is better.
BESIDE = [(0, 0, 0), (10, 0, 5), (0, -20, -10), (-30, 15, 20)]


@query("X06_particle_score", with_tables("frames", f""", p AS (SELECT frame_id, run AS drone, k, exp(-0.5 * (x * x + y * y) / ((5 + frame_id % 9) ** 2)::DOUBLE - 0.5 * (turn / 20.0::DOUBLE) ** 2) AS score FROM frames CROSS JOIN (VALUES {", ".join(f"({k}, {x}, {y}, {t})" for k, (x, y, t) in enumerate(BESIDE))}) b(k, x, y, turn))
SELECT frame_id, drone, k, round(score, 4) AS score, round(exp(8 * score) / sum(exp(8 * score)) OVER (PARTITION BY frame_id), 4) AS weight FROM p"""))
def particle_score(spark, sf_dir):
    """A caller's score function over batches of particles, and the weights exp(8 * score) that it gives within a frame."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    def scored(parts):
        for p in parts:
            xy, fix = p[["x", "y"]].to_numpy(dtype=float), p[["e", "n"]].to_numpy(dtype=float)
            found = flight.fix_score(xy - fix, p["yaw"].to_numpy() - p["heading"].to_numpy(), np.zeros(2), 0.0, p["sigma"].to_numpy())
            yield pd.DataFrame({"frame_id": p["frame_id"], "drone": p["drone"], "k": p["k"], "score": np.clip(found, 0.0, 1.0)})

    beside = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy"), F.lit(float(t)).alias("turn")) for k, (x, y, t) in enumerate(BESIDE)]))
    rows = sensor_rows(spark, sf_dir).withColumn("b", beside)
    rows = rows.select("frame_id", "drone", c("b.k").alias("k"), (c("est_e") + c("b.dx")).alias("x"), (c("est_n") + c("b.dy")).alias("y"), (c("est_heading") + c("b.turn")).alias("yaw"), c("est_e").alias("e"), c("est_n").alias("n"), c("est_heading").alias("heading"), c("sigma").cast("double").alias("sigma"))
    out = rows.mapInPandas(scored, "frame_id long, drone long, k int, score double")
    raised = F.exp(8 * c("score"))
    return out.select("frame_id", "drone", "k", r(c("score")).alias("score"), r(raised / F.sum(raised).over(Window.partitionBy("frame_id"))).alias("weight"))


@query(
    "R07_tile_handoff",
    with_tables("captures frames", TILES + f""", c AS (SELECT *, round(est_e / 50) * 50 AS ce, round(est_n / 50) * 50 AS cn FROM frames),
f AS (SELECT run AS drone, frame_id, t, any_value(lost) AS lost, arg_min(tile, seq) FILTER (est_e BETWEEN e_min AND e_max AND est_n BETWEEN n_min AND n_max) AS fine, {NEAREST.format(e='ce', n='cn')} AS nearest FROM c CROSS JOIN g GROUP BY run, frame_id, t),
k AS (SELECT *, CASE WHEN lost OR row_number() OVER (PARTITION BY drone ORDER BY t, frame_id) = 1 THEN nearest ELSE fine END AS wanted FROM f),
h AS (SELECT *, last_value(wanted IGNORE NULLS) OVER (PARTITION BY drone ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS tile FROM k)
SELECT drone, frame_id, tile, coalesce(tile <> lag(tile) OVER (PARTITION BY drone ORDER BY t, frame_id), false) AS handed FROM h"""),
)
def tile_handoff(spark, sf_dir):
    """Coarse fixes are on a grid of 50 m."""
    coarse = lambda k: F.round(c(k) / 50) * 50
    frames = domain.frames(spark, sf_dir).select(c("run").alias("drone"), "frame_id", "t", "est_e", "est_n", coarse("est_e").alias("coarse_e"), coarse("est_n").alias("coarse_n"), "lost")
    return flight.route(frames, bounds_of(domain.captures(spark, sf_dir)), 3, 3)


@query("W15_systematic_resampling", with_tables("frames", """, w AS (SELECT run, frame_id, sum(confidence) OVER (PARTITION BY run ORDER BY frame_id) AS high, sum(confidence) OVER (PARTITION BY run) AS total, confidence FROM frames),
k AS (SELECT run, frame_id, high / total * 50 AS b, (high - confidence) / total * 50 AS a FROM w WHERE total > 0)
SELECT run, frame_id, CAST(greatest(0, ceil(round(b - CAST(0.5 AS DOUBLE), 6)) - ceil(round(a - CAST(0.5 AS DOUBLE), 6))) AS BIGINT) AS copies FROM k WHERE ceil(round(b - CAST(0.5 AS DOUBLE), 6)) > ceil(round(a - CAST(0.5 AS DOUBLE), 6))"""))  # fmt: skip
def systematic_resampling(spark, sf_dir):
    """How often each weighted row of a run is drawn by 50 even places of the cumulative weight."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("frame_id")
    total = F.sum("confidence").over(Window.partitionBy("run"))
    high = F.sum("confidence").over(w)
    place = lambda x: F.ceil(F.round(x / c("total") * 50 - 0.5, 6))
    rows = domain.frames(spark, sf_dir).withColumn("total", total).withColumn("high", high).where("total > 0")
    return rows.select("run", "frame_id", (place(c("high")) - place(c("high") - c("confidence"))).alias("copies")).where("copies > 0")


LOOP = evaluate.LoopPlan()
_RAW = "sqrt((est_e - truth_e) ** 2 + (est_n - truth_n) ** 2) * pow(0.7::DOUBLE, round - 1)"


@query("R09_capture_rounds", with_tables("frames", f""", n AS (SELECT unnest(range(1, {LOOP.max_rounds + 1})) AS round),
p AS (SELECT round, {_RAW} AS err, abs(est_u - truth_u) * pow(0.7::DOUBLE, round - 1) AS alt, confidence, truth_e, truth_n FROM frames JOIN n ON frame_id % {LOOP.max_rounds} = round % {LOOP.max_rounds} WHERE initialized),
m AS (SELECT round, quantile_cont(err, 0.95) AS p95, quantile_cont(alt, 0.95) AS alt_p95 FROM p GROUP BY round),
b AS (SELECT round, count(*) AS k, avg(confidence) AS conf, avg((err < {LOOP.p95})::INT::DOUBLE) AS hit FROM p GROUP BY round, least(4, floor(confidence * 5)) HAVING count(*) >= 5),
e AS (SELECT round, coalesce(sum(k * abs(conf - hit)) / sum(k), 0) AS ece FROM b GROUP BY round),
t AS (SELECT round, count(*) AS targets FROM (SELECT round, quantile_cont(err, 0.95) AS c95 FROM p GROUP BY round, floor(truth_e / 150), floor(truth_n / 150)) WHERE c95 > {LOOP.p95} GROUP BY round),
u AS (SELECT m.*, coalesce(ece, 0) AS ece, coalesce(targets, 0) AS targets, least({LOOP.budget}, {LOOP.first} + (m.round - 1) * {LOOP.more}) AS captures, (lag(p95) OVER w - p95) / greatest(lag(p95) OVER w, 1e-6) AS improvement FROM m LEFT JOIN e USING (round) LEFT JOIN t USING (round) WINDOW w AS (ORDER BY round)),
g AS (SELECT *, sum(CASE WHEN coalesce(improvement < {LOOP.epsilon}, false) THEN 0 ELSE 1 END) OVER (ORDER BY round) AS grp FROM u),
f AS (SELECT *, sum(CASE WHEN coalesce(improvement < {LOOP.epsilon}, false) THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY round) AS plateau FROM g),
s AS (SELECT *, CASE WHEN p95 <= {LOOP.p95} AND alt_p95 <= {LOOP.alt_p95} AND ece <= {LOOP.ece} THEN 'converged' WHEN plateau >= {LOOP.plateau_rounds} THEN 'plateau' WHEN captures >= {LOOP.budget} THEN 'budget_exhausted' WHEN round >= {LOOP.max_rounds} THEN 'max_rounds' END AS stop FROM f)
SELECT round, captures, round(p95, 4) AS p95, round(alt_p95, 4) AS alt_p95, round(ece, 4) AS ece, stop, CASE WHEN stop IS NOT NULL THEN 0 ELSE targets END AS targets, CASE WHEN stop IS NOT NULL THEN 0 ELSE least({LOOP.more}, {LOOP.budget} - captures) END AS planned
FROM s WHERE round <= (SELECT coalesce(min(round), 99) FROM s WHERE stop IS NOT NULL)"""))  # fmt: skip
def capture_rounds(spark, sf_dir):
    """Rounds of evaluation and capture until a stop rule holds. A round's probes are frames of their own, whose errors
    fall by three tenths from round to round, as if the model had learned."""
    frames = domain.frames(spark, sf_dir).where("initialized")

    def probes(k):
        smaller = lambda a, b: (c(b) + (c(a) - c(b)) * 0.7 ** (k - 1)).alias(a)
        own = frames.where(c("frame_id") % LOOP.max_rounds == k % LOOP.max_rounds)
        return own.select("frame_id", "confidence", "initialized", "truth_e", "truth_n", "truth_u", *[smaller(f"est_{x}", f"truth_{x}") for x in "enu"])

    history = evaluate.capture_loop(probes, LOOP, lambda cells, n, k: ingest.targeted_poses(ingest.allocate(cells, n), 150.0, 1000 + k).count())
    rows = [(h["round"], h["captures"], h["p95"], h["alt_p95"], h["ece"], h["stop"], h["targets"], h["planned"]) for h in history]
    out = spark.createDataFrame(rows, "round long, captures long, p95 double, alt_p95 double, ece double, stop string, targets long, planned long")
    return out.select("round", "captures", *[r(c(k)).alias(k) for k in ("p95", "alt_p95", "ece")], "stop", "targets", "planned")


def encoded(poses):
    """A descriptor of eight numbers: waves of 1.9 km and 440 m along both axes."""
    waves = [f(c(k) / w) for w in (300.0, 70.0) for k in "en" for f in (F.cos, F.sin)]
    return poses.withColumn("v", F.array(*[x / 2 for x in waves]))


EVIDENCE = evaluate.LoopPlan(budget=900, first=300, more=200, max_rounds=5, p95=60.0, alt_p95=30.0, ece=0.4)


@query("R09_capture_loop")
def capture_loop_on_evidence(spark, sf_dir):
    """Rounds of capture from all frames' poses on: probes are located among the landmarks so far, and new poses are taken
    where they miss."""
    poses = domain.frames(spark, sf_dir).select(c("truth_e").alias("e"), c("truth_n").alias("n"), c("truth_u").alias("u")).distinct()
    box = poses.agg(*[f(k).alias(f"{name}_{k}") for k in "en" for name, f in (("low", F.min), ("high", F.max))]).first()
    area = capture_loop.Area(box["low_e"], box["high_e"], box["low_n"], box["high_n"], plan=EVIDENCE)
    history = capture_loop.run(area, poses.orderBy(F.xxhash64("e", "n", "u"), "e", "n", "u").limit(EVIDENCE.first), encoded, table_path(spark, "loop"))
    out = spark.createDataFrame([tuple(h[k.split()[0]] for k in capture_loop.HISTORY.split(", ")) for h in history], capture_loop.HISTORY)
    return out.select("round", "captures", *[r(c(k)).alias(k) for k in ("p95", "alt_p95", "ece")], "stop", "targets", "planned")

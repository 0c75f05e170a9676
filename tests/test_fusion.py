"""The fusion filter against a textbook filter of seven states, golden trajectories, and the stream against the batch."""

import math
import os
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.plans import streams
from skylattice.streaming import fusion
from skylattice.streaming.fusion import Fusion


class Textbook:
    """Seven states, every measurement through a matrix of its own."""

    def __init__(self):
        self.x, self.P, self.live, self.streak, self.t = np.zeros(7), np.eye(7), False, 0, None

    def update(self, rows, z, R, angle=False):
        H = np.zeros((len(rows), 7))
        H[range(len(rows)), rows] = 1
        y = np.asarray(z, dtype=float) - H @ self.x
        if angle:
            y = (y + math.pi) % (2 * math.pi) - math.pi
        S = H @ self.P @ H.T + R
        free = math.degrees(math.sqrt(self.P[6, 6])) > 25 if angle else math.sqrt((self.P[0, 0] + self.P[1, 1]) / 2) > 40
        if not free and y @ np.linalg.inv(S) @ y > 2 * {1: 6.63, 3: 11.34}[len(rows)]:
            return False
        K = self.P @ H.T @ np.linalg.inv(S)
        self.x = self.x + K @ y
        self.x[6] = (self.x[6] + math.pi) % (2 * math.pi) - math.pi
        A = np.eye(7) - K @ H
        self.P = A @ self.P @ A.T + K @ R @ K.T
        return True

    def frame(self, t, ms):
        dt = 0.0 if self.t is None else max(t - self.t, 0.0)
        first, self.t, before, began = self.t is None, t, self.x[6], False
        cov = lambda m: np.array(m["cov"]).reshape(3, 3) if "cov" in m else np.diag([1, 1, 2]) * m["sigma"] ** 2
        fix = [m for m in ms if m["kind"] == "retrieval"]
        if fix and (not self.live or self.streak >= 12):
            yaw = [m["value"][0] for m in ms if m["kind"] == "retrieval_yaw"] or [0.0]
            self.x = np.array([*fix[0]["value"], 0, 0, 0, math.radians(yaw[0] % 360)], dtype=float)
            self.P = np.zeros((7, 7))
            self.P[:3, :3], self.P[3:6, 3:6], self.P[6, 6] = 2 * cov(fix[0]), np.eye(3) * 16, math.radians(35) ** 2
            self.live, self.streak, began = True, 0, True
        if not self.live:
            return False, []
        if dt > 0:
            A, Q = np.eye(7), np.zeros((7, 7))
            for i in range(3):
                A[i, i + 3] = dt
                Q[i, i], Q[i, i + 3], Q[i + 3, i], Q[i + 3, i + 3] = 1.44 * dt**3 / 3, 1.44 * dt**2 / 2, 1.44 * dt**2 / 2, 1.44 * dt
            Q[6, 6] = math.radians(10) ** 2 * dt
            self.x, self.P = A @ self.x, A @ self.P @ A.T + Q
        used = []
        for m in ms:
            if m["kind"] in ("retrieval", "regression"):
                took = self.update([0, 1, 2], m["value"], cov(m))
                self.streak = 0 if took else self.streak + 1
            elif m["kind"].endswith("_yaw"):
                took = self.update([6], [math.radians(m["value"][0] % 360)], np.array([[math.radians(m["sigma"]) ** 2]]), True)
            elif m["kind"] == "altitude":
                took = self.update([2], m["value"], np.array([[m["sigma"] ** 2]]))
            elif not first and dt > 1e-3 and m["n"] >= 25:
                s = min(max(6 / math.sqrt(m["n"]), 0.6), 3.0)
                a, b = m["value"]
                took = self.update([3, 4, 5], np.array([a * math.cos(before) + b * math.sin(before), b * math.cos(before) - a * math.sin(before), 0]) / dt, np.diag([s * s, s * s, 4 * s * s]))
            else:
                continue
            used.append((m["kind"], took))
        return began, used


def frames(seed, n=300):
    r = np.random.default_rng(seed)
    t, out = 0.0, []
    for k in range(n):
        t += float(r.choice([0.0, 0.1, 0.2, 0.5]))
        at = np.array([3.0 * t, -2.0 * t, 60.0]) + (1500.0 if 150 < k < 250 else 0.0)
        ms = []
        if r.random() < 0.8:
            a = r.normal(size=(3, 3))
            ms.append({"kind": "retrieval", "value": (at + r.normal(size=3) * 5).tolist(), "cov": (a @ a.T * 9 + np.eye(3) * 9).ravel().tolist()})
        ms.append({"kind": "regression", "value": (at + r.normal(size=3) * 4 + (400 if r.random() < 0.1 else 0)).tolist(), "sigma": 5.0})
        ms += [{"kind": "regression_yaw", "value": [350 + r.normal() * 12 + (90 if r.random() < 0.1 else 0)], "sigma": 9.0}, {"kind": "retrieval_yaw", "value": [350 + r.normal() * 20], "sigma": 20.0}]
        ms += [{"kind": "altitude", "value": [60 + r.normal() * 2], "sigma": 3.0}, {"kind": "odometry", "value": r.normal(size=2).tolist(), "n": int(r.integers(10, 60))}]
        out.append((t, ms))
    return out


def test_filter_equals_the_textbook():
    for seed in range(4):
        f, g, lost = Fusion(), Textbook(), 0
        for t, ms in frames(seed):
            assert f.frame(t, ms) == g.frame(t, ms)
            assert np.allclose(f.x, g.x[:6], atol=1e-6) and abs(f.yaw - g.x[6]) < 1e-9 and np.allclose(f.P, g.P[:6, :6], atol=1e-6)
            assert f.lost == (g.live and g.streak >= 12)
            lost += f.lost
            f = Fusion.of(f.kept())
        assert lost > 0


def test_golden_trajectories():
    r = np.random.default_rng(1)
    f = Fusion()
    for k in range(60):
        f.frame(k * 0.2, [{"kind": "retrieval", "value": (np.array([120.0, -40.0, 70.0]) + r.normal(size=3) * 5).tolist(), "cov": (np.eye(3) * 25).ravel().tolist()}])
    assert np.linalg.norm(f.x[:3] - [120, -40, 70]) < 5 and f.spread < 4
    f, at, speed = Fusion(), np.array([0.0, 0.0, 50.0]), np.array([6.0, 3.0, 0.0])
    for k in range(100):
        at = at + speed * 0.2
        f.frame(k * 0.2, [{"kind": "retrieval", "value": (at + r.normal(size=3) * 4).tolist(), "cov": (np.eye(3) * 16).ravel().tolist()}])
    assert np.linalg.norm(f.x[3:5] - speed[:2]) < 2 and np.linalg.norm(f.x[:2] - at[:2]) < 8
    assert f.frame(20.2, [{"kind": "regression", "value": [900.0, 900.0, 50.0], "sigma": 2.0}]) == (False, [("regression", False)])
    for k in range(11):
        f.frame(20.4 + k * 0.2, [{"kind": "regression", "value": [900.0, 900.0, 50.0], "sigma": 2.0}])
    assert f.lost and f.confidence < 0.8
    assert f.frame(30.0, [{"kind": "retrieval", "value": [900.0, 900.0, 50.0], "sigma": 2.0}]) == (True, [("retrieval", True)]) and not f.lost
    g = Fusion()
    assert g.frame(0.0, [{"kind": "regression", "value": [1.0, 1.0, 1.0], "sigma": 1.0}]) == (False, []) and g.confidence == 0 and not g.live


def test_three_queries_tell_of_one_flight(spark, sf_dir):
    est = {(r.drone, r.frame_id): r for r in streams.error_state_filter(spark, sf_dir).collect()}
    lost = streams.lost_detection(spark, sf_dir).collect()
    used = streams.measurement_schedule(spark, sf_dir).collect()
    assert len(est) == streams.flight_rows(spark, sf_dir).count() and len(used) > 5 * len(est)
    assert sum(r.started for r in lost) > len({r.drone for r in lost})  # some were carried away and found themselves again
    order = ["retrieval", "regression", "regression_yaw", "retrieval_yaw", "sun_yaw", "altitude", "odometry"]
    by_frame = {}
    for r in used:
        by_frame.setdefault((r.drone, r.frame_id), []).append((r.k, order.index(r.kind)))
    assert all(sorted(v) == sorted(v, key=lambda x: x[1]) for v in by_frame.values())
    assert any(r.kind == "regression" and not r.used and r.frame_id % 17 == 0 for r in used)


def test_stream_equals_batch_though_frames_come_late(spark, sf_dir):
    assert sorted(map(tuple, streams.error_state_filter(spark, sf_dir).collect())) == sorted(map(tuple, streams.filter_stream(spark, sf_dir).collect()))


def test_stream_goes_on_where_it_was_stopped(spark, sf_dir, tmp_path):
    rows = streams.flight_rows(spark, sf_dir)
    want = sorted(map(tuple, fusion.fuse_flights(rows).select("drone", "frame_id", "e", "n", "lost").collect()))
    source, sink, progress = (f"{tmp_path}/{k}" for k in ("source", "sink", "progress"))
    half = rows.agg(F.max("t")).first()[0] / 2

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        out = fusion.fuse_stream(stream).select("drone", "frame_id", "e", "n", "lost")
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()

    rows.where(F.col("t") <= half).write.parquet(source)
    run()
    first = spark.read.parquet(sink).count()
    rows.where(F.col("t") > half).write.mode("append").parquet(source)
    streams.landed(spark, rows, 10).write.mode("append").parquet(source)
    run()
    assert 0 < first < len(want) and sorted(map(tuple, spark.read.parquet(sink).collect())) == want


def test_a_frame_costs_a_fraction_of_the_textbook_filter():
    def least(kind):
        took = []
        for _ in range(5):
            f, began = kind(), time.process_time()
            for t, ms in given:
                f.frame(t, ms)
            took.append(time.process_time() - began)
        return min(took)

    given = frames(7)
    assert least(Fusion) * 4 < least(Textbook)


def test_flat_measurements_are_those_of_the_structs(spark):
    odd = [
        [("retrieval", [1.0, 2.0, 3.0], None, [4.0, 1.0, 0.5, 1.0, 5.0, 0.25, 0.5, 0.25, 6.0], None), ("retrieval_yaw", [370.0], 9.0, None, None)],
        [("odometry", [0.1, 0.2], None, None, 30), ('said "so", \u00e9', [7.0], 1.0, None, None), ("sun_yaw", [5.0], 4.0, [], 0), ("altitude", [3.5], 2.0, None, None)],
        None,
        [],
        [("unknown", None, None, None, None), ("regression", [2.0, 2.0, 2.0], 3.0, None, None), ("odometry", [0.1, 0.2], 1.0, None, 5)],
    ]
    rows = spark.createDataFrame([(1, k, k * 0.2, ms) for k, ms in enumerate(odd)], f"drone long, frame_id long, t double, measurements array<{fusion.MEASUREMENT}>")
    f, want = Fusion(), []
    for k, ms in enumerate(odd):
        given = [{n: v for n, v in zip(("kind", "value", "sigma", "cov", "n"), m) if v is not None} for m in ms or [] if m[0] != "unknown"]
        began, used = f.frame(k * 0.2, given)
        want.append((k, *f.x[:3].tolist(), math.degrees(f.yaw) % 360, f.spread, f.confidence, began, ",".join(f"{a}:{int(b)}" for a, b in used)))
    got = fusion.fuse_flights(rows).select("frame_id", "e", "n", "u", "heading", "sigma", "confidence", "started", "used").orderBy("frame_id").collect()
    assert [tuple(r) for r in got] == want and "odometry:1" in got[1].used


class Kept:
    """A value or a list, as a state store keeps it."""

    def __init__(self):
        self.rows = []

    exists = lambda self: bool(self.rows)
    clear = lambda self: self.rows.clear()
    appendList = lambda self, rows: self.rows.extend(rows)  # noqa: E731, N815

    def put(self, rows):
        self.rows = list(rows)


class KeptValue(Kept):
    get = lambda self: self.rows[0]

    def update(self, row):
        self.rows = [row]


class KeptList(Kept):
    get = lambda self: iter(list(self.rows))


class Handle:
    getValueState = lambda self, name, schema: KeptValue()  # noqa: E731, N815
    getListState = lambda self, name, schema: KeptList()  # noqa: E731, N815
    registerTimer = lambda self, ms: None  # noqa: E731, N815


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def arrow(spark, listed, order):
    rows = spark.createDataFrame([(d, k, t, [(m["kind"], m["value"], m.get("sigma"), m.get("cov"), m.get("n")) for m in ms]) for d, k, t, ms in listed], f"drone long, frame_id long, t double, measurements array<{fusion.MEASUREMENT}>")
    table = fusion._plain(rows.withColumn("ts", streams.at_time(F.col("t"))), "ts", (F.col("t") * 1000).cast("long").alias("ms")).toArrow()
    return table.take(order).combine_chunks().to_batches()[0]


def test_waiting_frames_are_kept_by_the_batch_and_late_ones_left_out(spark):
    listed = [(d, k, t + k * 0.01, ms) for d in (3, 5) for k, (t, ms) in enumerate(frames(2, 120))]
    batch = arrow(spark, listed, np.random.default_rng(1).permutation(len(listed)))
    packs = pa.Table.from_batches(fusion.packs(iter([batch]))).to_pandas()
    assert packs["drone"].tolist() == [3, 5] and packs["last"].max() == max(batch["ms"].to_pylist())
    p = fusion.FusionProcessor()
    p.init(Handle())
    p.handleInputRows((5,), iter([packs[packs["drone"] == 5]]), None)
    assert len(p.waiting.rows) == 1  # not a row for every frame
    half = int(listed[60][2] * 1000)
    got = list(p.handleExpiredTimer((5,), Mark(half), None))
    late = arrow(spark, [(5, 999, 0.5, [])], [0])
    p.handleInputRows((5,), iter([pa.Table.from_batches(fusion.packs(iter([late]))).to_pandas()]), None)
    got += list(p.handleExpiredTimer((5,), Mark(10**9), None))
    f, want = Fusion(), []
    for d, k, t, ms in listed[120:]:
        f.frame(t, ms)
        want.append((k, *f.x[:3].tolist()))
    assert [tuple(x) for x in pd.concat(got)[["frame_id", "e", "n", "u"]].itertuples(index=False)] == want and not p.waiting.rows


@pytest.mark.parametrize("n", [0, 5, 900])
def test_micro_batches_are_bounded_though_times_are_crowded(spark, sf_dir, monkeypatch, tmp_path, n):
    monkeypatch.setattr(streams, "SLICE", 100)
    made = []
    monkeypatch.setattr(streams, "table_path", lambda spark, kind: made.append(f"{tmp_path}/{kind}") or made[-1])
    paths = streams.flight_paths(spark, sf_dir).where(F.col("frame_id") < n)
    t = F.when(F.col("frame_id") == n - 1, 1e6).otherwise(F.col("t"))  # one frame long after all others
    streams.late_stream(spark, paths.withColumn("t", t).withColumn("ts", streams.at_time(t)))
    slices = sorted((x for x in os.listdir(made[0]) if x != "landed"), key=int)
    files = [[f"{made[0]}/{k}/{x}" for x in os.listdir(f"{made[0]}/{k}") if x.endswith(".parquet")] for k in slices]
    assert {len(x) for x in files} == {streams.FILES}  # a micro-batch takes a slice, not more or less
    rows = [spark.read.parquet(*x).count() for x in files]
    assert sum(rows) == n and max(rows) <= max(120, -(-n // 3) + 1)
    times = [[os.stat(f).st_mtime_ns for f in x] for x in files]
    assert all(max(a) < min(b) for a, b in zip(times, times[1:]))

"""Fusion of localization cues per drone: a seven-state error-state filter over frames that carry their measurements.

State: place and velocity (east, north, up) and heading. No measurement ties the heading to the rest, so it is a filter of
its own beside one of six states. Updates are in Joseph form, behind a gate on the normalised innovation; with the gain that
is used here, much of that form cancels in the blocks that hold a measured state, and is left out there. They work on plain
floats in blocks of three by three: calls on arrays as small as these cost several times their arithmetic.

A frame's measurements are used in the order they are listed in. The first fix of kind ``retrieval`` starts the filter, and
starts it anew when it is lost: after ``LOST_AFTER`` absolute fixes in a row that the gate turned away. The batch form folds
a flight at once; the stream keeps each drone's filter as value state, and its frames wait in list state, packed by the
Arrow batch that they came in, until the watermark has passed them (an event-time timer), so that both give the same
whatever order frames arrive in.

Defined results: frames before the first retrieval have no estimate of their own (places are 0, confidence 0); a frame at or
before the time of the one before it moves nothing; frames of the same time go by frame_id; odometry needs a frame before.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# 99 % quantiles of chi-square by degrees of freedom, doubled for the gate; spreads above which nothing is
# gated; process noise; spreads at a start; frames that health looks back on.
CHI2_99 = {1: 6.63, 2: 9.21, 3: 11.34}
GATE = {states: 2 * limit for states, limit in CHI2_99.items()}
FREE_POS, FREE_YAW = 40.0, math.radians(25.0)
ACCEL, YAW_RATE = 1.2, math.radians(10.0)
START_SPEED, START_YAW, LOST_AFTER, LOOK_BACK = 4.0, math.radians(35.0), 12, 20
LEAST_INLIERS = 25

#: A measurement: ``retrieval`` and ``regression`` fix a place (value: east, north, up; covariance of nine numbers, else from
#: ``sigma``, with twice the variance upwards), ``..._yaw`` a heading in degrees, ``altitude`` a height; ``odometry`` is a
#: displacement to the right and ahead since the frame before, from ``n`` inliers.
MEASUREMENT = "struct<kind: string, value: array<double>, sigma: double, cov: array<double>, n: int>"
ESTIMATE = (
    "drone long, frame_id long, t double, e double, n double, u double, ve double, vn double, heading double, sigma double, confidence double,"
    " started boolean, lost boolean, used string"
)
COLUMNS = [c.split()[0] for c in ESTIMATE.split(", ")]
STATE = "x array<double>, p array<double>, streak int, recent int, seen int, t double, live boolean"


#: Three by three numbers, row by row.
Block = tuple[float, ...]


def along(a: float, b: float, c: float) -> Block:
    """Diagonal block."""
    return a, 0.0, 0.0, 0.0, b, 0.0, 0.0, 0.0, c


def spread_of(cov: list[float] | None, sigma: float) -> Block:
    """Covariance of a place."""
    if cov:
        return tuple(cov)
    r = sigma * sigma
    return along(r, r, 2.0 * r)


#: What is done with a measurement.
FIX, TURN, HEIGHT, MOVE, NOTHING = range(5)


def use_of(kind: str) -> int:
    return {"retrieval": FIX, "regression": FIX, "altitude": HEIGHT, "odometry": MOVE}.get(kind, TURN if kind.endswith("_yaw") else NOTHING)


def plus(x: Block, y: Block) -> Block:
    a, b, c, d, e, f, g, h, i = x
    j, k, l, m, n, o, p, q, r = y
    return a + j, b + k, c + l, d + m, e + n, f + o, g + p, h + q, i + r


def rest_of(x: Block) -> Block:
    """What ``x`` leaves of one."""
    a, b, c, d, e, f, g, h, i = x
    return 1.0 - a, -b, -c, -d, 1.0 - e, -f, -g, -h, 1.0 - i


def less(x: Block, y: Block, z: Block) -> Block:
    """``x`` less ``y`` and its mirror image, and more ``z``, all symmetric but ``y``."""
    a, b, c, _, e, f, _, _, i = x
    j, k, l, m, n, o, p, q, r = y
    s, t, u, _, w, v, _, _, z9 = z
    t, u, v = b - k - m + t, c - l - p + u, f - o - q + v
    return a - j - j + s, t, u, t, e - n - n + w, v, u, v, i - r - r + z9


def turned(x: Block) -> Block:
    a, b, c, d, e, f, g, h, i = x
    return a, d, g, b, e, h, c, f, i


def times(x: Block, y: Block) -> Block:
    a, b, c, d, e, f, g, h, i = x
    j, k, l, m, n, o, p, q, r = y
    return (
        a * j + b * m + c * p, a * k + b * n + c * q, a * l + b * o + c * r,
        d * j + e * m + f * p, d * k + e * n + f * q, d * l + e * o + f * r,
        g * j + h * m + i * p, g * k + h * n + i * q, g * l + h * o + i * r,
    )


def applied(x: Block, v: tuple) -> tuple:
    a, b, c, d, e, f, g, h, i = x
    u, v, w = v
    return a * u + b * v + c * w, d * u + e * v + f * w, g * u + h * v + i * w


def mirrored(x: Block, y: Block) -> Block:
    """Product of which it is known that it is symmetric."""
    a, b, c, d, e, f, g, h, i = x
    j, k, l, m, n, o, p, q, r = y
    u, v, w = a * k + b * n + c * q, a * l + b * o + c * r, d * l + e * o + f * r
    return a * j + b * m + c * p, u, v, u, d * k + e * n + f * q, w, v, w, g * l + h * o + i * r


def inverse(x: Block) -> Block:
    a, b, c, d, e, f, g, h, i = x
    p, q, r = e * i - f * h, f * g - d * i, d * h - e * g
    k = 1.0 / (a * p + b * q + c * r)
    return p * k, (c * h - b * i) * k, (b * f - c * e) * k, q * k, (a * i - c * g) * k, (c * d - a * f) * k, r * k, (b * g - a * h) * k, (a * e - b * d) * k


def without(x: Block, left: tuple, right: tuple, rest: tuple, gain: tuple) -> Block:
    """``x`` less the products of ``left`` with ``right`` and of ``rest`` with ``gain``."""
    a, b, c, d, e, f, g, h, i = x
    (u, v, w), (j, k, l), (m, n, o), (p, q, r) = left, right, rest, gain
    return (
        a - u * j - m * p, b - u * k - m * q, c - u * l - m * r,
        d - v * j - n * p, e - v * k - n * q, f - v * l - n * r,
        g - w * j - o * p, h - w * k - o * q, i - w * l - o * r,
    )


ONE, SQUARED_ACCEL, SQUARED_TURN = along(1.0, 1.0, 1.0), ACCEL * ACCEL, YAW_RATE * YAW_RATE


def wrapped(angle: float) -> float:
    return (angle + math.pi) % (2 * math.pi) - math.pi


class Fusion:
    """``place`` and ``speed`` with the covariance of each and of place (rows) with speed; heading in radians and its
    variance. Covariances of measurements are symmetric."""

    def __init__(self, target: float = 12.0, floor: float = 1.5):
        self.place = self.speed = (0.0, 0.0, 0.0)
        self.in_place, self.between, self.in_speed = ONE, (0.0,) * 9, ONE
        self.yaw, self.yaw_var = 0.0, 1.0
        self.live, self.streak, self.recent, self.seen, self.t = False, 0, 0, 0, None
        self.target, self.floor = target, floor

    @property
    def x(self) -> np.ndarray:
        return np.array([*self.place, *self.speed])

    @property
    def P(self) -> np.ndarray:  # noqa: N802
        a, b, c = (np.array(m).reshape(3, 3) for m in (self.in_place, self.between, self.in_speed))
        return np.block([[a, b], [b.T, c]])

    def start(self, place: list[float], cov: Block, heading: float) -> None:
        e, n, u = place
        self.place, self.speed = (float(e), float(n), float(u)), (0.0, 0.0, 0.0)
        self.in_place, self.between, self.in_speed = plus(cov, cov), (0.0,) * 9, along(*[START_SPEED**2] * 3)
        self.yaw, self.yaw_var = math.radians(heading % 360.0), START_YAW**2
        self.live, self.streak = True, 0

    @property
    def lost(self) -> bool:
        return self.live and self.streak >= LOST_AFTER

    @property
    def spread(self) -> float:
        return math.sqrt(max(0.5 * (self.in_place[0] + self.in_place[4]), 0.0))

    def predict(self, dt: float) -> None:
        if dt <= 0:
            return
        (e, n, u), (ve, vn, vu) = self.place, self.speed
        self.place = e + dt * ve, n + dt * vn, u + dt * vu
        a, b, c, d, e, f, g, h, i = self.in_place
        j, k, l, m, n, o, p, q, r = self.between
        s, t, u, v, w, x, y, z, zz = self.in_speed
        q1, dd = SQUARED_ACCEL * dt, dt * dt
        q2, q3, b2, b3, c3 = q1 * dt / 2, q1 * dd / 3, k + m, l + p, o + q
        self.in_place = (
            a + 2 * dt * j + dd * s + q3, b + dt * b2 + dd * t, c + dt * b3 + dd * u,
            d + dt * b2 + dd * v, e + 2 * dt * n + dd * w + q3, f + dt * c3 + dd * x,
            g + dt * b3 + dd * y, h + dt * c3 + dd * z, i + 2 * dt * r + dd * zz + q3,
        )
        self.between = j + dt * s + q2, k + dt * t, l + dt * u, m + dt * v, n + dt * w + q2, o + dt * x, p + dt * y, q + dt * z, r + dt * zz + q2
        self.in_speed = s + q1, t, u, v, w + q1, x, y, z, zz + q1
        self.yaw_var += SQUARED_TURN * dt

    def gated(self, distance: float, states: int) -> bool:
        """Whether an innovation of that squared normalised length is turned away; none is while places are wide."""
        return distance > GATE[states] and self.spread <= FREE_POS

    def at_place(self, value: list[float], cov: Block) -> bool:
        """Updates with a measurement of the place; whether the gate let it pass."""
        found = self._joseph(self.place, self.in_place, self.between, self.in_speed, value, cov)
        if found is None:
            return False
        moved, beside, self.in_place, self.between, self.in_speed = found
        (e, n, u), (ve, vn, vu), (a, b, c), (d, f, g) = self.place, self.speed, moved, beside
        self.place, self.speed = (e + a, n + b, u + c), (ve + d, vn + f, vu + g)
        return True

    def at_speed(self, value: list[float], cov: Block) -> bool:
        """The same with a measurement of the velocity."""
        found = self._joseph(self.speed, self.in_speed, turned(self.between), self.in_place, value, cov)
        if found is None:
            return False
        moved, beside, self.in_speed, between, self.in_place = found
        self.between = turned(between)
        (e, n, u), (ve, vn, vu), (a, b, c), (d, f, g) = self.place, self.speed, beside, moved
        self.place, self.speed = (e + a, n + b, u + c), (ve + d, vn + f, vu + g)
        return True

    def _joseph(self, states: tuple, own: Block, cross: Block, other: Block, value: list[float], cov: Block) -> tuple | None:
        """How a measurement of three ``states`` moves them and the other three, and the covariance (``own``, with the others:
        ``cross``, of the ``other`` ones) after it, None if gated. Of (1 - K H) P (1 - K H)' + K R K' the first block is
        A inv(A + R) R and the second (1 - K) B, without the rest, which is zero for this gain."""
        (e, n, u), (x, y, z) = value, states
        off = e - x, n - y, u - z
        s = plus(own, cov)
        inv = inverse(s)
        a, b, c = applied(inv, off)
        if self.gated(off[0] * a + off[1] * b + off[2] * c, 3):
            return None
        gain, beside = times(own, inv), times(turned(cross), inv)
        new_other = less(other, times(beside, cross), mirrored(times(beside, s), turned(beside)))
        return applied(gain, off), applied(beside, off), mirrored(gain, cov), times(rest_of(gain), cross), new_other

    def at_height(self, value: float, r: float) -> bool:
        """Updates with a measurement of the height; whether the gate let it pass."""
        (e, n, u), (ve, vn, vu), p, b = self.place, self.speed, self.in_place, self.between
        off, s = value - u, p[8] + r
        if self.gated(off * off / s, 1):
            return False
        own, other = (p[2], p[5], p[8]), (b[6], b[7], b[8])
        i, j, k = gain = own[0] / s, own[1] / s, own[2] / s
        x, y, z = beside = other[0] / s, other[1] / s, other[2] / s
        rest, more = (own[0] - i * s, own[1] - j * s, own[2] - k * s), (other[0] - x * s, other[1] - y * s, other[2] - z * s)
        self.in_place, self.between = without(p, gain, own, rest, gain), without(b, gain, other, rest, beside)
        self.in_speed = without(self.in_speed, beside, other, more, beside)
        self.place, self.speed = (e + i * off, n + j * off, u + k * off), (ve + x * off, vn + y * off, vu + z * off)
        return True

    def heading(self, degrees: float, sigma: float) -> bool:
        off, r = wrapped(math.radians(degrees % 360.0) - self.yaw), math.radians(sigma) ** 2
        s = self.yaw_var + r
        if off * off / s > GATE[1] and math.sqrt(max(self.yaw_var, 0.0)) <= FREE_YAW:
            return False
        g = self.yaw_var / s
        self.yaw = wrapped(self.yaw + g * off)
        self.yaw_var = (1 - g) ** 2 * self.yaw_var + g * g * r
        return True

    def frame(self, t: float, measurements: list[dict]) -> tuple[bool, list[tuple[str, bool]]]:
        """One frame: whether the filter started with it, and each measurement that was looked at and if it was used."""
        return self.fused(t, [(m["kind"], use_of(m["kind"]), m["value"], m.get("cov"), m.get("sigma", 0.0), m.get("n", 0)) for m in measurements])

    def fused(self, t: float, measurements: list[tuple]) -> tuple[bool, list[tuple[str, bool]]]:
        """The same with measurements as tuples: kind and use of it, value, covariance, sigma, inliers."""
        dt = 0.0 if self.t is None else max(t - self.t, 0.0)
        first, self.t, before = self.t is None, t, self.yaw
        began = False
        if not self.live or self.lost:
            fix = next((m for m in measurements if m[0] == "retrieval"), None)
            if fix is not None:
                self.start(fix[2], spread_of(fix[3], fix[4]), next((m[2][0] for m in measurements if m[0] == "retrieval_yaw"), 0.0))
                began = True
        if not self.live:
            return False, []
        self.predict(dt)
        used, fixed = [], False
        for kind, use, value, cov, sigma, n in measurements:
            if use == FIX:
                took = self.at_place(value, spread_of(cov, sigma))
                self.streak = 0 if took else self.streak + 1
                fixed = fixed or took
            elif use == TURN:
                took = self.heading(value[0], sigma)
            elif use == HEIGHT:
                took = self.at_height(value[0], sigma * sigma)
            elif use == MOVE and not first and dt > 1e-3 and n >= LEAST_INLIERS:
                (right, ahead), wide = value, min(max(6.0 / math.sqrt(n), 0.6), 3.0)
                cos, sin, r = math.cos(before), math.sin(before), wide * wide
                took = self.at_speed([(right * cos + ahead * sin) / dt, (ahead * cos - right * sin) / dt, 0.0], along(r, r, 4 * r))
            else:
                continue
            used.append((kind, took))
        self.recent, self.seen = (self.recent << 1 | fixed) & ((1 << LOOK_BACK) - 1), min(self.seen + 1, LOOK_BACK)
        return began, used

    @property
    def confidence(self) -> float:
        if not self.live:
            return 0.0
        wide = max(self.spread, self.floor)
        near = 1 - math.exp(-(self.target**2) / (2 * wide**2))
        health = self.recent.bit_count() / self.seen if self.seen else 0.0
        return min(max(near * (0.3 + 0.7 * health), 0.0), 1.0)

    def kept(self) -> tuple:
        return [*self.place, *self.speed, self.yaw], [*self.P.ravel().tolist(), self.yaw_var], self.streak, self.recent, self.seen, self.t, self.live

    @classmethod
    def of(cls, kept: tuple) -> Fusion:
        f = cls()
        x, p, f.streak, f.recent, f.seen, f.t, f.live = kept
        f.place, f.speed, f.yaw, f.yaw_var = tuple(x[:3]), tuple(x[3:6]), x[6], p[36]
        f.in_place, f.between, f.in_speed = (tuple(v for k in range(3) for v in p[a + 6 * k : a + 6 * k + 3]) for a in (0, 3, 21))
        return f


@lru_cache(1024)
def uses_of(listed: str) -> list[tuple[str, int]]:
    return [(kind, use_of(kind)) for kind in json.loads(listed)]


def measured(kinds: str, numbers: list[float]) -> list[tuple]:
    """Measurements of a frame from its columns ``kinds`` and ``numbers``."""
    out, at = [], 0
    for kind, use in uses_of(kinds):
        values, covs, sigma, n = numbers[at : at + 4]
        first = at + 4
        then = first + int(values)
        at = then + int(covs)
        out.append((kind, use, numbers[first:then], numbers[then:at], sigma, n))
    return out


def fold(f: Fusion, drone: int, frames: pd.DataFrame) -> pd.DataFrame:
    """Estimates of ``frames`` (t, frame_id, kinds, numbers), which are in order."""
    out = []
    for t, frame_id, kinds, numbers in zip(frames["t"].tolist(), frames["frame_id"].tolist(), frames["kinds"], frames["numbers"]):
        began, used = f.fused(t, measured(kinds, numbers.tolist()))
        said = ",".join([f"{kind}:1" if took else f"{kind}:0" for kind, took in used])
        out.append((drone, frame_id, t, *f.place, *f.speed[:2], math.degrees(f.yaw) % 360, f.spread, f.confidence, began, f.lost, said))
    return pd.DataFrame(out, columns=COLUMNS)


def _plain(frames: DataFrame, *more: str) -> DataFrame:
    """``frames`` with flat measurements: their kinds as a JSON list, and for each the lengths of its value and of its
    covariance, its sigma, its inliers, and both lists."""
    known, none = F.filter(F.coalesce("measurements", F.array()), lambda m: m.isNotNull()), F.array().cast("array<double>")
    listed = lambda m, name: F.coalesce(m[name].cast("array<double>"), none)
    head = lambda m: F.array(*[x.cast("double") for x in (F.size(listed(m, "value")), F.size(listed(m, "cov")), *[F.coalesce(m[k], F.lit(0)) for k in ("sigma", "n")])])
    numbers = F.flatten(F.transform(known, lambda m: F.concat(head(m), listed(m, "value"), listed(m, "cov"))))
    return frames.select("drone", "frame_id", "t", *more, F.to_json(F.transform(known, lambda m: F.coalesce(m["kind"], F.lit("")))).alias("kinds"), numbers.alias("numbers"))


def flown(frames: DataFrame) -> DataFrame:
    """``frames`` with each drone's in one task and in order, so that a task needs to hold no more than a batch of them."""
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(parts, "drone").sortWithinPartitions("drone", "t", "frame_id")


def by_drone(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Rows of one drone at a time, and whether they are its first."""
    last = None
    for b in batches:
        for drone, rows in b.groupby("drone", sort=False):
            yield drone != last, rows
            last = drone


def fuse_flights(frames: DataFrame) -> DataFrame:
    """Batch form: ``frames`` has drone, frame_id, t and measurements (an array of ``MEASUREMENT``). A flight is the unit of
    work; it passes through a task in batches, and only the filter stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Fusion()
        for new, rows in by_drone(batches):
            f = Fusion() if new else f
            yield fold(f, int(rows["drone"].iloc[0]), rows)

    return flown(_plain(frames)).mapInPandas(run, ESTIMATE)


#: Timers are set at multiples of this: a batch's first and last one. Each takes all frames that the watermark has passed.
TIMER_MS = 2000

#: Columns of frames that wait, and frames that are taken from them at once.
WAITING = pa.schema([("ms", pa.int64()), ("t", pa.float64()), ("frame_id", pa.int64()), ("kinds", pa.string()), ("numbers", pa.list_(pa.float64()))])
BATCH = 10_000


def packed(frames: pa.Table) -> tuple[int, bytes]:
    """A row of list state: the first time among ``frames``, and all of them as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(frames)
    return pc.min(frames["ms"]).as_py(), sink.getvalue().to_pybytes()


#: A drone's frames of one Arrow batch: the latest timestamp, the first and last time, and all of them.
PACK = "drone long, ts timestamp, first long, last long, frames binary"


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames as ``PACK``: the state's side, where a drone's work is in one task, then has few rows to read."""
    for b in batches:
        if b.column("ms").null_count:
            raise ValueError("a frame of a stream needs a timestamp")
        rows, at, out = pa.Table.from_batches([b]).sort_by("drone"), 0, []
        runs = pc.run_end_encode(rows["drone"].combine_chunks())
        for drone, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            own, at = rows.slice(at, end - at), end
            first, body = packed(own.select(WAITING.names).cast(WAITING))
            out.append((drone, pc.max(own["ts"]), first, pc.max(own["ms"]).as_py(), body))
        if out:
            drones, ts, first, last, bodies = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(drones, pa.int64()), pa.array([x.as_py() for x in ts], b.schema.field("ts").type), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(bodies, pa.binary())], names=["drone", "ts", "first", "last", "frames"])


class FusionProcessor(StatefulProcessor):
    """A drone's filter, the frames that wait for the watermark, and the watermark up to which none waits. Frames before that
    came too late and are left out."""

    def init(self, handle) -> None:
        self.handle = handle
        self.filter = handle.getValueState("filter", STATE)
        self.passed = handle.getValueState("passed", "ms long")
        self.waiting = handle.getListState("waiting", "first long, frames binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for part in rows:
            if len(part):
                self.waiting.appendList(list(zip(part["first"].tolist(), map(bytes, part["frames"]))))
                for at in {int(ms) // TIMER_MS for ms in (part["first"].min(), part["last"].max())}:
                    self.handle.registerTimer((at + 1) * TIMER_MS)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        later, due = [tuple(x) for x in held if x[0] >= passed], []
        for frames in (pa.ipc.open_stream(bytes(x[1])).read_all() for x in held if x[0] < passed):
            early = pc.less(frames["ms"], passed)
            due.append(frames.filter(early))
            if len(due[-1]) < len(frames):
                later.append(packed(frames.filter(pc.invert(early))))
        if not due:
            return
        self.waiting.put(later) if later else self.waiting.clear()
        f = Fusion.of(self.filter.get()) if self.filter.exists() else Fusion()
        due = pa.concat_tables(due)
        if self.passed.exists():
            due = due.filter(pc.greater_equal(due["ms"], self.passed.get()[0]))
        due = due.sort_by([("t", "ascending"), ("frame_id", "ascending")])
        for k in range(0, len(due), BATCH):
            yield fold(f, int(key[0]), due.slice(k, BATCH).to_pandas())
        self.filter.update(f.kept())
        self.passed.update((passed,))

    def close(self) -> None:
        pass


#: Keyed state with timers needs this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fuse_stream(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Streaming form: ``frames`` also carries the timestamp ``ts``; frames may come up to ``delay`` late. Estimates of a
    frame leave once the watermark has passed it."""
    frames.sparkSession.conf.set(*STORE)
    rows = _plain(frames, "ts", (F.unix_micros("ts") / 1000).cast("long").alias("ms")).mapInArrow(packs, PACK)
    return rows.withWatermark("ts", delay).groupBy("drone").transformWithStateInPandas(FusionProcessor(), ESTIMATE, "Append", "EventTime")

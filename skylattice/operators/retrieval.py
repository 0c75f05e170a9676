"""Vector retrieval with consensus, pair mining, and pose lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators.graph import dealt

#: Rows that one block of a table holds when a stated query set is compared with all of it.
BLOCK = 20_000
#: Queries that meet a block at a time, which bounds a task's memory.
STRIP = 128


def block_count(rows: DataFrame, least: int = 8) -> int:
    """How many blocks a table is compared in: as many as it needs, so that tasks keep their size as it grows."""
    return max(least, -(-rows.count() // BLOCK))


def in_blocks(queries: DataFrame, rows: DataFrame, find: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``find`` gives for each part of ``queries`` against each block of ``rows``; both have the same columns, an ``id`` among them, and parts of up to
    about ``BLOCK`` rows, so a task's memory has a bound. All pairs are met; only what ``find`` keeps leaves a task. A vector
    with a null component counts as null."""
    parts, blocks = block_count(queries, 1), block_count(rows)
    part = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    queries, rows = (df.withColumn("embedding", F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))) if "embedding" in df.columns else df for df in (queries, rows))
    q, d = every(part(queries, parts, "part"), blocks, "block"), every(part(rows, blocks, "block"), parts, "part")
    both = q.withColumn("asked", F.lit(True)).unionByName(d.withColumn("asked", F.lit(False))).repartition(parts * blocks, "part", "block")
    names = [c.split()[0] for c in schema.split(", ")]

    def met(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g[g["asked"] == side].reset_index(drop=True) for side in (True, False))
        return pd.concat([*find(a, b)], ignore_index=True) if len(a) and len(b) else pd.DataFrame(columns=names)

    return both.groupBy("part", "block").applyInPandas(met, schema)


def stacked(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, in double precision, and their length (-1: null)."""
    out, size = np.zeros((len(vectors), width)), np.full(len(vectors), -1)
    for k, v in enumerate(vectors):
        if v is not None:
            out[k, : len(v)], size[k] = v, len(v)
    return out, size


def similarities(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For strips of ``a``: dot products with all of ``b`` (``embedding``), summed in the order of components like ``dot``,
    and whether there is one: both vectors whole and of one length."""
    width = max((len(v) for x in (a, b) for v in x["embedding"] if v is not None), default=0)
    (p, size), (q, other) = stacked(a["embedding"], width), stacked(b["embedding"], width)
    q = np.ascontiguousarray(q.T)
    for at in range(0, len(a), STRIP):
        strip = slice(at, min(at + STRIP, len(a)))
        sim = np.zeros((strip.stop - at, len(b)))
        with np.errstate(all="ignore"):
            for lo in range(0, len(b), 1024):  # pieces that stay in a core's cache
                here, more = sim[:, lo : lo + 1024], np.empty((len(sim), min(1024, len(b) - lo)))
                for k in range(width):
                    np.multiply(p[strip, k, None], q[k, lo : lo + 1024], out=more)
                    here += more
        yield strip, sim, (size[strip, None] == other) & (size[strip, None] >= 0)


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def circular_mean(heading: Column, weight: Column) -> Column:
    """Weighted mean of headings in degrees (an aggregate)."""
    turn = F.atan2(F.sum(weight * F.sin(F.radians(heading))), F.sum(weight * F.cos(F.radians(heading))))
    return F.pmod(F.degrees(turn), F.lit(360.0))


def top_k(queries: DataFrame, landmarks: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar landmarks of each query, itself excluded: (query, id, sim, rank).

    A stated query set is compared with all landmarks block by block: queries go to every block, each block keeps its
    own ``k`` best, and only these meet for the final rank. Pairs without a similarity (null) come last.
    """

    def find(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b = b.sort_values("id", ignore_index=True)
        ids, own = b["id"].to_numpy(), a["id"].to_numpy()
        for strip, sim, known in similarities(a, b):
            place = np.where(known, np.where(np.isnan(sim), np.inf, sim), -np.inf)  # NaN is the largest in SQL
            same = own[strip, None] == ids
            least = np.full(len(place), -np.inf)
            if len(ids) > k:
                least = np.partition(np.where(same, -np.inf, place), len(ids) - k, axis=1)[:, len(ids) - k]
            r, c = np.nonzero((place >= least[:, None]) & ~same)
            order = np.lexsort((c, -place[r, c], r))  # columns go by id
            r, c = r[order], c[order]
            first = np.searchsorted(r, np.arange(len(place)))
            keep = np.arange(len(r)) - first[r] < k
            r, c = r[keep], c[keep]
            yield pd.DataFrame({"query": own[strip][r], "id": ids[c], "sim": sim[r, c], "known": known[r, c]})

    near = in_blocks(queries.select("id", "embedding"), landmarks.select("id", "embedding"), find, "query long, id long, sim double, known boolean")
    near = near.select("query", "id", F.when(F.col("known"), F.coalesce("sim", F.lit(float("nan")))).alias("sim"))  # pandas takes NaN for null
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def hardest(queries: DataFrame, poses: DataFrame, radius: float, turn: float) -> DataFrame:
    """Of each query the farthest embedding among the poses within ``radius`` and ``turn`` degrees of it and the closest one
    among the others, itself excluded: (query, far, close), null where there is none. No pair leaves the task that meets it."""

    def find(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, own = b["id"].to_numpy(), a["id"].to_numpy()
        q, d = ({k: x[k].to_numpy(dtype=float) for k in ("e", "n", "heading")} for x in (a, b))
        for strip, sim, known in similarities(a, b):
            de, dn, dh = (q[k][strip, None] - d[k] for k in ("e", "n", "heading"))
            near = (np.sqrt(de * de + dn * dn) < radius) & (np.abs((dh + 180.0) % 360.0 - 180.0) < turn)
            known = known & (own[strip, None] != ids)
            apart = np.sqrt(np.maximum(2 - 2 * sim, 0.0))
            far, close = np.where(near & known, apart, -np.inf).max(axis=1), np.where(~near & known, apart, np.inf).min(axis=1)
            yield pd.DataFrame({"query": own[strip], "far": far, "close": close})

    out = in_blocks(queries, poses, find, "query long, far double, close double").groupBy("query").agg(F.max("far").alias("far"), F.min("close").alias("close"))
    finite = lambda k: F.when(F.abs(F.col(k)) < float("inf"), F.col(k)).alias(k)
    return out.select("query", finite("far"), finite("close"))


def nearest_poses(queries: DataFrame, poses: DataFrame, weight: float = 3.0) -> DataFrame:
    """Cheapest other pose of each query by squared distance and squared ``weight`` * turn; ties by id: (query, id, cost)."""

    def find(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b = b.sort_values("id", ignore_index=True)
        ids, own = b["id"].to_numpy(), a["id"].to_numpy()
        q, d = ({k: x[k].to_numpy(dtype=float) for k in ("e", "n", "heading")} for x in (a, b))
        for at in range(0, len(a), STRIP):
            strip = slice(at, at + STRIP)
            de, dn, dh = (d[k] - q[k][strip, None] for k in ("e", "n", "heading"))
            turned = weight * np.abs((dh + 180.0) % 360.0 - 180.0)
            cost = np.where(own[strip, None] == ids, np.inf, de * de + dn * dn + turned * turned)
            best = cost.argmin(axis=1)  # the first one, which has the smallest id
            least = cost[np.arange(len(cost)), best]
            some = np.isfinite(least)
            yield pd.DataFrame({"query": own[strip][some], "id": ids[best][some], "cost": least[some]})

    near = in_blocks(queries.select("id", "e", "n", "heading"), poses.select("id", "e", "n", "heading"), find, "query long, id long, cost double")
    return near.groupBy("query").agg(F.min(F.struct("cost", "id")).alias("x")).select("query", "x.id", "x.cost")


def consensus(neighbours: DataFrame, landmarks: DataFrame, cut: float = 0.08, heat: float = 0.02) -> DataFrame:
    """Weighted mean position, covariance, heading and spread of each query's neighbours close to its best one."""
    best = F.max("sim").over(Window.partitionBy("query"))
    near = neighbours.withColumn("best", best).where(F.col("sim") > F.col("best") - cut)
    rows = near.join(landmarks.select("id", "e", "n", "u", "heading"), "id").withColumn("w", F.exp((F.col("sim") - F.col("best")) / heat))
    mean = lambda x: F.sum(F.col("w") * x) / F.sum("w")
    e, n, u = (F.col(k) for k in "enu")
    out = rows.groupBy("query").agg(
        F.max("sim").alias("similarity"), F.count("*").alias("k"), mean(e).alias("e"), mean(n).alias("n"), mean(u).alias("u"), circular_mean(F.col("heading"), F.col("w")).alias("heading"),
        mean(e * e).alias("ee"), mean(n * n).alias("nn"), mean(u * u).alias("uu"), mean(e * n).alias("en"), mean(e * u).alias("eu"), mean(n * u).alias("nu"),
    )
    var = lambda a, b: F.col(a + b) - F.col(a) * F.col(b)
    spread = F.sqrt(F.greatest(var("e", "e") + var("n", "n") + var("u", "u"), F.lit(0.0)))
    covariance = [(var(a, b) + (0.5 if a == b else 0.0)).alias(f"c_{a}{b}") for a, b in ("ee", "nn", "uu", "en", "eu", "nu")]
    return out.select("query", "similarity", "k", "e", "n", "u", "heading", spread.alias("spread"), *covariance)


def positive_pairs(poses: DataFrame, radius: float, turn: float) -> DataFrame:
    """Pairs (i < j) of poses within ``radius`` and ``turn`` degrees, by an equi-join of neighbouring cells."""
    at = poses.select("id", "e", "n", "heading", *[x.alias(k) for k, x in zip(("ce", "cn"), geo.plane_cell(F.col("e"), F.col("n"), radius))])
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    around = at.withColumn("s", F.explode(steps)).select(
        F.col("id").alias("j"), F.col("e").alias("je"), F.col("n").alias("jn"), F.col("heading").alias("jh"), (F.col("ce") + F.col("s.a")).alias("ce"), (F.col("cn") + F.col("s.b")).alias("cn")
    )
    near = at.join(around, ["ce", "cn"]).where("id < j")
    apart, turned = geo.distance(F.col("e"), F.col("n"), F.col("je"), F.col("jn")), F.abs(geo.wrap_deg(F.col("heading") - F.col("jh")))
    return near.where((apart < radius) & (turned < turn)).select(F.col("id").alias("i"), "j", apart.alias("apart"))


def neighbours(left: DataFrame, right: DataFrame, radius: float, lid: str = "id", rid: str = "id") -> DataFrame:
    """Pairs (lid, rid, d) strictly nearer than ``radius``, by an equi-join on 3 x 3 cells of that size. Both sides have
    e and n; other columns of the sides are not carried."""
    cell = lambda df: [x.alias(k) for k, x in zip(("ce", "cn"), geo.plane_cell(F.col("e"), F.col("n"), radius))]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    x = left.select(F.col(lid).alias("lid"), F.col("e").alias("le"), F.col("n").alias("ln"), *cell(left)).withColumn("s", F.explode(steps))
    x = x.select("lid", "le", "ln", (F.col("ce") + F.col("s.a")).alias("ce"), (F.col("cn") + F.col("s.b")).alias("cn"))
    y = right.select(F.col(rid).alias("rid"), "e", "n", *cell(right))
    d = geo.distance(F.col("le"), F.col("ln"), F.col("e"), F.col("n"))
    return x.join(dealt(y), ["ce", "cn"]).withColumn("d", d).where(F.col("d") < radius).select("lid", "rid", "d")

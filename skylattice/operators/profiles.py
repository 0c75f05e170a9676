"""The most similar other profile of each profile: exact maximum inner products of unit vectors, with pruning.

Profiles lie in the part of the unit sphere without negative values. They are cut into blocks by their coordinates in steps
of 1 / GRID; how many blocks there can be depends on GRID and the number of coordinates alone, so centres and radii of all
of them are a bounded table. Each profile is first compared within its block, which gives a bound from below; another block
can only hold a better one if the angle to its centre, less its radius, is smaller than that of the bound. Only such pairs
of profile and block are compared, as matrix products of packs of at most PACK rows, so no pair of rows is ever shuffled.
Up to FEW profiles are one product in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.graph import written

GRID, PACK, FEW = 3, 2048, 4096
BEST = "id long, s double"


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def _packed(rows: DataFrame, keys: list[str], width: int, size: int = PACK) -> DataFrame:
    """``rows`` (``keys``, id, v) in packs of about ``size`` rows: ``keys``, ids and vs as bytes. Rows are dealt by a hash of
    their id to as many packs as their key needs."""
    many = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("packs"))
    dealt = rows.join(many, keys).withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")))
    names = [*keys, "pack", "ids", "vs"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, vs = np.asarray(table["id"], dtype=np.int64), _vectors(table["v"].combine_chunks(), width)
        return pa.table([pa.array([table[k][0].as_py()], pa.int64()) for k in [*keys, "pack"]] + [pa.array([ids.tobytes()], pa.binary()), pa.array([vs.tobytes()], pa.binary())], names=names)

    return dealt.select(*keys, F.col("pack").cast("long").alias("pack"), "id", "v").groupBy(*keys, "pack").applyInArrow(pack, ", ".join(f"{k} long" for k in [*keys, "pack"]) + ", ids binary, vs binary")


def best_of(ids: np.ndarray, vs: np.ndarray, other_ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The largest product of each row with another one; -1 where there is none."""
    s = vs @ others.T
    s[ids[:, None] == other_ids[None, :]] = -1.0
    return s.max(1, initial=-1.0)


def _compared(packs: DataFrame, others: DataFrame, on: str, width: int) -> DataFrame:
    """The best product of each row of ``packs`` with the rows of ``others`` of the same ``on``."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a_ids, a_vs, b_ids, b_vs in zip(*(b.column(k) for k in ("ids", "vs", "other_ids", "other_vs"))):
                ids, other = np.frombuffer(a_ids.as_py(), dtype=np.int64), np.frombuffer(b_ids.as_py(), dtype=np.int64)
                s = best_of(ids, np.frombuffer(a_vs.as_py()).reshape(-1, width), other, np.frombuffer(b_vs.as_py()).reshape(-1, width))
                yield pa.RecordBatch.from_pydict({"id": ids, "s": s})

    both = packs.select(on, "ids", "vs").join(others.select(on, F.col("ids").alias("other_ids"), F.col("vs").alias("other_vs")), on)
    return both.drop(on).mapInArrow(products, BEST).groupBy("id").agg(F.max("s").alias("s"))


def nearest_profiles(units: DataFrame, width: int, few: int = FEW) -> DataFrame:
    """``id``, ``s`` (the largest product with another row, -1 if there is none), and how many blocks the row was compared
    with and could have been (``blocks_seen``, ``blocks``; 1 of 1 where all are one product). ``units``: id, v."""
    units = written(units.select("id", "v"))
    if units.count() <= few:

        def whole(table: pa.Table) -> pa.Table:
            ids, vs = np.asarray(table["id"], dtype=np.int64), _vectors(table["v"].combine_chunks(), width)
            return pa.table({"id": ids, "s": best_of(ids, vs, ids, vs)})

        found = units.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: whole(t.combine_chunks()), BEST)  # ``few`` rows
        return found.select("id", "s", F.lit(1).cast("long").alias("blocks_seen"), F.lit(1).cast("long").alias("blocks"))
    code = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a * (GRID + 1) + F.floor(x * GRID))
    placed = units.select("id", "v", code.alias("block"))
    middle = F.transform("v", lambda x: F.floor(x * GRID) + 0.5)
    length = F.sqrt(F.aggregate("middle", F.lit(0.0), lambda a, x: a + x * x))
    cosine = F.aggregate(F.zip_with("v", "middle", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / length
    shape = placed.withColumn("middle", middle).withColumn("angle", F.acos(F.least(F.lit(1.0), cosine)))
    shape = shape.groupBy("block").agg(F.max("angle").alias("radius"), F.first("middle").alias("middle"), F.count("*").alias("n")).orderBy("block").collect()  # as many as the grid has
    codes, sizes = np.array([r["block"] for r in shape]), np.array([r["n"] for r in shape])
    middles, radii = np.array([r["middle"] for r in shape]), np.array([r["radius"] for r in shape])
    held = units.sparkSession.sparkContext.broadcast((codes, middles / np.linalg.norm(middles, axis=1)[:, None], radii + 1e-9, sizes))
    packs = written(_packed(placed, ["block"], width))
    own = written(placed.join(_compared(packs, packs, "block", width), "id"))

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, middles, radii, _ = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                v, block, s = _vectors(b.column("v"), width), np.asarray(b.column("block")), np.asarray(b.column("s"))
                near = np.arccos(np.clip(v @ middles.T, -1, 1)) - radii
                best = np.arccos(np.clip(s, -1, 1)) + 1e-9
                row, k = np.nonzero((near <= best[:, None]) & (codes[None, :] != block[:, None]))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(codes[k])], names=["id", "v", "block"])

    asked = written(own.select("id", "v", "block", "s").mapInArrow(open_blocks, "id long, v array<double>, block long"))
    seen = asked.groupBy("id").agg(F.count("*").alias("more"))
    better = _compared(_packed(asked, ["block"], width), packs, "block", width).withColumnRenamed("s", "other")
    out = own.select("id", "s").join(better, "id", "left").join(seen, "id", "left")
    return out.select("id", F.greatest("s", F.coalesce("other", F.lit(-1.0))).alias("s"), (F.coalesce("more", F.lit(0)) + 1).alias("blocks_seen"), F.lit(len(codes)).cast("long").alias("blocks"))

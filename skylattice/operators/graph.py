"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (with partial sums) and a join on the same key. A node with many edges would gather them
all in one task of that join, so the few such nodes are joined by a broadcast of their minima (``with_groups``). Every
round is a table in the shared folder. The number of rounds grows with the logarithm of the longest path. Nothing but a
row count and a checksum reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.session import delete, new_path

#: A key with more than this share of all rows is not dealt by its hash; there are fewer such keys than SHARE.
SHARE = 256


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage between rounds."""
    path = path or new_path(df.sparkSession, "edges")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt by hash and sorted. The planner takes an exploded table to be as small as
    what it came from, and would broadcast it."""
    return df.hint("merge")


def with_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each value of ``key`` and says in ``k`` how many of the
    ``total`` rows hold it. Values with many rows, fewer than SHARE of them, are broadcast; the others are dealt by hash."""
    many, own = F.col("k") > max(total // SHARE, 100), [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(groups.where(many)), key, "left")
    none = reduce(lambda x, y: x & y, [F.col(c).isNull() for c in own])  # names all columns, so both uses share one shuffle
    rest = marked.where(none).drop(*own).join(groups.where(~many), key)
    return marked.where(F.col("k").isNotNull()).unionByName(rest).drop("k")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge to another are not listed;
    edges with a null end are ignored; repeated edges and loops do no harm. ``rounds`` is far beyond what any graph
    that fits a cluster needs; a graph that is not done by then is an error."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    pairs = written(pairs.where("u <> v").distinct(), path)
    state = lambda: tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state()
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("k"))
        large = with_groups(both, least, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = with_groups(large, least, "u", before[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        last, path = path, new_path(spark, "edges")
        pairs = written(small, path)
        delete(spark, last)  # no later round reads it
        now = state()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def grid_components(mask: DataFrame, width: int, row: str = "row", col: str = "col") -> DataFrame:
    """Adds ``component`` (the smallest row * width + col reachable by steps to the four neighbours) to mask texels."""
    at = mask.withColumn("node", F.col(row) * width + F.col(col))
    steps = F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
    near = at.withColumn("s", F.explode(steps)).where((F.col("s.b") == 0) | (F.col(col) < width - 1))
    near = near.select(F.col("node").alias("x"), (F.col("node") + F.col("s.a") * width + F.col("s.b")).alias("y"))
    edges = near.join(at.select(F.col("node").alias("y")), "y")
    found = connected_components(edges, "x", "y")
    return at.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

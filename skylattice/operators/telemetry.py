"""Joins and windows over frame streams, source health folds, and roll-ups of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
COOLDOWN_S = 120.0
MAX_COOLDOWN_S = 900.0


def source_health(log: DataFrame, order: list[str]) -> DataFrame:
    """Successes, failures, smoothed success rate, moving latency, block streak and cool-down of each source.

    Counts are plain sums. The moving latency weighs a success by 0.3 * 0.7^(successes after it), and the streak counts
    blocks after the last success: both follow from ranks within the source, which Spark sorts and spills, so no list of
    a source's events is gathered.
    """
    w = Window.partitionBy("source").orderBy(*[F.desc(k) for k in order])
    later = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("later", F.coalesce(later, F.lit(0)))
    total = F.count_if("ok").over(Window.partitionBy("source"))
    rows = rows.withColumn("n_ok", total)
    share = F.when(F.col("later") == F.col("n_ok") - 1, F.pow(F.lit(0.7), F.col("later"))).otherwise(0.3 * F.pow(F.lit(0.7), F.col("later")))
    streak = F.count_if((F.col("later") == 0) & F.col("blocked") & ~F.col("ok"))
    out = rows.groupBy("source").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_fail"), F.sum(F.when(F.col("ok"), share * F.col("latency"))).alias("ewma"), streak.alias("streak")
    )
    rate = (F.col("n_ok") + 1.0) / (F.col("n_ok") + F.col("n_fail") + 2.0)
    cool = F.when(F.col("streak") > 0, F.least(F.lit(MAX_COOLDOWN_S), COOLDOWN_S * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(10))))).otherwise(0.0)
    return out.withColumn("rate", rate).withColumn("cooldown_s", cool)


def source_order(health: DataFrame, in_flight: Column) -> DataFrame:
    """Rank of each source that is not cooling down: fewest requests in flight, best rate, lowest latency."""
    rows = health.where("cooldown_s = 0").withColumn("in_flight", in_flight)
    w = Window.orderBy("in_flight", F.desc("rate"), F.coalesce(F.nullif("ewma", F.lit(0.0)), F.lit(5.0)), "source")  # a row per source
    return rows.withColumn("rank", F.row_number().over(w))


def newest(rows: DataFrame, key: str, order: list[str], keep: int, above: int | None = None) -> DataFrame:
    """The newest ``keep`` rows of each key (a per-key limit, which Spark applies before it shuffles); with ``above``, only
    of keys with more rows than that."""
    w = Window.partitionBy(key).orderBy(*[F.desc(k) for k in order])
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    if above is None:
        return ranked(rows)
    counts = rows.groupBy(key).agg(F.count("*").alias("__rows"))  # a row per key
    counted = rows.join(F.broadcast(counts), key)
    small = counted.where(F.col("__rows") <= above).withColumn("rank", F.lit(None).cast("int"))
    return ranked(counted.where(F.col("__rows") > above)).unionByName(small).drop("__rows")

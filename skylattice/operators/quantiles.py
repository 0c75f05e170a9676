"""Exact quantiles of groups of any size and any distribution, without a group's values in one task.

Values are first summed to distinct ones with counts, as a table of its own. If no group has more than WHOLE of them, that is
a bounded buffer of the built-in aggregate. Otherwise a counting pass over ranges of equal width tells the range that holds
each wanted place, and only such ranges are looked at again. Where values crowd in one of them, splitters, an even choice
from a sample of its distinct values by hash, cut it into parts of about equally many distinct values; a second counting
pass tells the part, and its values are put in order. The sample depends on the values alone, so a task that runs again
cuts the same parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.graph import written

#: Ranges of equal width; distinct values up to which a group, or a range, is put in order as it is.
RANGES, WHOLE = 4096, 50_000
#: Parts of a crowded range, in two levels of STEP, and distinct values of it that splitters are chosen from.
STEP = 24
PARTS, SAMPLE = STEP * STEP, 64 * STEP * STEP


def _splitters(sample: Column) -> Column:
    """PARTS - 1 values at even places of a sorted sample (fewer where the sample is smaller)."""
    steps = F.sequence(F.lit(1), F.lit(PARTS - 1))
    pick = lambda held: F.when(F.size(held) > 0, F.array_distinct(F.transform(steps, lambda k: held[(k * F.size(held) / PARTS).cast("int")]))).otherwise(held)
    return F.transform(F.array(sample), pick)[0]  # the sample is sorted once, not for every step


def _range_of(value: Column, splitters: Column, heads: Column) -> Column:
    """How many splitters are at or below ``value``; ``heads`` are every STEP-th of them."""
    below = lambda part: F.size(F.filter(part, lambda s: s <= value))
    block = below(heads)
    return block * STEP + below(F.slice(splitters, block * STEP + 1, STEP))


def parts(near: DataFrame, keys: list[str]) -> DataFrame:
    """``near`` (``keys``, __v, __k times, and __kinds, the distinct values of its group) with the ``__part`` of each value."""
    drawn = near.where((F.col("__kinds") > WHOLE) & (F.pmod(F.xxhash64("__v"), F.ceil(F.col("__kinds") / SAMPLE)) == 0))
    cuts = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__sample"))  # about SAMPLE values of a group
    cuts = cuts.select(*keys, _splitters(F.col("__sample")).alias("__cuts"))
    cuts = cuts.withColumn("__heads", F.filter(F.col("__cuts"), lambda _, k: (k + 1) % STEP == 0))
    part = F.when(F.col("__cuts").isNotNull(), _range_of(F.col("__v"), F.col("__cuts"), F.col("__heads"))).otherwise(0)
    return near.join(cuts, keys, "left").withColumn("__part", part).drop("__cuts", "__heads")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str | Column, wanted: dict[str, float]) -> DataFrame:
    """``keys`` and, for each name of ``wanted``, that quantile of ``value``, interpolated like ``percentile``.

    Groups may hold any number of rows: counts are partial sums. Null values are ignored; a group without any has no row.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = rows.select(*keys, value.cast("double").alias("__v")).where("__v is not null").groupBy(*keys, "__v").agg(F.count("*").alias("__k"))
    rows = written(rows)  # read several times, narrow
    kinds = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if kinds <= WHOLE:
        few = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.percentile("__v", q, F.col("__k")).alias(name) for name, q in wanted.items()])
        return few.where("__n > 0").drop("__n")
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__k").alias("__n"))
    on = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # noqa: E731  a row where there are no keys
    place = F.when(F.col("__high") > F.col("__low"), F.least(F.lit(RANGES - 1), F.floor((F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low")) * RANGES))).otherwise(0)
    ranged = on(rows, span).withColumn("__range", place).drop("__low", "__high", "__n")
    sums = ranged.groupBy(*keys, "__range").agg(F.sum("__k").alias("__rows"), F.count("*").alias("__kinds"))  # RANGES rows a group
    sums = sums.withColumn("__before", F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__rows"))
    ask = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in wanted.items()]))
    asked = span.select(*keys, "__n", ask.alias("__ask")).select(*keys, F.col("__ask.name").alias("__name"), (F.col("__ask.q") * (F.col("__n") - 1)).alias("__at"))
    ends = asked.withColumn("__end", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))))
    held = lambda first, n: (F.col("__end") >= F.col(first)) & (F.col("__end") < F.col(first) + F.col(n))
    inside = on(sums, ends).where(held("__before", "__rows")).select(*keys, "__range", "__before", "__kinds", "__name", "__at", "__end")
    inside = written(inside)  # at most two rows for each wanted quantile of a group
    cell = [*keys, "__range"]
    near = written(ranged.join(inside.select(*cell, "__before", "__kinds").distinct(), cell))
    if (near.agg(F.max("__kinds")).first()[0] or 0) > WHOLE:
        near = written(parts(near, cell))
    else:
        near = near.withColumn("__part", F.lit(0))
    sums = near.groupBy(*cell, "__part", "__before").agg(F.sum("__k").alias("__rows"))
    sums = sums.withColumn("__first", F.col("__before") + F.sum("__rows").over(Window.partitionBy(*cell).orderBy("__part")) - F.col("__rows"))
    asked = sums.join(inside.select(*cell, "__name", "__at", "__end"), cell).where(held("__first", "__rows")).select(*cell, "__part", "__first", "__name", "__at", "__end")
    part = [*cell, "__part"]
    near = near.join(asked.select(*part, "__first").distinct(), part)
    upto = F.sum("__k").over(Window.partitionBy(*part).orderBy("__v")) + F.col("__first")
    near = near.select(*part, "__v", "__k", upto.alias("__upto"))
    hit = near.join(asked, part).where((F.col("__end") < F.col("__upto")) & (F.col("__end") >= F.col("__upto") - F.col("__k")))
    found = hit.groupBy(*keys, "__name").agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"), (F.first("__at") - F.floor(F.first("__at"))).alias("__part"))
    found = found.withColumn("__quantile", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part"))
    if not keys:
        return found.agg(F.count("*").alias("__k"), *[F.max(F.when(F.col("__name") == name, F.col("__quantile"))).alias(name) for name in wanted]).where("__k > 0").drop("__k")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__quantile"))).alias(name) for name in wanted])


def with_quantiles(summary: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """``summary`` (a row per group of ``keys``) with quantiles of several columns of ``rows``; null where a group has no value."""
    for value, names in wanted.items():
        found = exact_quantiles(rows, keys, value, names)
        if keys:
            found = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *names)
            same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            summary = summary.join(found, same, "left").drop(*[f"__{k}" for k in keys])
        else:
            summary = summary.join(F.broadcast(found), F.lit(True), "left")  # a row each
    return summary

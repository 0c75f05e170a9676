"""Box scans of a theme read few of its row groups, and lose nothing."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from skylattice.sources import themes


def grid(spark, n=120):
    rows = spark.range(n * n).select("id", (F.col("id") % n / float(n)).alias("x"), (F.floor(F.col("id") / n) / float(n)).alias("y"))
    box = F.struct(F.col("x").alias("xmin"), (F.col("x") + 1e-3).alias("xmax"), F.col("y").alias("ymin"), (F.col("y") + 1e-3).alias("ymax"))
    return rows.select("id", box.alias("bbox"), F.sha2(F.col("id").cast("string"), 512).alias("body")).orderBy(F.xxhash64("id"))


def test_row_groups_are_pruned_in_both_directions(spark, tmp_path):
    df, path, box = grid(spark), f"{tmp_path}/theme", (0.30, 0.55, 0.42, 0.63)
    themes.write_theme(df, path, 64 << 10)
    found = themes.scan(spark, path, box)
    got = sorted(r.id for r in found.select("id").collect())
    assert got == sorted(r.id for r in df.where("bbox.xmax >= 0.30 and bbox.xmin <= 0.42 and bbox.ymax >= 0.55 and bbox.ymin <= 0.63").select("id").collect()) and got
    groups = hit = 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k).statistics for k in range(meta.num_columns)}
            groups += 1
            hit += stats["bbox.xmax"].max >= box[0] and stats["bbox.xmin"].min <= box[2] and stats["bbox.ymax"].max >= box[1] and stats["bbox.ymin"].min <= box[3]
    assert groups >= 16 and hit <= groups / 3  # either direction alone would let a third and more through
    plan = found.select("id")._jdf.queryExecution().executedPlan()
    assert all(f"bbox.{k}" in plan.toString().split("PushedFilters")[1].split("]")[0] for k in ("xmin", "xmax", "ymin", "ymax"))
    rows = found.select("id")
    rows.collect()
    leaf = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().get("numOutputRows").get().value() < df.count() / 3  # rows that the scan gave to the filter


def test_z_order(spark):
    got = spark.createDataFrame([(0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5), (1.0, 1.0)], "x double, y double").select(themes.z_order(F.col("x"), F.col("y")).alias("z")).collect()
    assert [r.z for r in got] == [0, 1 << 30, 1 << 31, 3 << 30, (1 << 32) - 1]


def test_empty_theme(spark, tmp_path):
    themes.write_theme(grid(spark, 3).where("false"), f"{tmp_path}/none")
    assert themes.scan(spark, f"{tmp_path}/none", (0, 0, 1, 1)).count() == 0

"""Shared folders and written intermediate tables.

Intermediate results are Parquet tables in the folder that ``spark.checkpoint.dir`` names, which every executor can
read, so a lost executor costs a re-read and no recomputation of the plan above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.session import new_path, shared_dir

__all__ = ["delete", "hadoop_path", "mixed", "new_path", "shared_dir", "small_batches", "written"]


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table written in the shared folder: cuts the lineage and fixes rows that a later step reads twice."""
    path = new_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path``, on the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lowers the session's rows per Arrow batch to ``rows`` where it is higher: a batch of long texts is held several
    times over, by the executor and by its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def mixed(x):
    """Finalizer of splitmix64 over a numpy uint64 array: spreads structured integers over 64 bits."""
    import numpy as np

    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""What every query needs of a session: code on the executors, and a shared folder for tables written on the way."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers import this library: a zip of it goes to every executor, once a session. Workers of a local
    master run where the driver does and take the library from its own place."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if _local(spark):
        env = spark.sparkContext.environment
        known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        if _ROOT not in known:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="skylattice-code-")), "skylattice.zip")  # read by Spark on the driver only
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "skylattice")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _ROOT))
        pipeline = os.path.join(_ROOT, "corpus_pipeline.py")
        if os.path.exists(pipeline):
            z.write(pipeline, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder of the session's ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a folder of its
    own; on a cluster it is an error, since executors do not see each other's folders."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="skylattice-")
    return _OWN[app]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/skylattice/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

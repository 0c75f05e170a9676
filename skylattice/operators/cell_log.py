"""Cache of fetched cells as a log of events: put, skip and clear, merged on read and compacted.

A cell's content is that of its latest put; it is skipped if its latest skip or clear is a skip. The two are independent: a
skip keeps the content, a put keeps the mark. Events are appended as batches, each a folder that becomes visible by one
rename; a compaction writes the merged state as a base folder in the same way, and readers take the newest base and the
batches after it. An interrupted writer leaves a hidden folder that nobody reads. One writer at a time; a second one that
took the same version loses its rename and fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "kind string, cell long, op string, body string, version long, seq long"
PUT, SKIP, CLEAR = "put", "skip", "clear"


class CellLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def folders(self) -> list[tuple[int, bool, str]]:
        """(version, whether it is a base, name) of all visible folders, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at)]
        return sorted((int(n[1:]), n[0] == "b", n) for n in names if n[0] in "be" and n[1:].isdigit())

    def live(self) -> list[tuple[int, bool, str]]:
        """The newest base, if any, and the batches after it."""
        found = self.folders()
        last = max((v for v, base, _ in found if base), default=-1)
        return [f for f in found if (f[0] == last and f[1]) or f[0] > last]

    def _commit(self, events: DataFrame, name: str) -> None:
        hidden = f".{uuid.uuid4().hex}"
        events.write.parquet(f"{self.path}/{hidden}")
        if not self._fs.exists(self._hadoop(name)) and self._fs.rename(self._hadoop(hidden), self._hadoop(name)):
            return
        self._fs.delete(self._hadoop(hidden), True)
        raise FileExistsError(f"{self.path}/{name} was written by another")

    def append(self, events: DataFrame) -> int:
        """Adds ``events`` (kind, cell, op, body, seq: their order) and returns the batch's version."""
        version = max((v for v, _, _ in self.folders()), default=0) + 1
        self._commit(events.select("kind", "cell", "op", "body", F.lit(version).cast("long").alias("version"), F.col("seq").cast("long").alias("seq")), f"e{version:012d}")
        return version

    def events(self) -> DataFrame:
        live = [f"{self.path}/{name}" for _, _, name in self.live()]
        return self.spark.read.schema(EVENT).parquet(*live) if live else self.spark.createDataFrame([], EVENT)

    def state(self) -> DataFrame:
        """One row per cell that has content or a mark: kind, cell, body, skipped, reason. Equal orders within a batch go by
        operation (put, skip, then clear) and body."""
        order = F.struct("version", "seq", F.when(F.col("op") == CLEAR, 2).when(F.col("op") == SKIP, 1).otherwise(0).alias("rank"), "body")
        last = lambda *ops: F.max(F.when(F.col("op").isin(*ops), F.struct(order.alias("order"), "op", "body")))
        held = self.events().groupBy("kind", "cell").agg(last(PUT).alias("put"), last(SKIP, CLEAR).alias("mark"))
        skipped = F.coalesce(F.col("mark.op") == SKIP, F.lit(False))
        rows = held.select("kind", "cell", F.col("put").isNotNull().alias("cached"), F.col("put.body").alias("body"), skipped.alias("skipped"), F.when(skipped, F.col("mark.body")).alias("reason"))
        return rows.where("cached or skipped")

    def compact(self) -> None:
        """Writes the merged state as a base and removes what it replaces."""
        live = self.live()
        if not live or (len(live) == 1 and live[0][1]):
            return
        event = lambda op, body: F.struct(F.lit(op).alias("op"), F.col(body).alias("body"))
        both = F.filter(F.array(F.when(F.col("cached"), event(PUT, "body")), F.when(F.col("skipped"), event(SKIP, "reason"))), lambda x: x.isNotNull())
        version = live[-1][0]
        rows = self.state().select("kind", "cell", F.explode(both).alias("x"))
        self._commit(rows.select("kind", "cell", "x.op", "x.body", F.lit(version).cast("long").alias("version"), F.lit(0).cast("long").alias("seq")), f"b{version:012d}")
        for v, base, name in self.folders():
            if v < version or (v == version and not base):
                self._fs.delete(self._hadoop(name), True)

"""A table of immutable Parquet shards with size-tiered compaction and versioned manifests.

An append writes its rows as small shards and commits a manifest that lists them beside those of the version before.
Compaction sorts the shards by size into tiers, each ``fan_in`` times the size of the one below; a tier with at least
``fan_in`` shards is merged into files of about ``target`` bytes. All merges of a round are one Spark job in which each
task reads the shards of one new file, so nothing is shuffled and a key's frequency does not matter.

A commit writes the manifest under a temporary name and renames it to the next version's, which fails if another writer
took that version; the loser reads the new version and tries again, and gives up only if a shard that it merged is
gone. Readers use the highest version and never see a part of a commit. Shards that no kept version lists are removed by
``vacuum``. Tasks that run again write to names of their own, of which Spark's committer keeps one.

Manifests hold a line per shard, never of a row. Rows are kept as they are, whatever they hold: nulls, repeated rows,
empty texts; an append without rows commits a version without new shards.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from skylattice.llm.storage import hadoop_path


@dataclass(frozen=True)
class Tiers:
    target: int = 128 << 20  # bytes of a merged file; larger ones are left alone
    smallest: int = 1 << 20  # shards up to this size are one tier
    fan_in: int = 4
    merges: int = 64  # new files of one round

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.smallest, self.fan_in)))


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    added: int  # version


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, tiers: Tiers = Tiers()):
        self.spark, self.path, self.schema, self.tiers = spark, path, schema, tiers

    def _list(self, folder: str) -> list:
        fs, p = hadoop_path(self.spark, folder)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list(f"{self.path}/manifests")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        """Shards of a version, the latest by default; none before the first commit."""
        known = self.versions()
        if not known:
            return []
        version = known[-1] if version is None else version
        fs, p = hadoop_path(self.spark, f"{self.path}/manifests/v{version:012d}.json")
        source = fs.open(p)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, added: list[tuple[str, int]], removed: frozenset[str] = frozenset()) -> int:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        while True:
            known = self.versions()
            version = (known[-1] if known else 0) + 1
            held = self.shards()
            if not removed <= {s.path for s in held}:
                raise RuntimeError("a merged shard was replaced by another writer")
            kept = [s for s in held if s.path not in removed] + [Shard(p, n, version) for p, n in added]
            body = json.dumps({"version": version, "shards": [vars(s) for s in kept]}).encode()
            fs, mine = hadoop_path(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
            out = fs.create(mine, True)
            out.write(bytearray(body))
            out.close()
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                context.rename(mine, hadoop_path(self.spark, f"{self.path}/manifests/v{version:012d}.json")[1], options)
                return version
            except Exception as e:
                fs.delete(mine, False)
                if "FileAlreadyExistsException" not in str(e):
                    raise

    def _write(self, df: DataFrame) -> list[tuple[str, int]]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return sorted((s.getPath().toString(), s.getLen()) for s in self._list(folder) if s.getPath().getName().endswith(".parquet"))

    def append(self, rows: DataFrame) -> int:
        """Commits the rows as small shards; the new version."""
        return self._commit(self._write(rows.select(*[f"`{c}`" for c in self.schema.names])))

    def plan(self) -> list[list[Shard]]:
        """Shards to merge, by new file: within a tier that is full, in order of size, up to the target size."""
        by_tier: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.bytes < self.tiers.target * 3 // 4:
                by_tier.setdefault(self.tiers.tier(s.bytes), []).append(s)
        groups = []
        for _, found in sorted(by_tier.items()):
            if len(found) < self.tiers.fan_in:
                continue
            group, size = [], 0
            for s in sorted(found, key=lambda s: (s.bytes, s.path)):
                if group and size + s.bytes > self.tiers.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            groups.append(group)
        return [g for g in groups if len(g) > 1][: self.tiers.merges]

    def compact(self) -> int:
        """Merges tier by tier until no tier is full; the number of rounds."""
        rounds = 0
        while groups := self.plan():
            parts = [self._read([s.path for s in g]).coalesce(1) for g in groups]
            self._commit(self._write(reduce(DataFrame.union, parts)), frozenset(s.path for g in groups for s in g))
            rounds += 1
        return rounds

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the latest by default."""
        return self._read([s.path for s in self.shards(version)])

    def vacuum(self, keep: int = 1) -> int:
        """Removes the manifests before the latest ``keep`` and the shards that only they list; the shards removed."""
        known = self.versions()
        kept = {s.path for v in known[-keep:] for s in self.shards(v)}
        gone = {s.path for v in known[:-keep] for s in self.shards(v)} - kept
        for v in known[:-keep]:
            fs, p = hadoop_path(self.spark, f"{self.path}/manifests/v{v:012d}.json")
            fs.delete(p, False)
        for path in gone:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, False)
        return len(gone)

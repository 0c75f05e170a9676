import pytest
from pyspark.sql import functions as F

from skylattice.llm import storage
from skylattice.llm.compaction import ShardStore, Tiers


def content(df):
    return sorted(map(repr, df.collect()))


def test_appends_and_compaction_keep_every_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)).withColumn("version", F.lit("x"))
    store = ShardStore(spark, storage.new_path(spark, "shards"), docs.schema, Tiers(target=60_000, smallest=4_000, fan_in=3))
    assert store.versions() == [] and store.read().count() == 0
    wave = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    for k in range(5):
        store.append(docs.where(wave == k).repartition(6))
        before = len(store.shards())
        store.compact()
        assert len(store.shards()) <= before
        assert content(store.read()) == content(docs.where(wave <= k))
    tiers = {}
    for s in store.shards():
        tiers.setdefault(store.tiers.tier(s.bytes), []).append(s)
    assert all(len(v) < 3 for t, v in tiers.items() if max(s.bytes for s in v) < 45_000)
    old = store.versions()[0]
    assert content(store.read(old)) == content(docs.where(wave == 0))
    assert store.vacuum() > 0 and len(store.versions()) == 1
    assert content(store.read()) == content(docs)
    version = store.append(docs.where("false"))
    assert store.versions()[-1] == version and content(store.read()) == content(docs)


def test_two_writers(spark):
    df = spark.range(10).toDF("id")
    path = storage.new_path(spark, "shards")
    a, b = (ShardStore(spark, path, df.schema, Tiers(fan_in=2)) for _ in range(2))
    a.append(df.repartition(2))
    files = frozenset(s.path for s in a.shards())
    stale, seen = b.versions, []

    def once():  # b looks before a commits
        if not seen:
            seen.append(stale())
            a.append(df)
            return seen[0]
        return stale()

    b.versions = once
    assert b.append(df) == 3 and b.read().count() == 30
    b.versions = stale
    a.compact()
    with pytest.raises(RuntimeError):
        b._commit([], files)

import os
import subprocess
import sys

import numpy as np

from skylattice.llm import embedding_dedup
from skylattice.llm.embedding_dedup import Search
from skylattice.llm.hnsw import Graph
from tests.llm.sql import compare, tables


def test_embeddings_equal_sql(spark, sf_dir):
    compare(embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), embedding_dedup.SQL, tables(sf_dir))


def made():
    r = np.random.default_rng(4)
    rows = []
    for label in (1, 2, None):
        for _ in range(150):
            rows.append((r.normal(size=24), label))
        for size in (120, 15, 3):
            c = r.normal(size=24)
            rows += [(c + r.normal(size=24) * 0.12, label) for _ in range(size)]
        chain, step = r.normal(size=24), r.normal(size=24)
        rows += [(chain + step * 0.17 * k, label) for k in range(12)]
        rows += [(rows[-1][0], label), (rows[-1][0] * 3, label)]
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    bad = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0] * 10, [1.0] * 10]
    rows += [(b, 1) for b in bad]
    order = r.permutation(len(rows))
    return [(int(i), rows[k][0], rows[k][1], "clash") for i, k in enumerate(order)]


def test_odd_vectors_equal_all_pairs(spark, tmp_path):
    df = spark.createDataFrame(made(), "vec_id long, embedding array<float>, label int, component_id string")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(embedding_dedup.near_duplicates(df, Search(shard=150, part=300, beam=4, audit=30)), embedding_dedup.SQL, tables(tmp_path))
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
    twice = df.where("vec_id < 40 and label = 1").union(df.where("vec_id < 40 and label = 1"))
    assert all(r.n_links >= 1 for r in embedding_dedup.near_duplicates(twice).where("component_id is not null").collect() if r.vec_id in {m[0] for m in made() if m[1] and all(x is not None and np.isfinite(x) for x in m[1]) and any(m[1])})


def test_a_large_group_stays_in_memory():
    """10,000 near copies of one label query their shard within 1 GB, and all their links are found."""
    program = '''
import numpy as np
from skylattice.llm.embedding_dedup import Search, Shard, scaled, unit
from skylattice.llm.hnsw import Graph
r = np.random.default_rng(3)
x = scaled(r.normal(size=64) + r.normal(size=(10_000, 64)) * 0.02)
shard = Shard(np.arange(10_000), np.ones(10_000, dtype=np.int64), x, Graph.build(unit(x)), Search())
links = np.concatenate([shard.ask(np.arange(a, a + 1000), np.ones(1000), x[a : a + 1000])[1] for a in range(0, 10_000, 1000)])
assert (links == 9_999).all() and len(set(shard.group)) == 1 and len(shard.rest()[0]) == 9_999
print(next(line.split()[1] for line in open("/proc/self/status") if line.startswith("VmHWM")))
'''
    used = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert int(used.stdout) < 1_000_000, used.stdout


def test_a_cosine_of_the_threshold_links(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.6, 0.8], 1), (3, [0.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df, Search(threshold=0.6)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 2, 1), (3, 1, 1)]


def test_graph_recall():
    r = np.random.default_rng(1)
    x = embedding_dedup.unit(r.normal(size=(3000, 32)))
    g = Graph.build(x)
    ids, _ = g.query(x[:200], 64, np.full(200, -1))
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist())]) > 0.9

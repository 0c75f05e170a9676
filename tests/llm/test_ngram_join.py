import random

from pyspark.sql import functions as F

from skylattice.llm import ngram_join, queries
from skylattice.llm.components import connected_components
from skylattice.llm.ngram_join import Join
from tests.llm.sql import compare, tables


def brute(rows, n=5, t=0.8):
    """(links, class, words) of each row, by comparing all pairs of n-gram sets."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= t * len(a | b)] for i, a in enumerate(sets)]
    out, seen = {}, {}
    for i in range(len(rows)):
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        out[i] = (rows[i][0], len(near[i]), min(ids) if ids else None)
        seen[frozenset(group)] = bool(sets[i])
    return list(out.values()), seen


def made(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, ids = [], iter(range(10_000))
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 40, 120, 300]))]
        for _ in range(r.choice([1, 1, 2, 6, 40])):
            text = list(base)
            for _ in range(r.randrange(0, 4)):
                text[r.randrange(len(text))] = r.choice(vocab)
            rows.append((next(ids), " ".join(text)))
    big = [r.choice(vocab) for _ in range(200)]
    for _ in range(90):
        text = list(big)
        text[r.randrange(200)] = r.choice(vocab)
        rows.append((next(ids), " ".join(text)))
    rows += [(rows[5][0], rows[5][1]), (rows[6][0], "another text with the same id as one above"), (None, rows[9][1]), (None, "only null ids here"), (None, None), (7001, ""), (7002, "  \n")]
    rows += [(7003, "One  two"), (7004, "one two"), (7005, "x " * 30_000), (7006, "x " * 29_000)]
    r.shuffle(rows)
    return rows


def test_join_equals_all_pairs(spark):
    rows = made()
    names = ["n_links", "key", "row", "kept_key", "n", "k", "component"]
    df = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = ngram_join.near_copies(df, Join(block=16, grams=60)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    want, groups = brute(rows)
    assert sorted(map(key, [(r.id, r.n_links, r.class_id) for r in got])) == sorted(map(key, want))
    kept = ngram_join.one_of_each(df, Join(block=16)).collect()
    assert len(kept) == len(groups) and all(list(r.asDict()) == df.columns and list(r)[2:] == names for r in kept)
    assert ngram_join.near_copies(df.where("false")).count() == 0 and ngram_join.one_of_each(df.where("false")).count() == 0


def test_join_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_links, r.class_id) for r in got) == sorted(brute(rows)[0])


def test_only_candidates_are_dealt(spark):
    """Of texts of 12 MB that hardly compress, two in a hundred are near copies; neither they nor the others are shuffled
    as a whole, however small the broadcasts."""
    r = random.Random(8)
    rows = [(k, " ".join(f"{r.getrandbits(64):x}" for _ in range(1200))) for k in range(600)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(12)] + [rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sc, before = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def dealt():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    df = ngram_join.written(df, "test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = dealt()
        kept = [x.doc_id for x in ngram_join.one_of_each(df).collect()]
        assert sorted(kept) == list(range(600)) and dealt() - at < 3_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bitmap_loses_no_key(spark):
    rows = spark.range(-1500, 1500).select("id", F.xxhash64("id").alias("key")).unionByName(spark.createDataFrame([(9000 + k, v) for k, v in enumerate([0, -1, 2**63 - 1, -(2**63), 32767, 1 << 54])], "id long, key long"))
    keys = rows.where("id % 3 = 0").select("key")
    found = {x.id: x.possible for x in ngram_join._possible(rows, keys).collect()}
    assert len(found) == rows.count() and all(found[k] for k in found if k % 3 == 0)
    assert sum(found[k] for k in found if k % 3) < 20
    assert not any(x.possible for x in ngram_join._possible(rows, keys.where("false")).collect())


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4100)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    compare(queries.op8_ngram_jaccard_join(spark, sf_dir), ngram_join.SQL, tables(sf_dir))

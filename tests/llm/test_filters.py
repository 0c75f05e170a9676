import random
from itertools import permutations

from skylattice.llm import filter_audit
from tests.llm.sql import compare, tables


def test_tables_equal_sql(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    compare(filter_audit.audit(read("documents"), read("labels")), filter_audit.SQL, tables(sf_dir))


def test_odd_rows_equal_sql(spark, tmp_path):
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "BETA", "Gamma", "d#", "é", "ÀB"]) + str(r.randrange(3000))
    text = lambda: " ".join(word() for _ in range(r.choice([3, 99, 100, 150])))
    shared = [text() for _ in range(6)]
    made = [(k, r.choice(shared) if k % 3 else text(), r.choice(["en", "de", None, ""]), "clash", k) for k in range(200)]
    made += [(5, made[5][1], "en", "x", 1), (5, made[5][1], "fr", "x", 1), (None, shared[0], "en", "x", 1), (None, shared[0], None, "x", 1), (-4, None, "en", "x", 1), (900, "", "en", "x", 1)]
    made += [(901, "x\x0by\x1cz\x85q \t\r\n" + "a b " * 40_000, "en", "x", 1), (902, " ", "only", "x", 1), (903, "AB" * 200, None, "x", 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, mask string, n int")
    marks = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7777, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    compare(filter_audit.audit(docs, labels), filter_audit.SQL, tables(tmp_path))
    compare(filter_audit.audit(docs, labels.where("false")).groupBy().sum("good_lost"), "SELECT CAST(0 AS BIGINT) AS \"sum(good_lost)\"", tables(tmp_path))
    assert filter_audit.audit(docs.where("false"), labels).count() == 0


def test_potential_differences_are_means_over_all_orders(spark):
    """The potentials of a random game give what averaging over all orders gives."""
    r = random.Random(1)
    removed = [0] + [r.randrange(10**6) for _ in range(31)]
    got = spark.createDataFrame([(removed,)], "v array<long>").select(filter_audit.potentials(filter_audit.F.col("v"))).first()[0]
    for k in range(5):
        total = 0
        for p in permutations(range(5)):
            before = sum(1 << x for x in p[: p.index(k)])
            total += removed[before | 1 << k] - removed[before]
        assert abs((got[31] - got[31 ^ 1 << k]) * 2 - total) <= 4  # a game that no documents make need not divide evenly

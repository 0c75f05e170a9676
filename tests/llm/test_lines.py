import random

from skylattice.llm import line_rules
from tests.llm.sql import compare, tables


def brute_repeats(words):
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})


def test_repeated_words():
    r = random.Random(1)
    for _ in range(300):
        words = [r.choice("abcdef") for _ in range(r.randrange(0, 60))]
        assert line_rules.repeated_words(words) == brute_repeats(words)


def test_documents_equal_sql(spark, sf_dir):
    compare(line_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")), line_rules.SQL, tables(sf_dir))


def test_odd_rows_equal_sql(spark, tmp_path):
    r = random.Random(2)
    words = [f"v{i}" for i in range(300)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    common, other = line(30), line(60)
    made = [(i, common + f" {i % 10}\n" + line(r.choice([20, 60, 200])), r.choice(["a", "b", None]), 1) for i in range(120)]
    copy = other + "\n" + line(100)
    made += [(1000 + i, copy, "a", 1) for i in range(40)] + [(5, made[5][1], "b", 1), (None, other, "a", 1), (7, None, "a", 1), (8, "", None, 1)]
    made += [(9, "x\x0by\x1cz\x85q \t\r\n  \n\n" + "é ñ# |" * 80, "c", 1), (10, "w " * 50_000, "c", 1), (11, "<>&%\n<>&%\n\n\n", "c", 1)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, n_words int")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    compare(line_rules.judge(df), line_rules.SQL, tables(tmp_path))
    assert line_rules.judge(df.where("false")).count() == 0
    kept = {x.doc_id: x.kept for x in line_rules.judge(df).collect() if x.doc_id and x.doc_id >= 1000}
    assert all(kept.values())

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from skylattice.llm import gram_table, target_resampling
from skylattice.llm.gram_table import Grams, blocks, tables
from skylattice.llm.target_resampling import Resampling
from tests.llm.sql import compare, tables as views

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_of(text, longest):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def texts():
    r = random.Random(3)
    words = ["Alpha", "b", "İx", "日本語", "x9", "long" * 4, "é" * 20, "q" * 500, "a", "the", "THE"] + [f"w{k}" for k in range(200)]
    return [None, "", "...", "one", "end", "Anfang"] + ["".join(r.choice(words) + r.choice([" ", ". ", "\n", "--", "\x80 "]) for _ in range(r.randrange(90))) for _ in range(60)]


def test_spans_hashes_and_slots():
    made = pa.array(["skip", *texts()])[1:]
    for longest in (1, 3):
        for n, data, bounds in blocks(made):
            grams = Grams(data, bounds, longest)
            want = sorted((k, g) for k, t in enumerate(made.to_pylist()) for g in grams_of(t, longest))
            got = [(int(grams.owner[k]), bytes(grams.text(k)).decode()) for k in range(len(grams.at))]
            assert sorted(got) == want and n == len(made)
            assert grams.hashes(slice(0, len(got))).tolist() == [xxhash.xxh64_intdigest(g.encode()) for _, g in got]
            for take, table in tables(grams, 97):
                mine = [g for _, g in got[take]]
                assert [int(table.bucket[s]) for s in table.slot] == [zlib.crc32(g.encode()) % 97 for g in mine]
                assert len(set(table.slot.tolist())) == len(set(mine)) and [int(table.count[s]) for s in table.slot] == [mine.count(g) for g in mine]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(Grams, "hashes", lambda self, take: np.full(len(self.at[take]), 13, dtype=np.uint64))
    made = pa.array(["abcdefgh1 abcdefgh2 abcdefgh1 x abcdefgh"])
    for _, data, bounds in blocks(made):
        for _, table in tables(Grams(data, bounds, 1), 10):
            a, b, c, d, e = table.slot.tolist()
            assert a == c and len({a, b, d, e}) == 4


def test_small_blocks_change_nothing(monkeypatch):
    made, counts = pa.array(texts()), []
    for block, occurrences in ((1 << 20, 1 << 16), (100, 7)):
        monkeypatch.setattr(gram_table, "BLOCK", block)
        monkeypatch.setattr(gram_table, "OCCURRENCES", occurrences)
        each = [table for _, data, bounds in blocks(made) for _, table in tables(Grams(data, bounds, 2), 50)]
        counts.append((len(each) > 9, sum(np.bincount(t.bucket, weights=t.count, minlength=50) for t in each).tolist()))
    assert counts[0][1] == counts[1][1] and counts[1][0] and not counts[0][0]


def test_bucket_counts_of_all_texts(spark, sf_dir):
    docs, aims = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = target_resampling.bucket_counts(docs, "text", Resampling())
    assert want.sum() == sum(len(grams_of(r.text, 1)) for r in docs.collect())
    rows = target_resampling.resample(docs, aims, Resampling(longest=2))
    assert rows.count() == docs.count()


def test_tables_equal_sql(spark, sf_dir):
    compare(target_resampling.resample(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))), target_resampling.SQL, views(sf_dir))


def test_odd_rows_equal_sql(spark, tmp_path):
    r = random.Random(2)
    made = [(k, t, "clash", k) for k, t in enumerate(texts())] + [(3, "again " * 30, "x", 1)] * 5 + [(None, "no id " * 20, "x", 1), (None, "no id " * 30, "x", 1)]
    made += [(500, "Word " * 200_000, "x", 1)] + [(600 + k, " ".join(r.choice("abcdefgh") for _ in range(40)), "x", 1) for k in range(100)]
    docs = spark.createDataFrame(made, "doc_id long, text string, score string, weight int")
    aims = spark.createDataFrame([("1", "a b c D again"), ("2", None)], "item_id string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    aims.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    compare(target_resampling.resample(docs, aims), target_resampling.SQL, views(tmp_path))
    assert target_resampling.resample(docs.where("false"), aims).count() == 0
    assert target_resampling.resample(docs, aims.where("false")).where("rank is not null").count() > 0
    assert target_resampling.resample(docs.where("doc_id < 3"), aims).where("rank is not null").count() == 0

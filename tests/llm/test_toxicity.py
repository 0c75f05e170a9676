import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import queries, toxicity

WORDS = "idiot moron scum trash stupid house river garden table window letter summer people water under other after before never always little".split()


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    texts = [" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(200)]
    n = toxicity.trigram_counts(texts)
    return toxicity.log_probabilities(n.reshape(toxicity.SIZE, toxicity.SIZE, toxicity.SIZE).astype(float))


def test_counts():
    n = toxicity.trigram_counts(["Ab  b!a"]).reshape((toxicity.SIZE,) * 3)
    a, b = 1, 2
    assert {k: int(v) for k, v in np.ndenumerate(n) if v} == {(0, a, b): 1, (a, b, 0): 1, (b, 0, b): 1, (0, b, 0): 1, (b, 0, a): 1, (0, a, 0): 1}


@pytest.mark.parametrize("text,want", [("1d10t", "idiot"), ("m0r0n", "moron"), ("s.c.u.m", "scum"), ("tr@sh", "trash"), ("$tupid", "stupid"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("garden", "garden")])
def test_restores(model, text, want):
    assert want in toxicity.decode(text, model)


def test_decode_finds_the_best_path(model):
    """Against all paths of the lattice; the last span has over twelve states at a time."""
    for span in ("m0r", "1d1", "a.b", "tt0", "5u", "1|4e1|05|"):
        best = {}
        for path in itertools.product(*toxicity.lattice(span)):
            p, a, b, text = 0.0, 0, 0, ""
            for c, q in path:
                p += q
                if c < 0 or c == 0 and b == 0:
                    continue
                p += model[a, b, c]
                a, b, text = b, c, text + toxicity.LETTERS[c]
            p += model[a, b, 0] if b else 0
            best[text.strip()] = max(best.get(text.strip(), -1e9), p)
        assert toxicity.decode(span, model, 1)[0] == max(best, key=best.get)


def test_long_spans_are_one_lattice(model):
    """What all paths begin with is put aside on the way: the same as without, at any length."""
    for span in ["id1ot" * 40, "4" * 150 + "b", "st.u.p1d" * 30, "x" * 300]:
        whole = toxicity.decode(span, model)
        step, toxicity.STEP = toxicity.STEP, 10**9
        try:
            assert toxicity.decode(span, model) == whole
        finally:
            toxicity.STEP = step
    assert len(toxicity.decode("w0rd1e" * 20_000, model)[0]) > 60_000


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.85
    assert n.get((0, 1), 0) / n[(0, 0)] < 0.01


def test_odd_rows(spark):
    texts = ["the river and the garden", "you idiot you moron", "you 1d10t m0r0n", "", None, "i d i o t s c u m", "house " * 100_000, "￿\U0001f600 ﷐", "x" * 50_000]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(1, "you idiot you moron", "clash"), (None, "you idiot", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    more = [(100 + i, ("you idiot moron scum " if i % 2 else "") + " ".join(random.Random(i).choices(WORDS[5:], k=20)), "c") for i in range(120)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(120)] + [(None, 1), (0, None), (7, 5)], "doc_id long, toxic int")
    s = toxicity.fit(docs, labels)
    got = docs.select("doc_id", "text", toxicity.scored(F.col("text"), s, spark).alias("score")).collect()
    assert len(got) == len(rows) + 120 and all(0 <= r.score <= 1 for r in got)
    by = {r.text: r.score for r in got}
    assert by[texts[1]] > 0.5 and by[texts[2]] > 0.5 and by[texts[5]] > 0.5 and by[texts[0]] < 0.5 and by[""] < 0.5 and by[None] < 0.5
    none = toxicity.fit(docs, labels.where("false"))
    assert all(r.x < 0.5 for r in docs.select(toxicity.scored(F.col("text"), none, spark).alias("x")).collect())


def test_planted_disguises(spark):
    """Stand-ins at a word's end, and spaced words with stand-ins, punctuation or few distinct letters."""
    bad, clean = ["idiot", "ass", "poop", "shit"], WORDS[5:]
    text = lambda k, more: " ".join(random.Random(k).choices(clean, k=20)) + more
    rows = [(k, text(k, f" {bad[k // 2 % 4]}" if k % 2 else "")) for k in range(400)]
    planted = "idio7 a$$ a55 sh!+".split() + ["i d i 0 t", "i d i o t.", "(i d i o t)", "a s s", "p o o p", "p 0 0 p!", "i\td\ti\to\tt"]
    plain = ["house$$$", "river!", "(garden)", "1 2 3 4", "", "letter2", "u n d e r"]
    rows += [(1000 + i, text(i, f" {x}")) for i, x in enumerate(planted)] + [(2000 + i, text(i, f" {x}")) for i, x in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in docs.select("doc_id", toxicity.scored(F.col("text"), s, spark).alias("score")).collect()}
    assert [x for i, x in enumerate(planted) if got[1000 + i] <= 0.5] == []
    assert [x for i, x in enumerate(plain) if got[2000 + i] > 0.5] == []

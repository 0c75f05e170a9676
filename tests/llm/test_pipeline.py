import random

import corpus_pipeline
from skylattice.llm import language_id, toxicity
from tests.llm.test_ngram_join import brute


def _near(text, profiles, far):
    """The first stage's verdict, text by text."""
    (lang,), (score,), (distance,) = language_id.predict([text], profiles)
    return lang != "und" and score >= corpus_pipeline.LEAST_LEAD and distance <= far.get(lang, 0.0)


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34", None, None, None), (9004, docs.first()["text"], "en", "s", 1), (None, "some words the and of that", "en", "s", 1)]
    r = random.Random(6)
    junk = [" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(60)) for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст")]
    odd += [(9005 + k, text, None, "s", 1) for k, text in enumerate(junk)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_copies", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert kept.schema.names == docs.schema.names
        assert kept.exceptAll(before).count() == 0
        if name == "language_id":
            assert {9001, 9002, 9003, 9005, 9006}.isdisjoint(r.doc_id for r in kept.collect())
            profiles = language_id.fit(before, "doc_id", "text", "lang")
            far = language_id.reach(before, profiles, "doc_id", "text", "lang")
            want = [r.doc_id for r in before.collect() if _near(r.text, profiles, far)]
            assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect()) and before.count() - kept.count() <= 7
        if name == "toxicity":
            scorer = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            score = lambda t: scorer.probability(scorer.evidence(scorer.restorer(), t))
            want = [r.doc_id for r in before.collect() if score(r.text) < 0.5]
            assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())
        if name == "near_copies":
            _, groups = brute([(r.doc_id, r.text) for r in before.collect()])
            assert kept.count() == len(groups)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables_and_clashing_names(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", "'a' as found", "'b' as row", "'c' as kept_key", "'d' as n", "'e' as __found")
    spark.read.parquet(f"{sf_dir}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    for labels, frame in ((sf_dir, docs), (str(tmp_path), docs), (sf_dir, docs.where("false"))):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, labels)
            assert kept.columns == docs.columns
        assert all(tuple(r)[-5:] == tuple("abcde") for r in kept.collect())
        assert (corpus_pipeline.STAGES[-1][1](spark, kept, labels).count() > 0) == (frame is docs)

import numpy as np
from pyspark.sql import functions as F

from skylattice.llm import language_id, queries
from skylattice.llm.language_id import Profiles, predict


def brute_counts(text):
    """1- to 3-grams of letters, counted plainly; words are bounded by a space."""
    counts = {}
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(kept.split()) + (" " if kept.split() else "")
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if n == 1 and g == " " or n == 3 and g[1] == " " or n == 2 and g == "  ":
                continue
            counts[g] = counts.get(g, 0) + 1
    return counts


def code(gram):
    v = [0 if c == " " else ord(c) for c in gram]
    first, middle, last = {1: (0, 0, v[0]), 2: (v[0] or language_id.MARK, 0, v[-1]), 3: (v[0], v[1 % len(v)], v[-1])}[len(v)]
    return first << 42 | middle << 21 | last


def brute_ranks(text, size):
    counts = {code(g): n for g, n in brute_counts(text).items()}
    return sorted(counts, key=lambda k: (-counts[k], k))[:size]


TEXTS = ["The tea is hot, isn't it? é É ñ", "a", "", "  ..", "x1y2 z\n\nhello", "日本語 日本", "".join(chr(0x4E00 + k) for k in range(3000)), "가나다 😀 𐐀"]


def test_counts_equal_brute_force():
    owner, codes, counts = language_id._counted(TEXTS)
    for i, text in enumerate(TEXTS):
        got = {int(k): int(n) for k, n in zip(codes[owner == i], counts[owner == i])}
        assert got == {code(g): n for g, n in brute_counts(text).items()}, text


def brute_predict(text, profiles):
    ranks = brute_ranks(text, profiles.size)
    if not ranks:
        return "und", 0.0, 1.0
    far = []
    for grams in profiles.grams:
        at = {g: k for k, g in enumerate(grams)}
        far.append(sum(abs(at[g] - r) if g in at else profiles.size for r, g in enumerate(ranks)))
    order = sorted(range(len(far)), key=lambda k: (far[k], k))
    second = far[order[1]] if len(far) > 1 else profiles.size * len(ranks)
    return profiles.langs[order[0]], (second - far[order[0]]) / max(second, 1), far[order[0]] / (profiles.size * len(ranks))


def test_prediction_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language_id.fit(docs, "doc_id", "text", "lang", sample=10**9)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + TEXTS + [None]
    for text, *got in zip(texts, *predict(texts, profiles)):
        want = brute_predict(text or "", profiles)
        assert got[0] == want[0] and np.allclose(got[1:], want[1:])
    total = {}
    for r in docs.where("lang is not null and text is not null and doc_id is not null").collect():
        for g, n in brute_counts(r.text).items():
            total.setdefault(r.lang, {}).setdefault(code(g), [0])[0] += n
    for lang, grams in zip(profiles.langs, profiles.grams):
        assert list(grams) == sorted(total[lang], key=lambda g: (-total[lang][g][0], g))[: profiles.size]


def test_out_of_place_distance():
    p = Profiles(("x", "y"), (tuple(map(code, "ab")), tuple(map(code, "ba"))), 400)
    langs, scores, _ = predict(["aab", "bba", "", None, "12"], p)
    assert langs == ["x", "y", "und", "und", "und"] and scores[0] > 0 and scores[2] == 0
    assert predict(["ab"], Profiles((), (), 400))[0] == ["und"]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op5_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_odd_rows(spark):
    rows = [(1, "der die das und nicht", "de", "x"), (2, "the and of that is", "en", "x"), (2, "the and of that is", "en", "x"), (None, "the of", "en", "x"), (3, None, "de", "x"), (4, "", None, "x"), (5, "123 !!", "en", "x")]
    rows += [(6, "the " * 200_000, None, "x"), (7, "the퟿ 日本", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    p = language_id.fit(df, "doc_id", "text", "lang")
    got = df.select("doc_id", language_id.predicted(F.col("text"), p, spark).alias("x")).select("doc_id", "x.*").collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and by[1] == "de" and by[2] == by[6] == by[None] == "en" and by[3] == by[4] == by[5] == "und"
    empty = language_id.fit(df.where("false"), "doc_id", "text", "lang")
    assert empty.langs == () and np.all([r.lang_pred == "und" for r in df.select(language_id.predicted(F.col("text"), empty, spark).alias("x")).select("x.*").collect()])


def test_all_labelled_rows_are_learned_from(spark):
    """Row k has a letter of its own k times, so that a profile of 400 from a part of the rows is another one; and so is the
    bound of a language of which a few rows are far off."""
    rows = [(k, chr(0x4E00 + k) * k, "x") for k in range(1, 5001)] + [(6000, "z", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language_id.fit(df, "doc_id", "text", "lang")
    total = {}
    for _, text, lang in rows:
        for g, n in brute_counts(text).items():
            total[lang, code(g)] = total.get((lang, code(g)), 0) + n
    for lang, grams in zip(p.langs, p.grams):
        assert list(grams) == sorted((g for x, g in total if x == lang), key=lambda g: (-total[lang, g], g))[: p.size]
    held, language_id.HELD = language_id.HELD, 100  # counts that a task hands on early add up to the same
    try:
        parts = list(language_id._grams(iter(df.select("lang", "text").limit(300).repartition(1).toArrow().to_batches(50))))
        assert len(parts) > 3 and sum(sum(b.column(2).to_pylist()) for b in parts) == sum(n for _, t, _ in rows[:300] for n in brute_counts(t).values())
    finally:
        language_id.HELD = held
    found = df.select("lang", language_id.predicted(F.col("text"), p, spark).alias("found")).where("found.lang_pred = lang")
    want = {lang: min(1.0, 1.3 * float(np.quantile([r.found.distance for r in found.collect() if r.lang == lang], 0.999))) for lang in ("x", "y")}
    got = language_id.reach(df, p, "doc_id", "text", "lang")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)

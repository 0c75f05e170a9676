import numpy as np
import public_tokenizers
import sentencepiece

from skylattice.llm import merge_dropout
from skylattice.llm.merge_dropout import SPACE, Encoder, agenda, vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a  b   c ", "line\nfeed\ttab", "日本語 текст é 😀", "x" * 3000, "ab" * 700, "café café", "a\x00b\x01", "﷐ �"]


def texts(spark, sf_dir):
    return ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]


def test_without_dropout_equals_library(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    every, enc = texts(spark, sf_dir), Encoder(MODEL, 0.0, 0, 8)
    for text, got in zip(every, enc.encode(list(range(len(every))), every)):
        assert got.tolist() == model.encode(text), text[:60]


def test_matrix_equals_heap(spark, sf_dir):
    v, every = vocabulary(MODEL), texts(spark, sf_dir)
    words = sorted({w for t in every for w in (SPACE + t).replace(" ", SPACE + "\n").split("\n") if 0 < len(w) <= 24})[:1500]
    lengths = np.array([len(w) for w in words])
    table = np.full((len(words), 24), -1, dtype=np.int32)
    for k, w in enumerate(words):
        table[k, : len(w)] = [v.chars.get(c, -1) for c in w]
    for rate in (0.0, 0.1, 0.6, 1.0):
        keys = merge_dropout.mixed(np.arange(len(words), dtype=np.uint64))
        ids, alive = merge_dropout.together(table, lengths, keys, rate, v)
        for k, w in enumerate(words):
            want = agenda(table[k, : len(w)].tolist(), int(keys[k]), rate, v)
            assert list(zip(ids[k][alive[k]].tolist(), np.flatnonzero(alive[k]).tolist())) == want, (rate, w)
        if rate == 1.0:
            assert alive.sum() == lengths.sum()


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    made = [(1000 + i, t, "n_tokens") for i, t in enumerate(ODD)] + [(1, f"a{SPACE}b {SPACE}", "x"), (1, f"a{SPACE}b {SPACE}", "x"), (None, None, None), (None, "null id", "x")]
    df = docs.union(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    one, two, other = (merge_dropout.encode_documents(df, MODEL, 0.1, seed).collect() for seed in (0, 0, 1))
    assert all(r.lossless for r in one) and len(one) == df.count()
    key = lambda rows: sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids)) for r in rows)
    assert key(one) == key(two)
    differ = sum(a != b for a, b in zip(key(one), key(other)))
    assert differ > 0.9 * docs.count()
    plain = sum(r.n_tokens for r in merge_dropout.encode_documents(df, MODEL, 0.0).collect())
    assert 1.02 * plain < sum(r.n_tokens for r in one) < 1.6 * plain
    assert merge_dropout.encode_documents(df.where("false"), MODEL).count() == 0


def test_every_occurrence_has_its_own_dropout(spark, sf_dir):
    """Against one heap per occurrence, also after words were forgotten; a frequent word is segmented in many ways."""
    v, every = vocabulary(MODEL), [t for t in texts(spark, sf_dir)[:30] if t]
    enc, rate = Encoder(MODEL, 0.3, 5, 50), 0.3
    mix = lambda x: merge_dropout.mixed(np.array([x & (1 << 64) - 1], dtype=np.uint64))[0]
    for doc_id, text in enumerate(every):
        want = []
        for k, w in enumerate(merge_dropout._WORDS.findall(SPACE + text.replace(" ", SPACE))):
            pieces = agenda([v.chars.get(c, -1) for c in w], int(mix(int(mix(doc_id + 5)) + k)), rate, v)
            want += [p for x, i in pieces for p in ([x] if x >= 0 else v.byte_ids[list(w[i].encode())].tolist())]
        assert enc.encode([doc_id], [text])[0].tolist() == want
    ways = {tuple(x.tolist()) for x in Encoder(MODEL, 0.3, 0).encode(list(range(500)), ["understanding"] * 500)}
    assert len(ways) > 8


def test_outcomes_with_skips_are_not_merged_anew(monkeypatch):
    """Frequent words, most occurrences of which skip candidates: each segmentation is merged about once, and is the heap's."""
    v, rows, together = vocabulary(MODEL), [], merge_dropout.together
    monkeypatch.setattr(merge_dropout, "together", lambda words, *more: rows.append(len(words)) or together(words, *more))
    words = ["the", "understanding", "café一s", "of\nthem", "▁▁x", "nobody"]
    texts = [" ".join(words[(i + k) % len(words)] for k in range(200)) for i in range(60)]
    for limit in (300_000, 40):
        rows.clear()
        enc = Encoder(MODEL, 0.1, 3, limit)
        for at in range(0, 60, 20):
            got = enc.encode(list(range(at, at + 20)), texts[at : at + 20])
            for doc_id, text, found in zip(range(at, at + 20), texts[at : at + 20], got):
                assert enc.decode(found) == text
                if doc_id % 10 == 0:
                    want = []
                    for k, w in enumerate(merge_dropout._WORDS.findall(SPACE + text.replace(SPACE, merge_dropout.LITERAL).replace(" ", SPACE))):
                        key = merge_dropout._mixed_one(merge_dropout._mixed_one(doc_id + 3) + k)
                        for x, i in agenda([v.chars.get(c, -1) for c in w], key, 0.1, v):
                            want += [x] if x >= 0 else v.byte_ids[list((SPACE if w[i] == merge_dropout.LITERAL else w[i]).encode())].tolist()
                    assert found.tolist() == want, doc_id
        assert len(enc.patterns) <= limit and (limit == 40 or sum(rows) < 0.25 * 60 * 200)

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skylattice.llm import packing, queries, storage, token_files
from skylattice.llm.token_memo import TextEncoder

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ENCODERS = {path: TextEncoder(path, 50) for path in (BYTE, WORD)}
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a   b ", "a\n\nb", "a\n b", "a \n b", "\n\nx", "x\n\n", "tab\tand nbsp", "it's we'll\nDON'T",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>", "é ́x", "ctrl\x1cx \x1f y", "日本 語", "ΣΑΣ Σ", "x" * 5000, "😀 a😀b​", "a\r\nb", "1 23 4.5",
]
SCHEMA = "n_words int, doc_id long, text string, length string"


def rows(spark):
    made = [(7, i, t, "clash") for i, t in enumerate(ODD)] + [(7, None, "null id", None), (7, 3, "a", "again"), (7, 3, "a", "again"), (7, 99, None, None), (7, -(2**63), "least id", None)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_equals_library(spark, sf_dir, path):
    tok, enc = Tokenizer.from_file(path), TextEncoder(path, 5000)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for _ in range(2):  # the memo is filled, and emptied in part
        for text, got in zip(texts, enc.documents(pa.array(texts, pa.string()), 7)):
            assert got.tolist() == tok.encode(text, add_special_tokens=False).ids + [7], text[:50]
    assert [x.tolist() for x in enc.documents(pa.array([None, "", "a"], pa.string()).slice(1), 7)] == [[7], tok.encode("a", add_special_tokens=False).ids + [7]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Aé\n\n  .,%'’)(\t\u0301\u0130Σß1\x1c日"), max_size=12), max_size=6))
def test_encoder_of_any_text(texts):
    for path, enc in ENCODERS.items():
        want = [e.ids + [1] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.documents(pa.array(texts, pa.string()), 1)] == want


def brute(spark, sf_dir, path, df):
    tok = Tokenizer.from_file(path)
    return [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect()]


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_packing(spark, sf_dir, which):
    df = {"odd": rows(spark), "documents": spark.read.parquet(f"{sf_dir}/documents.parquet"), "empty": rows(spark).where("false")}[which]
    limits = packing.Limits(window=50)
    got = packing.pack_documents(df, BYTE, limits).collect()
    want = sorted((str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in brute(spark, sf_dir, BYTE, df))
    ids = {}
    for d, x in brute(spark, sf_dir, BYTE, df):
        ids.setdefault((d, len(x)), []).append(x)
    bins, cover = {}, {}
    for p in got:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
        cover[p.doc_id] = cover.get(p.doc_id, 0) + p.length
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in ids[(p.doc_id, p.doc_tokens)])
    total = {}
    for d, n, _ in want:
        total[d] = total.get(d, 0) + n
    assert {str(k): v for k, v in cover.items()} == total
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0 and len(parts) <= limits.segments


def test_pack_whole_examples(spark):
    made = [(str(i), 100 + i * 37 % 900, i * 13 % 90) for i in range(300)] + [("big", 5000, 10), ("none", 0, 0), ("null", None, None)]
    limits = packing.Limits(tokens=1000, segments=5, loss_tokens=150, window=400)
    got = packing.pack_examples(spark.createDataFrame(made, "id string, n int, loss int").coalesce(1), "id", "n", "loss", limits).collect()
    assert sorted(r.example_id for r in got) == sorted(m[0] for m in made if m[1])
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        if b[0].example_id != "big":
            assert sum(r.length for r in b) <= 1000 and len(b) <= 5 and sum(r.loss_tokens for r in b) <= 150
    assert len(bins) <= 1.25 * max(sum(m[1] or 0 for m in made[:300]) / 1000, 300 / 5, sum(m[2] or 0 for m in made[:300]) / 150) + 2


def test_conversations_under_three_limits(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = {}
    tok = Tokenizer.from_file(BYTE)
    for r in turns.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        at = want.setdefault(str(r.conv_id), [0, 0])
        at[0], at[1] = at[0] + n, at[1] + (n if r.role == "assistant" else 0)
    got = queries.queries()["op3_packing_conversations"](spark, sf_dir).collect()
    assert {r.example_id: [r.length, r.loss_tokens] for r in got} == want and len(got) == len(want)
    bins, limits = {}, queries.CONVERSATIONS
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    sums = [(sum(r.length for r in b), len(b), sum(r.loss_tokens for r in b)) for b in bins.values() if len(b) > 1]
    assert all(a <= limits.tokens and n <= limits.segments and loss <= limits.loss_tokens for a, n, loss in sums)
    counted = packing.count_turns(turns, BYTE).coalesce(1).cache()
    biggest = [max(v[k] for v in want.values()) for k in range(2)]
    wide = {"tokens": 10**9, "segments": 10**9, "loss_tokens": 10**9, "window": 400}
    for k, (name, limit) in enumerate((("tokens", 2 * biggest[0]), ("segments", 4), ("loss_tokens", 2 * biggest[1]))):  # each limit alone fills sequences
        rows = packing.pack_examples(counted, "example_id", "tokens", "loss_tokens", packing.Limits(**(wide | {name: limit}))).collect()
        filled = {}
        for r in rows:
            filled[r.sequence_id] = filled.get(r.sequence_id, 0) + (r.length, 1, r.loss_tokens)[k]
        assert max(filled.values()) <= limit and 1 < len(filled) <= 1.3 * sum(filled.values()) / limit + 1
    odd = spark.createDataFrame([("a", "assistant", None, 1), ("a", None, "x y", 2), (None, "user", "lost", 3), ("b", "user", "word " * 30_000, 4)], "conv_id string, role string, text string, tokens int")
    assert sorted((r.example_id, r.loss_tokens) for r in packing.count_turns(odd, BYTE).collect()) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_token_files(spark, sf_dir, which):
    df = {"odd": rows(spark), "documents": spark.read.parquet(f"{sf_dir}/documents.parquet"), "empty": rows(spark).where("false")}[which]
    path = storage.new_path(spark, "test")
    manifest = [tuple(r) for r in token_files.write_token_files(df, path, WORD).collect()]
    got = token_files.read_token_files(spark, path, manifest).collect()
    want = brute(spark, sf_dir, WORD, df)
    key = lambda d: -(2**64) if d is None else d
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((key(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)] == sorted(key(d) for d, _ in want)


def test_seek_reads_one_frame_and_finds_damage():
    sink = io.BytesIO()
    w = token_files.TokenFileWriter(sink, 2, frame_bytes=400)
    docs = [np.arange(i, i + n) for i, n in enumerate([5, 0, 300, 1, 1, 700, 2])]
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    raw = bytearray(sink.getvalue())
    r = token_files.TokenFileReader(io.BytesIO(bytes(raw)))
    assert len(r.frames) > 2
    for i, d in enumerate(docs):
        assert r.find(i)[0].tolist() == d.tolist()
    raw[int(r.at[1]) + 12] ^= 255
    bad = token_files.TokenFileReader(io.BytesIO(bytes(raw)))
    assert bad.find(2)[0].tolist() == docs[2].tolist()  # in an undamaged frame
    with pytest.raises(Exception):
        bad.find(5)

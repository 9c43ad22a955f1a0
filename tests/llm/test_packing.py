"""Packing against a plain tokenizer run and a naive first fit."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchloom.llm import packing as K
from matchloom.llm.queries import op12_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def held(spark, spec, rows, **kw):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, length int, ids string").repartition(3)
    return K.pack_documents(df, spec, **kw).collect()


def check(rows, out, length, tokenizer):
    """Every id of every row in one piece, sequences gapless and within length."""
    want = sorted((i if i is not None else -1, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    by_seq = {}
    for r in out:
        assert len(r.ids) == 4 * r.length and r.length > 0
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    # equal rows cannot be told apart by their pieces, so pieces are counted by (row, start)
    pieces = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens) for r in out)
    total = {}
    for i, ids in want:
        total.setdefault(i, []).append(ids)
    for i, texts in total.items():
        mine = [p for p in pieces if p[0] == i]
        assert sum(p[2] for p in mine) == sum(map(len, texts))
        if len(set(texts)) == 1:
            cover = np.zeros(len(texts[0]), int)
            for _, start, n, ids, doc in mine:
                assert ids == list(texts[0][start : start + n]) and doc == len(texts[0])
                cover[start : start + n] += 1
            assert (cover == len(texts)).all()
    return by_seq


def test_encoder_equals_the_tokenizer(spec):
    import pyarrow as pa

    from matchloom.llm import vectext as V

    texts = ["a ́b", "Σας ΟΔΟΣ", "<|endoftext|>a<|startoftext|> <|EndOfText|>", " x y\x85z 12 3's 'll", "", None, " \n", "한국어 ạ̀ İ ﬁ", "x" * 5000, "a\x0b\x0cb\x1fc é‍😀", "a.b don't.'s ., a.,;x a-.b 1.2.3 A.é.x it's,we'll!x?"]
    tokenizer, e = Tokenizer.from_str(spec), K.Encoder(spec)
    for lo, hi, raw, off in V.slices(pa.array(texts), 64):
        ids, begin = e.encode(raw, off)
        for r in range(lo, hi):
            assert ids[begin[r - lo] : begin[r - lo + 1]].tolist() == [*tokenizer.encode(texts[r] or "", add_special_tokens=False).ids, 1]


def test_encoder_forgets(spec, monkeypatch):
    monkeypatch.setattr(K, "MOST_WORDS", 3)
    e, tokenizer = K.Encoder(spec), Tokenizer.from_str(spec)
    for t in ("one two", "three four", "one five six seven"):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert e.encode(raw, np.array([0, len(raw)]))[0].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_first_fit_decreasing_against_naive():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        sizes = -np.sort(-rng.integers(1, 101, n))
        room, want = [], []
        for s in sizes:
            at = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [100] * (at == len(room))
            room[at] -= s
            want.append(at)
        assert K.first_fit_decreasing(sizes, 100).tolist() == want


@pytest.mark.parametrize("sizes", [[55] * 40, [64] * 5, [100] * 3, [51, 50, 49], [1], [99, 98, 2, 1], list(range(100, 0, -1))])
def test_pack_fills(sizes):
    out = K.pack(np.array(sizes, np.int64), 100, 0.0)
    covered = {p: sorted((a, a + n) for q, a, n, _, _ in out if q == p) for p in range(len(sizes))}
    for p, spans in covered.items():
        assert spans[0][0] == 0 and spans[-1][1] == sizes[p] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    used = np.zeros(max(b for *_, b, _ in out) + 1, int)
    for _, _, n, b, offset in sorted(out, key=lambda x: x[3:]):
        assert offset == used[b]
        used[b] += n
    assert used.min() > 0 and used.max() <= 100
    assert K.padding(used, 100).sum() <= max(100 - sum(sizes) % 100, 99) or (used & (used - 1) == 0).any()


def test_documents(spark, spec):
    tokenizer = Tokenizer.from_str(spec)
    rng = np.random.default_rng(0)
    vocab = ["alpha", "beta.", "Gamma", "d7", "é,", "中文", "<|endoftext|>", "\n"]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60)).tolist())) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 5000), (None, "no id"), (203, "twin text here")] + [(204, "copy of many " * 9)] * 60
    for length, group in ((64, 4096), (64, 40), (2048, 4096)):
        out = held(spark, spec, rows, length=length, group=group)
        by_seq = check(rows, out, length, tokenizer)
        used = np.array([sum(n for _, n in s) for s in by_seq.values()])
        assert K.padding(used, length).sum() <= 0.02 * used.sum() + length * (1 + len(out) // group * 2)
        assert len({s >> 32 for s in by_seq}) > 1 or group > 40
    assert held(spark, spec, []) == []


def test_query(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op12_packing(spark, sf).collect()
    assert {r.doc_id for r in out} == set(docs)
    for r in out:
        ids = [*tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 1]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    used = np.array(list(used.values()))
    assert used.max() <= 2048 and K.padding(used, 2048).sum() < 0.02 * used.sum()
    assert sorted(map(tuple, out)) == sorted(map(tuple, op12_packing(spark, sf).collect()))

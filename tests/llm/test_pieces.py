"""Backtracking against the sentencepiece library, id for id."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import pieces, queries

ODD = [None, "", " ", "  ", " " * 77, "a" * 5000, "==" * 300, "é à\n" * 40, "日本語 の 文 é́ a\x1cb", "<s> </s> <0x0A>", "▁▁ ▁a▁", "a　b①", "\U0001f600 \U0001f468‍", "\t\n\r\x0b", "x\x00 \x00"]


@pytest.fixture(scope="module")
def coder():
    return pieces.piece_bpe(queries.tokenizer_file("piece_bpe_32k.model"))


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_random_texts(coder):
    """Texts of letters, marks, scripts and characters without a piece, and of pieces put side by side."""
    rng = random.Random(3)
    letters = [*"abcdeorst ntl", "  ", "▁", "é", "日", "①", "\n", "0", "the", "ing", "==", "-----", "\U0001f600", "ไทย", "한국"]
    known = list(coder.ids)
    for k in range(6000):
        t = "".join(rng.choice(known if k % 2 else letters) for _ in range(rng.randrange(1, 30 - 20 * (k % 2))))
        assert ids(coder, t) == coder.library.encode(t, add_bos=True, add_eos=True), repr(t)


def test_backtracking_is_needed(coder):
    """Longest matches alone give other ids for some words, so that the way back is really taken."""
    def greedy(unit):
        out = []
        while unit:
            n = next((n for n in range(min(16, len(unit)), 0, -1) if unit[:n] in coder.number), 1)
            out.append(unit[:n])
            unit = unit[n:]
        return out

    words = ["▁unanswerable", "▁preprocessing", "▁andanednton", "▁rerestrent", "▁Mentouê.\nOuierè", "▁shwhndings"]
    assert any(greedy(w) != coder.library.encode(w[1:], out_type=str) for w in words)
    for w in words:
        assert ids(coder, w[1:])[1:-1] == coder.library.encode(w[1:])


def test_a_long_unit_in_linear_memory(coder):
    t = "".join(random.Random(k).choice("abcdefghij日") for k in range(30_000))
    assert ids(coder, t) == coder.library.encode(t, add_bos=True, add_eos=True)


def test_memory_of_units_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_UNITS", 8)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 8)
    one = pieces.PieceBpe(queries.tokenizer_file("piece_bpe_32k.model"))
    for k in range(60):
        t = f"word{k} the and other{k % 5}"
        assert ids(one, t) == coder.library.encode(t, add_bos=True, add_eos=True)
        assert max(len(one.known), len(one.older), len(one.pairs)) <= 8


def test_rows(spark, coder):
    """Nulls, empty and long texts, repeated rows, null ids and clashing columns."""
    def model():
        return pieces.piece_bpe(queries.tokenizer_file("piece_bpe_32k.model"))

    rows = [(k % 7, t, "keep", 3, 5) for k, t in enumerate(ODD)] + [(None, "same", "x", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, source int, decoded int")
    both = pieces.decode_ids(pieces.encode_texts(docs, model), model)
    assert sorted(both.columns) == ["decoded", "doc_id", "ids", "source", "text"]
    out = both.collect()
    assert len(out) == len(rows)
    for r in out:
        want = coder.library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == coder.library.decode(want) and (r.decoded == (r.text or "") or "▁" in r.text)
    assert sum(r.doc_id is None for r in out) == 2
    assert pieces.decode_ids(pieces.encode_texts(docs.where("false"), model), model).count() == 0
    bare = pieces.encode_texts(docs.select("text").where("text is null"), model, ends=False)
    assert [r.ids for r in bare.collect()] == [b""]
    assert [r.decoded for r in pieces.decode_ids(bare.select(F.lit(None).cast("binary").alias("ids")), model).collect()] == [""]


def test_query_over_whole_documents(spark, sf, coder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op11_pieces(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        want = coder.library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(coder.library.decode(want).encode()).hexdigest()

import random

import public_tokenizers as P
import pytest

from proseline.llm import alignment
from proseline.llm.alignment import Pair, align_corpus, brute_force, op11_alignment

from .helpers import folder, real

A, B = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(P.path("piece_bpe_32k.model"), "rb").read()


def rows(spark, texts, **extra):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    got = align_corpus(docs, A, B)
    assert got.columns == ["doc_id", *alignment.RESULTS]
    return [tuple(r)[1:] for r in got.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    bits = ["a", "don't", "word", " ", "  ", "\n", "\t", "\r", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", " ", "é", "é", "日本語", "😀", "123", "...", "();", "\x00", "<s>", "<|endoftext|>", "<0x0A>", "﻿", "ﬁ", "'s", "{", "}", "//"]
    made = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)]
    return [None, "", " ", "\n", "\n\nx", "\tx", "  x  ", "a▁b", "▁", "x" * 5000, " ".join(["word"] * 4000), "a b▁ c", *made, *made[:20]]


def test_odd_texts(spark, odd):
    assert rows(spark, odd) == brute_force(odd, A, B)


def test_small_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 400)
    monkeypatch.setattr(alignment, "BATCH", 7)
    assert rows(spark, odd) == brute_force(odd, A, B)


def test_real_texts(spark):
    docs = real(spark, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = op11_alignment(spark, "/root/testdata/sf0.001")
    want = [(d["doc_id"], *w) for d, w in zip(docs, brute_force([d["text"] for d in docs], A, B), strict=True)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_breaks_are_verified():
    pair = Pair(A, B)
    assert b" " in pair.breaks and b"\n" in pair.breaks
    assert b"\r" not in pair.breaks  # pieces such as ";\r" cross it
    assert Pair.crosses(b"a b", 32) and not Pair.crosses(b"  b", 32) and Pair.crosses(b" \n", 10) and not Pair.crosses(b"\n\n", 10)


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert op11_alignment(spark, folder(spark, tmp_path, documents=empty)).collect() == []
    assert rows(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2

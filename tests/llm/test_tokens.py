import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proseline.llm import tokens
from proseline.llm.tokens import RankMerger, count_tokens, op9_token_counts
from tests.llm.helpers import docs, real

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "   two  spaces ", "\n\n\t x", "it's we'll THEY'RE", "a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "aaaaaaaaaaaaaaaa" * 20, "naïve ÜBER 漢字かな 🙂🙂", "  x y", "\x1c\x1d\x85z",
    "x" * 5000, "1234567890 ½ ²", "word " * 20_000, "'s'S", "́​", "tab\tsep\r\n",
]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_against_the_library(spark):
    rows = {r["doc_id"]: r for r in count_tokens(docs(spark, ODD), PATH).collect()}
    assert [rows[i]["n_tokens"] for i in range(len(ODD))] == library(ODD)
    assert [rows[i]["n_bytes"] for i in range(len(ODD))] == [len((t or "").encode()) for t in ODD]
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows.values())


def test_real_documents(spark):
    d = real(spark, "documents").toPandas()
    got = {r["doc_id"]: r["n_tokens"] for r in op9_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i in d.doc_id] == library(d.text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abt h'é漢\n", max_size=30), min_size=1, max_size=5))
def test_merger(texts):
    import regex

    from proseline.llm.tokens import PATTERN

    merger = test_merger.merger = getattr(test_merger, "merger", None) or RankMerger(PATH)
    got = [int(merger.count([p.encode() for p in regex.findall(PATTERN, t)]).sum()) for t in texts]
    assert got == library(texts)


def test_edges(spark):
    assert count_tokens(docs(spark, ["a"]).limit(0), PATH).count() == 0
    clash = count_tokens(docs(spark, ["a b"]).withColumnRenamed("lang", "n_tokens"), PATH)
    assert clash.columns == ["doc_id", "source", "n_chars", "n_bytes", "n_tokens", "over_limit"] and clash.first()["n_tokens"] == 2


def test_long_pieces_are_not_kept(spark, monkeypatch):
    """Counts are the same whether pre-tokens are carried over or counted anew."""
    texts = ["word " * 50 + "x" * 5000, "y" * 24 + " " + "y" * 25, "word"] * 3
    want = [r["n_tokens"] for r in count_tokens(docs(spark, texts), PATH).orderBy("doc_id").collect()]
    for name, value in (("KEPT_CHARS", 3), ("KEPT", 2)):
        monkeypatch.setattr(tokens, name, value)
        assert [r["n_tokens"] for r in count_tokens(docs(spark, texts), PATH).orderBy("doc_id").collect()] == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        RankMerger(public_tokenizers.path("word_bpe_49k.json"))

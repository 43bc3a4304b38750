import base64
import functools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from proseline.llm import lattice
from proseline.llm.lattice import END, Model, Pieces, forward, grouped, op5_lm_scores, split
from tests.llm.helpers import docs, folder, real

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def segmentations(word, known):
    if not word:
        yield ()
    for k in range(1, min(max(map(len, known)), len(word)) + 1):
        if word[:k] in known:
            for rest in segmentations(word[k:], known):
                yield (word[:k], *rest)


def test_marginal():
    known = {b" ": 0.05, b"a": 0.2, b"b": 0.1, b"ab": 0.2, b" a": 0.05, b"aba": 0.1, b"\xc3": 0.05, b"\xa9": 0.05, b"abababab": 0.05, b"ababababa": 0.05, b" abababababa": 0.05, b"abababababab": 0.05}
    pieces = Pieces(list(known))
    scores = np.array([math.log(known[p]) for p in pieces.order])
    for word in (b"ab", b"abab", b"aba", b"\xc3\xa9a", b"a" * 12, b"ab" * 7, b"b" + b"ab" * 6, b"\xa9ababababb"):
        total = sum(math.prod(known[p] for p in w) for w in segmentations(b" " + word, known))
        for _, body in grouped([word]):
            assert math.isclose(math.exp(forward(pieces, scores, body)[0]), total, rel_tol=1e-9)


def whole_vocabulary():
    """Every piece of the file that lowered text without inner white space can hold, by plain reading."""
    found = {}
    for line in open(PATH, "rb"):
        piece, rank = base64.b64decode(line.split()[0]), int(line.split()[1])
        if len(piece) == 1 or (len(piece.split()) == 1 and piece.strip() in (piece, piece[1:]) and piece[:1] in (b" ", piece.strip()[:1]) and piece == piece.lower()):
            found[piece] = 1 / (10 + rank)
    total = sum(found.values())
    return {p: x / total for p, x in found.items()}


def brute_scores(texts, learn, known):
    """Each document's score: words by their discounted counts and all their segmentations, and the end, one by one."""
    counts = Counter()
    for t, on in zip(texts, learn, strict=True):
        if on:
            counts.update([*split((t or "").encode()), END])
    n, words = sum(counts.values()), {w: c for w, c in counts.items() if w != END}
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / max(1, once + 2 * twice)))

    @functools.cache
    def word(w):
        body, alpha = b" " + w, [1.0]
        for j in range(1, len(body) + 1):
            alpha.append(sum(alpha[i] * 0.7 * known[body[i:j]] for i in range(max(0, j - 128), j) if body[i:j] in known))
        return math.log10(max(words.get(w, 0) - d, 0) / n + d * len(words) / n * alpha[-1] * 0.3)

    return [sum(map(word, split((t or "").encode()))) + math.log10(counts[END] / n) for t in texts]


def brute_base(texts, learn):
    counts = Counter()
    for t, on in zip(texts, learn, strict=True):
        if on:
            counts.update([*split((t or "").encode()), END])
    n, v = sum(counts.values()), len(counts)
    rows = []
    for t in texts:
        tokens = [*split((t or "").encode()), END]
        rows.append((len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return rows


def test_real_documents(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HOT", 50)  # most words take the join
    d = real(spark, "documents").toPandas()
    learn = [zlib.crc32(str(i).encode()) % 5 != 1 for i in d.doc_id]
    got = {r["doc_id"]: r for r in op5_lm_scores(spark, "/root/testdata/sf0.001").collect()}
    for i, on, (n, known, total, base) in zip(d.doc_id, learn, brute_base(d.text, learn), strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not on, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    for i, want in zip(d.doc_id, brute_scores(d.text, learn, whole_vocabulary()), strict=True):
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9), i
    held = [r for r in got.values() if r["held_out"]]
    chars = sum(len(t or "") for i, t in zip(d.doc_id, d.text, strict=True) if got[i]["held_out"])
    assert sum(r["score"] for r in held) / chars > -1.3  # log10 a character; uniform letters would be -1.4


def test_edges(spark, tmp_path):
    texts = [None, "", "  ", "a b a", "A B", "new word", "x" * 20_000, "a b a", "é" * 300]
    sf = folder(spark, tmp_path, documents=docs(spark, texts).unionByName(docs(spark, texts[:1])))
    rows = op5_lm_scores(spark, sf).collect()
    assert len(rows) == len(texts) + 1 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[0]["score"] == by[2]["score"]
    none = op5_lm_scores(spark, folder(spark, tmp_path, documents=docs(spark, texts).where("doc_id < 0")))
    assert none.count() == 0
    import pyspark.sql.functions as F

    untrained = lattice.score_texts(docs(spark, ["a b"]), F.lit(False), PATH).first()
    assert untrained["train_tokens"] == 0 and math.isfinite(untrained["score"])


def test_model_is_a_distribution_over_words():
    pieces, scores = Pieces.load(PATH)
    model = Model(pieces, scores + math.log(0.7), 10, 3, 1, 1)
    _, logs = model.word_logs([b"aa", b"bb", END], np.array([4, 3, 3]))
    _, unseen = model.word_logs([bytes([x]) for x in range(33, 127)], np.zeros(94, np.int64))
    assert 0.5 < (10**logs).sum() + (10**unseen).sum() <= 1.0 + 1e-9


def test_frequent_long_words(spark, monkeypatch):
    """A long separator in every document is settled by the table of frequent words and not joined; scores stay those by brute force."""
    monkeypatch.setattr(lattice, "HOT", 2)
    texts = [f"{'-' * 300} w{i} {'é' * 70} x{i % 7}" for i in range(30)] + ["-" * 128, "-" * 129]
    tables, joined = [], []
    hot, shards = lattice.frequent, lattice.Scratch.save
    monkeypatch.setattr(lattice, "frequent", lambda rated: tables.append(hot(rated)) or tables[-1])

    def save(self, df):
        out = shards(self, df)
        if "rid" in out.columns:
            joined.append({bytes(r["word"]) for r in out.where("word IS NOT NULL").select("word").collect()})
        return out

    monkeypatch.setattr(lattice.Scratch, "save", save)
    import pyspark.sql.functions as F

    got = {r["id"]: r["score"] for r in lattice.score_texts(docs(spark, texts), F.lit(True), PATH).collect()}
    long = [b"-" * 300, "é".encode() * 70]
    assert set(tables[0]) == {END, *map(lattice.hot_key, long)} and all(len(k) <= lattice.HOT_BYTES for k in tables[0])
    assert not joined[0] & set(long) and {b"-" * 128, b"-" * 129, b"w0"} <= joined[0]
    for i, want in enumerate(brute_scores(texts, [True] * len(texts), whole_vocabulary())):
        assert math.isclose(got[i], want, rel_tol=1e-9)

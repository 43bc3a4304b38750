import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from proseline.llm import neardup as N
from proseline.llm.common import word_hashes
from tests.llm.helpers import docs, real


def grams(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(texts):
    g, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(g)):
        for j in range(i):
            if g[i] and g[j] and jaccard(g[i], g[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(g))]


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def corpus():
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(500)}"
    base, other = [word() for _ in range(150)], [word() for _ in range(400)]
    texts = [" ".join(base), " ".join(base).upper(), None, "", "!!!", "!!!", "one two", "One, two!", "two one", "same " * 300, "same " * 290, "same " * 100]
    texts += [edited(rng, base, rng.choice([0, 1, 2, 3, 5])) for _ in range(60)]
    texts += [edited(rng, other, rng.randrange(9)) for _ in range(40)]
    texts += [" ".join(other[:40] + [word() for _ in range(rng.randrange(5, 200))]) for _ in range(20)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 100))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("chunk", [512, 16])
def test_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    texts = corpus()
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in N.near_duplicates(docs(spark, texts)).collect()}
    want = brute(texts)
    assert {i: got[i][0] for i in got} == dict(enumerate(want))
    assert all(kept == (i == root) for i, (root, kept) in got.items())


def test_weak_ties_stay_apart(spark, monkeypatch):
    """A long chain of texts that share about half of their shingles with the next: bands tie many, hardly any are compared twice,
    and no family grows out of ties that don't hold."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000 * 20 + 60)]
    texts = [" ".join(words[20 * i : 20 * i + 60]) for i in range(2000)]
    texts += [texts[7] + " more", texts[1500] + " more", "x " + texts[7]]
    kept = spark.sparkContext.accumulator(0)
    plain = N.links

    def counted(texts, left, right, threshold):
        kept.add(len(left) * len(right))
        return plain(texts, left, right, threshold)

    monkeypatch.setattr(N, "links", counted)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: {2000: 7, 2001: 1500, 2002: 7}.get(i, i) for i in range(len(texts))}
    assert kept.value < 40 * len(texts), kept.value


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity lies between 0.8 and 0.85, the hardest to meet: all but a few are found."""
    rng = random.Random(3)
    texts, pairs = [], []
    for _ in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(base)
        while jaccard(grams(" ".join(base)), grams(" ".join(other))) > 0.85:
            other[rng.randrange(200)] = f"e{rng.random()}"
        if jaccard(grams(" ".join(base)), grams(" ".join(other))) >= 0.8:
            pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(other)]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs(spark, texts)).collect()}
    assert len(pairs) > 200 and sum(got[a] == got[b] for a, b in pairs) >= len(pairs) - 2


def test_signature_estimates_weighted_jaccard():
    a, b = "x y z u v w " * 20 + " ".join(f"a{i}" for i in range(60)), "x y z u v w " * 10 + " ".join(f"a{i}" for i in range(80))
    h, own = N.shingles(*word_hashes(pa.array([a, b])), 2)
    sig = N.signatures(h, own, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - jaccard(grams(a), grams(b))) < 0.04
    assert (sig != 0).all() and not N.signatures(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3).any()


def test_edges(spark):
    assert N.near_duplicates(docs(spark, []).limit(0)).count() == 0
    twice = docs(spark, ["a b c d e f", "g h i j k l", "a b c d e f"]).selectExpr("CASE WHEN doc_id = 2 THEN 1 ELSE doc_id END AS doc_id", "text", "lang AS kept")
    got = [(r["doc_id"], r["component_id"]) for r in N.near_duplicates(twice).collect()]
    assert sorted(got) == [(0, 0), (1, 0), (1, 0)]  # the id 1 has two texts, one of them a copy of 0's
    rows = N.near_duplicates(docs(spark, ["a b", "a b"]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text")).collect()
    assert [(r["component_id"], r["kept"]) for r in rows] == [(None, True)] * 2
    kept = N.drop_near_duplicates(docs(spark, corpus()))
    assert kept.columns == docs(spark, ["a"]).columns and kept.count() == len(set(brute(corpus())))


def test_real_documents(spark):
    d = real(spark, "documents").toPandas()
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(real(spark, "documents")).collect()}
    assert [got[i] for i in d.doc_id] == [d.doc_id[k] for k in brute(d.text.tolist())]

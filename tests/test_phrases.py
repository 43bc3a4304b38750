"""Phrase reuse against a plain version that compares every phrase with every other."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseline.functions.arrow import phrases
from proseline.functions.lint import REUSE_STOPWORDS, repeated_ngrams

SIZES, LEAST = range(4, 9), 3


def plain(words, stop):
    seen = {}
    for n in SIZES:
        for i in range(len(words) - n + 1):
            seen.setdefault((n, " ".join(words[i : i + n])), []).append(i)
    rows = sorted((-n, -len(at), at[0], gram) for (n, gram), at in seen.items() if len(at) >= LEAST and not set(gram.split(" ")) <= stop)
    covers = lambda o, r: (o[0] < r[0] or (o[0] == r[0] and o[2] < r[2])) and o[1] <= r[1] and r[3] in o[3]
    return [(-n, -c, p) for n, c, p, g in rows if not any(covers(o, (n, c, p, g)) for o in rows)]


def whole(words, stop=frozenset({"the", "of"})):
    return phrases(words, np.arange(max(0, len(words) - 3)), SIZES, LEAST, set(stop))


@pytest.mark.parametrize("seed", range(60))
def test_random_texts(seed):
    """Few words, of which some end or begin others, so that phrases hold each other within their words."""
    rng = random.Random(seed)
    known = rng.choice([["a", "ba", "ab", "aba", "the"], ["x", "y", "the", "of"], ["he", "the", "cat", "cats", "sat", "on", "one", "of"], [chr(97 + k) for k in range(12)]])
    block = rng.choices(known, k=rng.randint(4, 14))
    words = []
    while len(words) < rng.choice([20, 90, 200]):
        words += block if rng.random() < 0.4 else rng.choices(known, k=rng.randint(1, 5))
    assert whole(words) == plain(words, {"the", "of"})


def test_within_words():
    words = []
    for k in range(3):
        words += f"n{k} the cat sat one m{k} q{k}".split() + f"r{k} he cat sat on s{k}".split()
    got = [" ".join(words[p : p + n]) for n, _, p in whole(words)]
    assert got == ["the cat sat one"]  # "he cat sat on" stands within it as a string


def test_short_and_empty():
    assert whole([]) == whole(["a"] * 3) == [] and whole(["a"] * 6) == plain(["a"] * 6, set())


def test_long_texts_take_seconds():
    rng = random.Random(1)
    passage = [f"w{rng.randrange(20_000)}" for _ in range(150_000)]
    began = time.time()
    found = whole(passage * 3)
    assert time.time() - began < 30 and len(found) > 140_000
    began = time.time()
    found = whole(["of", "course", "it", "is"] * 100_000)
    assert time.time() - began < 10 and found


def test_column(spark):
    text = "One two three four five. " * 3 + "x y z"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(repeated_ngrams(F.coalesce("text", F.lit(""))).alias("g")).collect()
    words = text.lower().replace(".", "").split()
    assert [(g["n"], g["count"], g["phrase"]) for g in rows[0]["g"]] == [(n, c, " ".join(words[p : p + n])) for n, c, p in plain(words, set(REUSE_STOPWORDS))]
    assert rows[1]["g"] == rows[2]["g"] == []

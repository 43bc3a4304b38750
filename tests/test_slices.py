"""Counting over batches: bounded memory, and passes that only leave out what cannot match."""

import pandas as pd
from pyspark.sql import functions as F

from proseline.functions import arrow as A
from proseline.functions import lazy as Z
from proseline.functions import metrics as M
from proseline.functions import text as T


def test_slices_bound_what_is_held():
    texts = ["ab " * 200_000, None, "x" * 10, "y" * 1_500_000, ""] * 3
    parts = list(A.slices(pd.Series(texts)))
    assert [t for p in parts for t in p] == [t or "" for t in texts]
    assert len(parts) > 3 and all(len(p) == 1 or sum(map(len, p)) <= A.SLICE for p in parts)


def test_slices_do_not_change_results(spark, monkeypatch):
    texts = ["the red house stood. the red house stood. the red house stood", "", "a b a b a b " * 20, "un deux trois " * 30, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    read = lambda: [df.select("k", f.alias("m")).orderBy("k").collect() for f in (M.repetition(F.col("text")), A.repeated_phrases(F.lower(F.coalesce("text", F.lit(""))), range(4, 9), 3, ()))]
    whole = read()
    monkeypatch.setattr(A, "SLICE", 20)
    assert read() == whole


def test_echoes_leave_out_no_match(spark):
    texts = ["so so so fine", "no So SO so", "aſ AS as as", "ıi Iİ xi İ ı", "die-so so so1 x", "The dog. The cat. The cow.", "x\nThe dog. the cat! THE cow?", "one. The dog. Then no. The cow.", "¹so. ²so. ³so.", "É a. é b. É c. x",
             "a. ½ b. ½ c. ½ d", "the² a. the³ b. the¹ c.", "Σας a. σαΣ b. σας c.", "…a. 'b. 'b. 'b", "", "so  so\u00a0so", "wo\u0301 a. wo\u0301 b. wo\u0301 c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    e = A.word_echoes(F.col("text"))
    counts = [F.regexp_count("text", T.rx(p, "i")) for p in Z.ECHO]
    for row in df.select("text", *[e[g].alias(g) for g in Z.ECHO.values()], *[c.alias(f"n_{g}") for c, g in zip(counts, Z.ECHO.values(), strict=True)]).collect():
        assert all(row[g] or not row[f"n_{g}"] for g in Z.ECHO.values()), row
    assert not any(r[0] or r[1] for r in spark.createDataFrame([("One dog ran. Two cats sat. Three cows ate.",)], "text string").select(e["thrice"], e["starts"]).collect())


def test_counts_are_those_of_expressions(spark):
    """Sentences, words and paragraphs as the column expressions split them, odd blanks included."""
    texts = ["Ab c. D\x1ce f!\u2003 g h? \u00a0", "«x» ²½ wo\u0301rd İs ß_9. no", "a.\n \u2028\n b. c\n\x1c\nd", "", "e.”) f.'x g.\u00a0h. \"i j", "end.\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    lengths = lambda s: F.transform(s, lambda x: F.size(T.words(x)))
    low = T.lower_words(t)
    pairs = [
        (A.sentence_lengths(t), lengths(T.sentences(t))), (A.closed_lengths(t, 3)["k"], lengths(T.closed_sentences(t))), (A.closed_lengths(t, 3)["words"], F.size(T.words(t))),
        (A.word_kinds(t)["n"], F.size(low)), (A.word_kinds(t)["kinds"], F.size(F.array_distinct(low))), (A.word_kinds(t)["chars"], F.length(F.array_join(low, "")).cast("long")),
        (A.prose_counts(t, ("felt",), ("the",))["paragraphs"], F.transform(T.paragraphs(t), lambda x: F.greatest(F.lit(1), F.size(T.sentences(x))))),
        (A.prose_counts(t, ("felt",), ("the",))["letters"], F.size(T.alpha_words(F.lower(t)))),
    ]
    for row in df.select("text", *[c.alias(f"c{k}{i}") for k, p in enumerate(pairs) for i, c in enumerate(p)]).collect():
        for k in range(len(pairs)):
            assert row[f"c{k}0"] == row[f"c{k}1"], (k, row)

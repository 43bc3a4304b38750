"""Repetition, coherence, readability and prose-craft metrics as column expressions: row-local, no shuffle. What is
counted by word or sentence is counted in passes over Arrow batches; the curves over those counts are SQL functions.

A null or empty text has zeros throughout (and a coherence of 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import prose_counts, repetition_rates, sentence_lengths, word_kinds
from .text import count, find_all, let, spread, words

# Verbs that tell instead of show, and the words that frequency spikes pass over.
TELLING_VERBS = "seemed felt realized knew noticed sensed understood recognized appeared looked sounded wondered thought decided believed".split()
SPIKE_STOPWORDS = (
    "the a an and or but in on at to for of with by from is was are were be been being have has had do does did "
    "will would could should may might shall not no nor so yet as if it its that this these those i me my we our "
    "you your he him his she her they them their what which who whom how when where there here all each every both few more "
    "most other some such than too very just about up out then into"
).split()

E_WEIGHTS = {
    "sentence_start_monotony": 0.20,
    "word_frequency_spike": 0.15,
    "sentence_length_uniformity": 0.05,
    "telling_verb_density": 0.10,
    "paragraph_uniformity": 0.10,
    "dialogue_narration_balance": 0.05,
    "markdown_emphasis_penalty": 0.20,
    "em_dash_density_penalty": 0.15,
}


def _zero() -> Column:
    return F.lit(0.0)


def repetition(text: Column) -> Column:
    def whole(r: Column) -> Column:
        dup = F.when(r["enough"], r["dup"]).otherwise(0.0)
        grams = r["tok"] * 0.4 + r["bi"] * 0.3 + r["tri"] * 0.2 + r["run"] * 0.1
        return F.struct(
            r["tok"].alias("token_repetition_rate"),
            r["bi"].alias("bigram_repetition_rate"),
            r["tri"].alias("trigram_repetition_rate"),
            r["run"].alias("consecutive_repetition_score"),
            dup.alias("sentence_duplicate_ratio"),
            r["seq"].alias("sequence_repetition_score"),
            F.greatest(grams, dup, r["seq"]).alias("repetition_penalty"),
        )

    return let(repetition_rates(F.coalesce(text, F.lit(""))), whole)


def coherence(text: Column) -> Column:
    def of(s: Column) -> Column:
        v = s["cv"]
        curve = (
            F.when(v < 0.15, 0.3)
            .when(v < 0.3, 0.3 + (v - 0.15) / 0.15 * 0.5)
            .when(v <= 0.8, 0.8)
            .when(v <= 1.2, 0.8 - (v - 0.8) / 0.4 * 0.4)
            .otherwise(0.4)
        )
        some = s["n"] > 0
        return F.struct(s["n"].alias("sentence_count"), s["mean"].alias("avg_sentence_length"), v.alias("sentence_length_variation"), F.when(some, curve).otherwise(0.0).alias("coherence_score"))

    return let(spread(sentence_lengths(F.coalesce(text, F.lit("")))), of)


def readability(text: Column) -> Column:
    def of(w: Column) -> Column:
        n, kinds = w["n"], w["kinds"]
        mean = w["chars"] / n
        root = kinds / F.sqrt(n.cast("double"))
        score = F.least(F.greatest((root - 7.0) / 6.0, _zero()), F.lit(1.0)) * (1.0 - F.least(F.lit(0.3), F.greatest(_zero(), (mean - 5.5) / 3.0)))
        some = n > 0
        return F.struct(
            n.cast("long").alias("word_count"),
            F.when(some, mean).otherwise(0.0).alias("avg_word_length"),
            F.when(some, kinds / n).otherwise(0.0).alias("lexical_diversity"),
            F.when(some, score).otherwise(0.0).alias("readability_score"),
        )

    return let(word_kinds(F.coalesce(text, F.lit(""))), of)


def _monotony(runs: Column) -> Column:
    """runs: how often each first word occurs."""
    n = F.aggregate(runs, F.lit(0), lambda a, x: a + x).cast("double")
    return let(
        n,
        lambda n: let(
            F.aggregate(runs, _zero(), lambda a, x: a - x / n * F.log2(x / n)),
            lambda h: F.when(F.size(runs) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(_zero(), 1.0 - h / F.when(n > 1, F.log2(n)).otherwise(1.0), F.array_max(runs) / n - 0.3))),
        ),
    )


def _spike(top: Column, n_words: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(_zero(), (top / (n_words / 100.0) - 2.0) / 4.0))


def _uniformity(lengths: Column) -> Column:
    return let(spread(lengths)["cv"], lambda v: F.when(v >= 0.5, 0.0).when(v >= 0.2, (0.5 - v) / 0.3 * 0.7).otherwise(0.7 + (0.2 - v) / 0.2 * 0.3))


def _telling(share: Column) -> Column:
    return let(share, lambda r: F.when(r <= 0.3, 0.0).otherwise(F.least(F.lit(1.0), (r - 0.3) / 0.5)))


def _paragraphs(p: Column, n_sentences: Column) -> Column:
    """p: sentences of each paragraph."""

    def of(v: Column) -> Column:
        staccato = F.when((v["mean"] <= 1.5) & (v["n"] >= 6), 0.6).when((v["mean"] <= 2.0) & (v["n"] >= 8), 0.4).otherwise(0.0)
        even = F.when(v["cv"] >= 0.4, 0.0).otherwise((0.4 - v["cv"]) / 0.4 * 0.4)
        return F.when(v["n"] == 1, F.when(n_sentences > 8, 0.3).otherwise(0.0)).otherwise(F.greatest(staccato, even))

    return let(spread(p), of)


def emphasis_penalty(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("*")), _emphasis(text)).otherwise(0.0)


def _emphasis(text: Column) -> Column:
    spans = find_all(text, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", group=1)
    short = F.size(F.filter(spans, lambda m: F.size(words(m)) <= 3))
    return let(short, lambda n: F.when(n == 0, 0.0).when(n <= 2, n * 0.15).otherwise(F.least(F.lit(1.0), 0.3 + (n - 2) * 0.14)))


def _em_dashes(text: Column, n_paragraphs: Column, n_words: Column) -> Column:
    some = F.contains(text, F.lit("—")) | F.contains(text, F.lit(" -- "))
    rate = F.when(some, count(text, "—| -- ")).otherwise(0) / F.greatest(n_paragraphs, F.floor(n_words / 80), F.lit(1))
    return let(rate, lambda r: F.when(r <= 0.5, 0.0).otherwise(1.0 - 1.0 / (1.0 + (r - 0.5) * (r - 0.5) / 2.0)))


def _dialogue(share: Column) -> Column:
    return let(share, lambda f: F.when(f.between(0.10, 0.65), 0.0).when(f < 0.10, (0.10 - f) / 0.10 * 0.25).otherwise(F.least(F.lit(0.6), (f - 0.65) / 0.35 * 0.6)))


def prose(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))

    def whole(c: Column) -> Column:
        n, letters, paragraphs = F.size(c["sentences"]), c["letters"], F.size(c["paragraphs"])
        parts = [
            _monotony(c["starts"]), _spike(c["spike"], letters), _uniformity(c["sentences"]), _telling(c["telling"] / n), _paragraphs(c["paragraphs"], n), _dialogue(c["spoken"] / n),
            emphasis_penalty(text), _em_dashes(text, paragraphs, letters),
        ]
        found = F.struct(*[x.cast("double").alias(k) for x, k in zip(parts, E_WEIGHTS, strict=True)])
        return F.when((n >= 3) & (letters >= 20), found).otherwise(F.struct(*[_zero().alias(k) for k in E_WEIGHTS]))

    def total(m: Column) -> Column:
        penalty = sum((m[k] * w for k, w in list(E_WEIGHTS.items())[1:]), m["sentence_start_monotony"] * E_WEIGHTS["sentence_start_monotony"])
        return F.struct(*[m[k].alias(k) for k in E_WEIGHTS], F.least(F.lit(1.0), F.greatest(_zero(), penalty)).alias("prose_penalty"))

    return let(let(prose_counts(text, tuple(TELLING_VERBS), tuple(SPIKE_STOPWORDS)), whole), total)

"""The composite quality score with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lazy import STANDARD, PatternSet, lazy
from .lint import Linter, lint_counts
from .metrics import coherence, prose, readability, repetition

FAMILIES = ("repetition", "coherence", "readability", "prose", "lazy", "lint")


def composite(coherence_: Column, readability_: Column, lazy_: Column, lint_: Column, repetition_: Column, prose_: Column, weights=(0.25, 0.15, 0.40, 0.20)) -> Column:
    """Weighted base times what repetition and prose leave; trial_overall_score uses weights of 0.2, 0.2, 0.3, 0.3."""
    a, b, c, d = weights
    return (coherence_ * a + readability_ * b + (1.0 - lazy_) * c + lint_ / 100.0 * d) * (1.0 - repetition_) * (1.0 - prose_)


def combo_score(quality: Column, repetition_: Column, coherence_: Column, readability_: Column) -> Column:
    return quality * 0.4 + (1.0 - repetition_) * 0.3 + coherence_ * 0.2 + readability_ * 0.1


def score(df: DataFrame, text_col: str = "text", patterns: PatternSet = STANDARD, linter: Linter | None = None, lint_on: bool = True) -> DataFrame:
    """df with all metrics of the text as columns, quality_score (also as overall_quality) last.

    Row-local. An empty or null text scores 0 with a lint score of 50 and the band 'unknown'; with the linter off those are 50 and
    'unavailable'. Metric columns that nothing reads are pruned family by family.
    """
    t = F.col(text_col)
    some = F.coalesce(F.length(t) > 0, F.lit(False))
    staged = df.withColumns({
        "_repetition": repetition(t),
        "_coherence": coherence(t),
        "_readability": readability(t),
        "_prose": prose(t),
        "_lazy": lazy(t, patterns),
        "_lint": lint_counts(t, linter or Linter()) if lint_on else F.struct(F.lit(50).cast("long").alias("score"), F.lit("unavailable").alias("band"), F.lit(0).cast("long").alias("n_violations")),
    })
    lint_score = F.when(some, F.col("_lint.score").cast("double")).otherwise(50.0)
    out = staged.withColumns({
        "lint_score": lint_score,
        "lint_band": F.when(some, F.col("_lint.band")).otherwise("unknown"),
        "lint_violations": F.when(some, F.col("_lint.n_violations")).otherwise(F.lit(0).cast("long")),
    })
    columns = [c for c in df.columns]
    metrics = [f"_repetition.{k}" for k in ("repetition_penalty", "token_repetition_rate", "bigram_repetition_rate", "trigram_repetition_rate", "consecutive_repetition_score", "sentence_duplicate_ratio", "sequence_repetition_score")]
    metrics += [f"_coherence.{k}" for k in ("coherence_score", "sentence_count", "avg_sentence_length", "sentence_length_variation")]
    metrics += [f"_readability.{k}" for k in ("readability_score", "word_count", "avg_word_length", "lexical_diversity")]
    metrics += [f"_prose.{k}" for k in ("prose_penalty", "sentence_start_monotony", "word_frequency_spike", "sentence_length_uniformity", "telling_verb_density", "paragraph_uniformity", "dialogue_narration_balance", "markdown_emphasis_penalty", "em_dash_density_penalty")]
    metrics += [f"_lazy.{k}" for k in ("lazy_score", "has_lazy_text", "lazy_pattern_count", "lazy_patterns_found")]
    quality = composite(F.col("_coherence.coherence_score"), F.col("_readability.readability_score"), F.col("_lazy.lazy_score"), F.col("lint_score"), F.col("_repetition.repetition_penalty"), F.col("_prose.prose_penalty"))
    quality = F.when(some, quality).otherwise(0.0)
    return out.select(*columns, *[F.col(m).alias(m.split(".")[1]) for m in metrics], "lint_score", "lint_band", "lint_violations", quality.alias("quality_score"), quality.alias("overall_quality"))

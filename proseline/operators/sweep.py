"""Experiment control as replays over recorded trials: configuration, prompt selection, pruning, convergence, revalidation."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseline.functions import arrow  # noqa: F401 - functions that go to workers travel by value
from proseline.functions.lazy import STANDARD, PatternSet
from proseline.functions.score import composite, score
from proseline.functions.text import valid_response

from .ordered import FOLD_ROWS, first_stop, running_medians

NATIVE_PARAMETERS = ("temperature", "top_p", "max_tokens", "presence_penalty", "frequency_penalty")
TRIAL_DEFAULTS = {
    "response_length": 0.0, "repetition_penalty": 0.0, "coherence_score": 0.0, "readability_score": 0.0, "lazy_score": 0.0, "lazy_pattern_count": 0.0,
    "prose_penalty": 0.0, "sentence_start_monotony": 0.0, "word_frequency_spike": 0.0, "telling_verb_density": 0.0, "lint_score": 50.0, "lint_violations": 0.0,
    "score_variance": 0.0, "score_min": 0.0, "num_prompts_evaluated": 1.0,
}


@dataclass(frozen=True)
class Parameter:
    name: str
    low: float
    high: float
    type: str


def parse_space(spec: dict) -> list[Parameter]:
    """[low, high] or [low, high, type] by name; two whole bounds make an int."""
    out = []
    for name, bounds in spec.items():
        if not isinstance(bounds, list) or len(bounds) < 2:
            raise ValueError(f"{name}: a list of low and high, and perhaps a type, is wanted")
        named = len(bounds) > 2 and isinstance(bounds[2], str)
        whole = all(isinstance(b, int) for b in bounds[:2])
        out.append(Parameter(name, bounds[0], bounds[1], bounds[2].lower() if named else "int" if whole else "float"))
    return out


def settings(defaults: dict, prefix: str = "", file: dict | None = None) -> dict:
    """Defaults, then environment variables (prefix and upper-case key), then the file; a value keeps its default's type."""
    env = {k: type(v)(os.environ[f"{prefix}{k.upper()}"]) if v is not None else os.environ[f"{prefix}{k.upper()}"] for k, v in defaults.items() if f"{prefix}{k.upper()}" in os.environ}
    return defaults | env | (file or {})


def prompt_pool(spark: SparkSession, config: dict, known: dict[str, dict]) -> tuple[DataFrame, str, int]:
    """Prompts (id, format, messages, text, category, pos), mode and number for each trial. known: the pool that ids refer to."""
    if "prompt" in config and "prompts" not in config:
        chosen, mode, k = {"custom_single": {"text": config["prompt"], "category": "Custom"}}, "all", 1
    else:
        own = config.get("prompts", {})
        mode, k, ids = own.get("mode", "sample"), own.get("samples_per_trial", 3), own.get("pool")
        unknown = [i for i in ids or () if i not in known]
        if unknown:
            raise ValueError(f"unknown prompts: {unknown}")
        chosen = dict(known) if ids is None else {i: known[i] for i in ids}
        for extra in own.get("custom", []):
            if not ("messages" in extra or "text" in extra):
                raise ValueError("a custom prompt needs messages or text")
            chosen[extra.get("id", f"custom_{len(chosen)}")] = {"category": "Custom"} | extra
        chosen = chosen or dict(known)
    rows = [(i, "chat" if "messages" in p else "completion", [(m["role"], m["content"]) for m in p.get("messages", [])] or None, p.get("text"), p.get("category"), n) for n, (i, p) in enumerate(chosen.items())]
    schema = "id string, format string, messages array<struct<role:string,content:string>>, text string, category string, pos int"
    return spark.createDataFrame(rows, schema), mode, k


def select_prompts(trials: DataFrame, prompts: DataFrame, mode: str, k: int, study: str, startup: int = 0) -> DataFrame:
    """(trial, prompt, pos): all prompts, one, or k of them for each trial, chosen by the md5 of study, trial and prompt; the first
    ``startup`` trials keep one. Each trial meets the pool (its size is that of a configuration, not of the data)."""
    take = {"all": 1 << 30, "random": 1}.get(mode, k)
    pool = prompts.agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("pool"))
    pairs = trials.select("trial").join(F.broadcast(pool)).select("trial", F.explode("pool").alias("p")).select("trial", F.col("p.id").alias("prompt"), F.col("p.pos").alias("pos"))
    order = Window.partitionBy("trial").orderBy(F.col("pos") if mode == "all" else F.md5(F.concat_ws(":", F.lit(study), F.col("trial").cast("string"), "prompt")), "pos")
    n = F.when(F.col("trial") < startup, 1).otherwise(take)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def trials_frame(trials: DataFrame) -> DataFrame:
    """Completed trials with defaults for what they lack, their parameters as columns, the first response and the overall score.

    trials: trial, state, value, and any of the metrics, parameters (a struct) and response_texts (a map)."""
    done = trials.where("state = 'COMPLETE'")
    if "parameters" in trials.columns:
        done = done.select(*[c for c in trials.columns if c != "parameters"], "parameters.*")
    for name, default in TRIAL_DEFAULTS.items():
        done = done.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in trials.columns else F.lit(default))
    for name, default in (("lint_band", "unknown"), ("prompt_mode", "single")):
        done = done.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in trials.columns else F.lit(default))
    first = F.coalesce(F.get(F.map_values("response_texts"), F.lit(0)), F.lit("")) if "response_texts" in trials.columns else F.lit("")
    overall = composite(F.col("coherence_score"), F.col("readability_score"), F.col("lazy_score"), F.col("lint_score"), F.col("repetition_penalty"), F.col("prose_penalty"), (0.2, 0.2, 0.3, 0.3))
    return done.withColumn("response_text", first).withColumn("overall_score", overall)


def objective(responses: DataFrame, text_col: str = "text", least: int = 20, floor: float = 0.1, patterns: PatternSet = STANDARD) -> DataFrame:
    """What a trial is worth, from its responses (trial and the text; other columns are left out): prompts, failed_prompts, mean_score,
    score_variance, score_min and the state. Responses of fewer than ``least`` characters fail; a trial without a valid response, or
    with a mean under ``floor``, is pruned. Texts are scored where they are; one shuffle of partial sums by trial."""
    rows = responses.select("trial", F.when(valid_response(F.col(text_col), least), F.col(text_col)).alias("text"))
    scored = score(rows, patterns=patterns).select("trial", F.when(F.col("text").isNotNull(), F.col("quality_score")).alias("value"))
    stats = scored.groupBy("trial").agg(
        F.count("*").alias("prompts"), F.count_if(F.col("value").isNull()).alias("failed_prompts"), F.avg("value").alias("mean_score"),
        F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("score_variance"), F.min("value").alias("score_min"),
    )
    return stats.withColumn("state", F.when(F.col("mean_score") >= floor, "COMPLETE").otherwise("PRUNED"))


def trial_summary(frame: DataFrame) -> DataFrame:
    best = lambda c: F.max_by(c, F.struct("overall_score", (-F.col("trial")).alias("o")))
    return frame.agg(
        F.count("*").alias("completed_trials"), F.max("value").alias("best_quality_score"), F.avg("value").alias("avg_quality_score"), F.max("overall_score").alias("best_overall_score"),
        F.avg("overall_score").alias("avg_overall_score"), best(F.col("trial")).alias("best_trial"), F.avg("num_prompts_evaluated").alias("avg_prompts_per_trial"),
        F.avg("score_variance").alias("avg_score_variance"), F.avg("score_min").alias("avg_score_min"),
    )


def failures(responses: DataFrame, valid: Column) -> DataFrame:
    """Per trial: prompts asked, failed and scored, and whether none was left (such a trial is pruned)."""
    return responses.groupBy("trial").agg(F.count("*").alias("prompts"), F.count_if(~valid).alias("failed_prompts"), (F.count_if(valid) == 0).alias("all_failed"))


def convergence(trials: DataFrame, patience: int, delta: float, chunk: int = FOLD_ROWS) -> DataFrame:
    """Where a study stops: (stop_trial, best). Trials in order; only a completed one can improve, and only by more than delta over the
    best that counted; patience completed trials without improvement, or twice as many completed and pruned ones, end it. stop_trial is
    null if it goes on.

    Order-dependent, but composed from blocks of trials (``ordered.first_stop``): no task holds more than a block (of ``chunk`` trials, or as many as patience needs), and no job follows another's result.
    """
    kept = trials.where("state IN ('COMPLETE', 'PRUNED')").select("trial", (F.col("state") == "COMPLETE").alias("complete"), "value")
    stop, best = first_stop(kept, patience, delta, chunk)
    return trials.sparkSession.createDataFrame([(None if stop is None else int(stop), best)], "stop_trial bigint, best double")


def median_prune(steps: DataFrame, startup: int = 10, warmup: int = 1) -> DataFrame:
    """Steps (trial, step, value: running mean) at which a trial falls below the median of the completed earlier trials at that step.

    A trial is held against trials before it, from the startup-th completed one and past the warm-up steps on, by its best value so far. The medians
    are exact (``ordered.running_medians``, a block of a step's trials at a time). Rows of one trial and step see the same earlier trials. Null
    steps, trials and values are passed over."""
    so_far = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    mine = steps.withColumn("best", F.max("value").over(so_far)).where((F.col("step") >= warmup) & F.col("trial").isNotNull() & F.col("best").isNotNull())
    rows = mine.select("trial", "step", F.col("best").cast("double").alias("best"), F.when(F.col("state") == "COMPLETE", F.col("value").cast("double")).alias("value"))
    medians = running_medians(rows.select("step", "trial", "value"), startup).select("step", "trial", "median")
    return rows.join(medians, ["step", "trial"]).select("trial", "step", "best", "median", (F.col("best") < F.col("median")).alias("prune"))


def revalidation(frame: DataFrame, startup: int, k: int, n: int = 3) -> DataFrame:
    """The n best completed startup trials that saw fewer than k prompts."""
    if k <= 1:
        return frame.limit(0)
    rows = frame.where((F.col("state") == "COMPLETE") & (F.col("trial") < startup) & (F.coalesce(F.col("num_prompts_evaluated"), F.lit(1)) < k))
    return rows.orderBy(F.col("value").desc(), "trial").limit(n)


def budget(total: int, startup: int, finished: int, revalidated: int) -> tuple[int, int]:
    """Trials left for the startup phase and for the phase after it."""
    return max(0, min(startup, total) - finished), max(0, total - max(startup, finished) + revalidated)


def _earlier(rows: DataFrame, key: str, levels: int) -> DataFrame:
    """rows (key, best, pruned, n) with best_, pruned_ and n_ of all rows before each. Keys are whole numbers in blocks of 4,096, blocks of
    blocks and so on; only the totals of the topmost blocks meet in one window."""
    before = lambda w: [F.max("best").over(w).alias("best_"), F.sum("pruned").over(w).alias("pruned_"), F.sum("n").over(w).alias("n_")]
    frame = lambda w: w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return rows.select("*", *before(frame(Window)))
    block = f"{key}_block"
    rows = rows.withColumn(block, F.shiftright(F.col(key).cast("long"), 12))
    totals = rows.groupBy(block).agg(F.max("best").alias("best"), F.sum("pruned").alias("pruned"), F.sum("n").alias("n"))
    outer = _earlier(totals, block, levels - 1).select(F.col(block).alias("_b"), F.col("best_").alias("_best"), F.col("pruned_").alias("_pruned"), F.col("n_").alias("_n"))
    inner = rows.select("*", *before(frame(Window.partitionBy(block)))).join(outer, F.col(block) == F.col("_b"))
    both = lambda k: F.coalesce(F.col(f"{k}_"), F.lit(0)) + F.coalesce(F.col(f"_{k}"), F.lit(0))
    return inner.select(*rows.columns, F.greatest("best_", "_best").alias("best_"), both("pruned").alias("pruned_"), both("n").alias("n_"))


def progress(trials: DataFrame, every: int = 5) -> DataFrame:
    """After every so many trials: best value so far and number pruned."""
    rows = trials.select("trial", F.when(F.col("state") == "COMPLETE", F.col("value")).alias("best"), F.coalesce(F.col("state") == "PRUNED", F.lit(False)).cast("long").alias("pruned"), F.lit(1).cast("long").alias("n"))
    found = _earlier(rows, "trial", 2).where((F.col("n_") + F.col("n")) % every == 0)
    return found.select("trial", F.greatest("best", "best_").alias("best"), (F.col("pruned") + F.col("pruned_")).alias("pruned"))


def route_parameters(parameters: Column, extra: Column, native: tuple = NATIVE_PARAMETERS) -> Column:
    """A map of values split into those that a request names itself and those of its body; the sweep's own win over configured extras."""
    merged = F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(parameters, k)), parameters)
    return F.struct(F.map_filter(merged, lambda k, v: k.isin(*native)).alias("native"), F.map_filter(merged, lambda k, v: ~k.isin(*native)).alias("extra_body"))

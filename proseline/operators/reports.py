"""Reports over scored texts: group means, top-k, summaries, correlations, calibration, pattern frequencies, histograms and box plots.

Only these shuffle, and only partial aggregates or top-k rows do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseline.functions.score import combo_score
from proseline.sources.scratch import saved

from .ordered import quantiles

CONFIG_KEYS = ["temperature", "min_p", "adaptive_target"]
CALIBRATION_METRICS = ["quality_score", "coherence_score", "readability_score", "lazy_score", "prose_penalty", "repetition_penalty", "lint_score"]
COMPARED_METRICS = CALIBRATION_METRICS[:-1]
AVERAGED_METRICS = "repetition_penalty coherence_score readability_score lazy_score prose_penalty sentence_start_monotony word_frequency_spike telling_verb_density lint_score lint_violations".split()
BAND_RANK = {"clean": 0, "light": 1, "moderate": 2, "unknown": 2, "unavailable": 2, "heavy": 3}


def flatten_parameters(responses: DataFrame) -> DataFrame:
    """Nested parameters as columns; top_nsigma is 1.0 where it is missing."""
    rest = [c for c in responses.columns if c != "parameters"]
    out = responses.select(*rest, "parameters.*")
    return out.withColumn("top_nsigma", F.coalesce("top_nsigma", F.lit(1.0)) if "top_nsigma" in out.columns else F.lit(1.0))


def varied_keys(df: DataFrame) -> list[str]:
    """The configuration's columns, with top_nsigma only if it varies (a null counts as a value)."""
    if "top_nsigma" not in df.columns:
        return CONFIG_KEYS
    n = df.agg((F.count_distinct("top_nsigma") + F.max(F.col("top_nsigma").isNull().cast("int"))).alias("n")).first()["n"] or 0
    return CONFIG_KEYS + ["top_nsigma"] * (n > 1)


def group_means(df: DataFrame, keys: list[str], metrics: list[str], samples: str | None = None, per_key: int = 3) -> DataFrame:
    """Means by configuration; rows with a null key go. samples: a column of which each group keeps its first values in order
    (at most per_key, so that no group is gathered whole)."""
    rows = df.dropna(subset=keys)
    out = rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n"))
    if samples:
        order = Window.partitionBy(*keys).orderBy(F.col(samples).asc_nulls_last())
        few = rows.select(*keys, samples).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_key)
        out = out.join(few.groupBy(*keys).agg(F.array_sort(F.collect_list(samples)).alias(samples)), keys, "left")
    return out


def top(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The k largest; nulls never rank, ties go to the first by the tie columns."""
    return df.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), *ties).limit(k)


def best_configs(df: DataFrame, keys: list[str] | None = None, k: int = 10) -> DataFrame:
    """Best configurations by the combined score of group means, ranked."""
    keys = keys or varied_keys(df)
    means = group_means(df, keys, ["quality_score", "repetition_penalty", "coherence_score", "readability_score", "response_length"])
    means = means.withColumn("overall_score", combo_score(F.col("quality_score"), F.col("repetition_penalty"), F.col("coherence_score"), F.col("readability_score")))
    return ranked(top(means, "overall_score", k, keys), "overall_score", keys)


def ranked(few: DataFrame, by: str, ties: list[str]) -> DataFrame:
    """few (a top-k result) with its rank from 1."""
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), *ties)).cast("long"))


def chat_configs(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """As best_configs, with the combined score taken row by row and then averaged."""
    rows = df.withColumn("overall_score", combo_score(F.col("quality_score"), F.col("repetition_penalty"), F.col("coherence_score"), F.col("readability_score")))
    return top(group_means(rows, keys, ["quality_score", "repetition_penalty", "coherence_score", "readability_score", "overall_score", "response_length"]), "overall_score", k, keys)


def summary(df: DataFrame) -> DataFrame:
    """One row of overall statistics; ranges as text. What is needed of df is written once; the median is exact, in bounded memory."""
    wanted = ["success", "response_length", "quality_score", "repetition_penalty", "coherence_score", "readability_score", "overall_quality", *[c for c in [*CONFIG_KEYS, "top_nsigma"] if c in df.columns]]
    df = saved(df.select(*wanted))
    median = quantiles(df, [], "response_length", {"median_response_length": 0.5}).select("median_response_length")
    between = lambda c: F.concat(F.min(c).cast("string"), F.lit(" - "), F.max(c).cast("string"))
    one = df.agg(
        F.count("*").alias("total_requests"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg("response_length").alias("avg_response_length"),
        F.min("response_length").alias("min_response_length"),
        F.max("response_length").alias("max_response_length"),
        *[between(c).alias(f"{c}_range") for c in [*CONFIG_KEYS, "top_nsigma"] if c in df.columns],
        F.avg("quality_score").alias("avg_quality_score"),
        F.avg("repetition_penalty").alias("avg_repetition_penalty"),
        F.avg("coherence_score").alias("avg_coherence_score"),
        F.avg("readability_score").alias("avg_readability_score"),
        F.avg("overall_quality").alias("avg_overall_quality"),
        F.max("quality_score").alias("best_quality_score"),
        F.min("quality_score").alias("worst_quality_score"),
    )
    return one.join(median, how="left")  # one row, and one or none


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson coefficients of all column pairs as rows (a, b, r), each over the rows where both are present; one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    one = df.agg(*[both(a, b).alias(f"{a}|{b}") for a, b in pairs if a <= b])
    cell = lambda a, b: F.col(f"`{min(a, b)}|{max(a, b)}`")
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b).alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def calibration(df: DataFrame, corpus: str, metrics: list[str] = CALIBRATION_METRICS) -> DataFrame:
    """corpus, metric, mean, std (population), min, max, n; a missing metric counts as 0."""
    tall = df.select(corpus, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics]).unpivot([corpus], metrics, "metric", "value")
    return tall.groupBy(corpus, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def corpus_comparison(df: DataFrame, corpus: str, names: list, first, last, metrics: list[str] = COMPARED_METRICS) -> DataFrame:
    """metric, a mean for each corpus in names, and the gap between two of them."""
    wide = calibration(df, corpus, metrics).groupBy("metric").pivot(corpus, names).agg(F.first("mean"))
    return wide.withColumn("gap", F.col(f"`{first}`") - F.col(f"`{last}`"))


def _band_rank(band: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in BAND_RANK.items() for x in (F.lit(k), F.lit(v))])[band], F.lit(2))


def worst_band(df: DataFrame, key: str, band: str, order: str) -> DataFrame:
    """Of each group the band that ranks worst, the first of those that tie. 'saturated' has the middle rank that unknown bands have;
    worst_band_fixed ranks it last."""
    rank = _band_rank(F.col(band))
    fixed = F.when(F.col(band) == "saturated", 4).otherwise(rank)
    pick = lambda r: F.max_by(F.col(band), F.struct(r.alias("r"), (-F.col(order)).alias("o")))
    return df.groupBy(key).agg(pick(rank).alias("worst_band"), pick(fixed).alias("worst_band_fixed"))


def average_by_trial(df: DataFrame, key: str = "trial", order: str | None = None) -> DataFrame:
    """Of each trial, over its prompts: means of the metrics and the length, pattern hits, mean, population variance and least of the scores, the
    worst band (of those that tie the one of the first prompt by ``order``) and the list of hits. What a prompt or df lacks counts as 0, 'unknown' or no hits.

    The list holds every prompt's entries (pattern, n); equal ones are one entry with how often it occurs (times), sorted. So it is bounded by the
    patterns and not by the prompts, and no trial's prompts meet in one task. df is read twice."""
    of = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)
    band = of("lint_band", "unknown")
    first = [F.col(order).isNull(), F.col(order)] if order else []
    worst = F.min_by(band, F.struct(*[c.alias(f"_{k}") for k, c in enumerate([-_band_rank(band), *first, band])]))
    out = df.groupBy(key).agg(
        *[F.avg(of(m, 0).cast("double")).alias(m) for m in [*AVERAGED_METRICS, "response_length"]],
        worst.alias("lint_band"),
        F.sum(of("lazy_pattern_count", 0)).cast("long").alias("lazy_pattern_count"),
        F.avg("quality_score").alias("mean_score"),
        F.when(F.count("*") > 1, F.var_pop("quality_score")).otherwise(0.0).alias("score_variance"),
        F.min("quality_score").alias("score_min"),
    )
    none = F.array().cast("array<struct<pattern:string,n:bigint,times:bigint>>")
    if "lazy_patterns_found" not in df.columns:
        return out.withColumn("lazy_patterns_found", none)
    entries = df.select(F.col(key).alias("_key"), F.explode("lazy_patterns_found").alias("h")).groupBy("_key", F.col("h.pattern").alias("pattern"), F.col("h.n").alias("n")).agg(F.count("*").alias("times"))
    lists = entries.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pattern", "n", "times"))).alias("lazy_patterns_found"))
    return out.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left").select(*out.columns, F.coalesce("lazy_patterns_found", none).alias("lazy_patterns_found"))


def running_mean(df: DataFrame, trial: str, step: str, value: str) -> DataFrame:
    frame = Window.partitionBy(trial).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(trial, step, value, F.avg(value).over(frame).alias("running_mean"))


def pattern_frequency(df: DataFrame, trial: str = "trial", hits: str = "lazy_patterns_found", k: int = 30) -> DataFrame:
    """pattern, hits, trials, percent of all trials; the k most frequent. The entries of average_by_trial count as often as they occur."""
    n = df.agg(F.count_distinct(trial).alias("n_trials"))
    times = F.col("h.times") if "times" in df.schema[hits].dataType.elementType.names else F.lit(1)
    rows = df.select(trial, F.explode(hits).alias("h")).groupBy("h.pattern").agg(F.sum(F.col("h.n") * times).cast("long").alias("hits"), F.count_distinct(trial).alias("trials"))
    few = top(rows, "hits", k, ["pattern"])
    return few.join(F.broadcast(n)).select("pattern", "hits", "trials", (F.col("trials") * 100.0 / F.col("n_trials")).alias("percent"))  # one row on the other side


def eval_summary(responses: DataFrame, score_col: str, valid: Column) -> DataFrame:
    """One row over all prompts: how many there are, how many had a valid response, and the mean, least and largest score of those."""
    value = F.when(valid, F.col(score_col))
    return responses.agg(F.count("*").alias("prompts"), F.count(value).alias("evaluated"), F.avg(value).alias("mean_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score"))


def interpretation(temperature: Column, repetition: Column, coherence: Column) -> Column:
    """The report's words for a configuration."""
    return F.struct(
        F.when(temperature > 1.05, "creative").when(temperature < 1.05, "focused").otherwise("balanced").alias("temperature"),
        F.when(repetition < 0.3, "low").when(repetition < 0.5, "moderate").otherwise("high").alias("repetition"),
        F.when(coherence > 0.7, "high").when(coherence > 0.5, "moderate").otherwise("low").alias("coherence"),
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones for the same seed: those whose md5 of seed and key comes first."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, n; the last bin is closed. Bins without rows are there with 0."""
    x = F.col(column).cast("double")
    df = saved(df.select(x.alias("x")).where(x.isNotNull()))
    x = F.col("x")
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((x - F.col("lo")) / width))).cast("long")
    counted = df.join(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row of edges
    every = edges.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density(df: DataFrame, columns: list[str], points: int = 200, cells: int = 2000) -> DataFrame:
    """parameter, point (from 0), x, density: Gaussian kernel estimates of some columns, from the least value to the largest, with Scott's
    bandwidth (the deviation of n - 1 times n to the power of -1/5).

    Binned: a value's weight is shared by the two nodes of a grid of ``cells`` cells that it lies between (a value on a node is that node's). Weights
    are sums that merge before they are shuffled, at most cells + 1 for a column; kernels are summed over the grid only. Values on nodes give the
    estimate itself, others one that is off by the order of (cell / bandwidth)^2. A column of one value (no spread) or none gives no curve; nulls and NaN are no values."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "parameter", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    tall = saved(tall.groupBy("parameter", "v").agg(F.count("*").alias("w")))
    mean = tall.groupBy("parameter").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
    # a row for each of the columns named
    near = tall.join(F.broadcast(mean), "parameter")
    spread = near.groupBy("parameter", "lo", "hi", "n").agg(F.sqrt(F.sum(F.col("w") * (F.col("v") - F.col("mean")) ** 2) / (F.col("n") - 1)).alias("std")) if columns else near
    shape = spread.where("n > 1 AND std > 0").select("parameter", "lo", "hi", "n", (F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"), ((F.col("hi") - F.col("lo")) / cells).alias("cell"))
    at = (F.col("v") - F.col("lo")) / F.col("cell")
    node = F.when(F.abs(at - F.round(at)) < 1e-9, F.round(at)).otherwise(F.floor(at)).cast("long")
    share = F.when(F.abs(at - F.round(at)) < 1e-9, 0.0).otherwise(at - F.floor(at))
    halves = F.explode(F.array(F.struct(node.alias("node"), (F.col("w") * (1.0 - share)).alias("w")), F.struct((node + 1).alias("node"), (F.col("w") * share).alias("w"))))
    grid = tall.join(F.broadcast(shape), "parameter").select("parameter", "lo", "hi", "n", "bandwidth", "cell", halves.alias("g")).groupBy("parameter", "lo", "hi", "n", "bandwidth", "cell", "g.node").agg(F.sum("g.w").alias("w")).where("w > 0")
    x = F.col("lo") + F.col("point") * ((F.col("hi") - F.col("lo")) / (points - 1))
    curve = grid.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long")))).withColumn("x", x)
    z = (F.col("x") - (F.col("lo") + F.col("node") * F.col("cell"))) / F.col("bandwidth")
    return curve.groupBy("parameter", "point", "x").agg((F.sum(F.col("w") * F.exp(z * z * -0.5)) / (F.first("n") * F.first("bandwidth") * float(math.sqrt(2 * math.pi)))).alias("density"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact quartiles, whisker ends (1.5 times the box) and number of outliers by group. What is needed of df is written once."""
    df = saved(df.select(F.col(key).alias("k"), F.col(value).alias("v")))
    box = quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    few = df.where(F.col("k").isNotNull()).groupBy("k", "v").agg(F.count("v").alias("c"))  # a value's repeats are one row
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    out = few.join(box, "k").groupBy("k", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("outliers"), F.sum("c").alias("n"))
    return out.withColumnRenamed("k", key)


def top_report(df: DataFrame, title: str, by: str, ties: list[str], columns: list[str], n: int = 10, text: str | None = None, most: int = 2000) -> str:
    """A Markdown report of the n best rows."""
    rows = top(df, by, n, ties).select(*dict.fromkeys([*ties, *columns, by, *([text] if text else [])])).collect()
    out = [f"# {title}", ""]
    for k, row in enumerate(rows, 1):
        out += [f"## {k}. {by} {row[by]:.4f}", ""]
        out += [f"- **{c}**: {row[c]:.4f}" if isinstance(row[c], float) else f"- **{c}**: {row[c]}" for c in [*ties, *columns]]
        if text and row[text]:
            out += ["", "> " + row[text][:most].replace("\n", "\n> ")]
        out.append("")
    return "\n".join(out)

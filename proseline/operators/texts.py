"""The analyses' reports as Markdown: the best configurations of a response table, and the best trials of a sweep.

What is rendered is a bounded result: one aggregation with a first response for each group and its k best rows, or one line of totals and
the n best trials (with their prompts). The scored input is read once for either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.functions.score import combo_score
from proseline.functions.text import strip
from proseline.sources.scratch import saved

from .reports import CONFIG_KEYS, interpretation, top, varied_keys

MEANS = ("quality_score", "repetition_penalty", "coherence_score", "readability_score", "response_length")
#: Digits after the point of each configuration key.
PLACES = {"temperature": 2, "min_p": 3, "adaptive_target": 2, "top_nsigma": 1}
TRIAL_SCORES = ("overall_score", "coherence_score", "readability_score", "lazy_score", "repetition_penalty", "prose_penalty", "sentence_start_monotony", "word_frequency_spike", "telling_verb_density")
WORDS = {
    "creative": "warm sampling: varied output", "focused": "cool sampling: focused output", "balanced": "warm sampling: varied output",
    "repetition low": "little repetition", "repetition moderate": "some repetition", "repetition high": "much repetition; change the parameters",
    "coherence high": "sentences hang together", "coherence moderate": "mostly coherent", "coherence low": "sentences fall apart in places",
}


def best_groups(df: DataFrame, keys: list[str], response: str, order: str, k: int) -> DataFrame:
    """The k best configurations with their means, number of rows and first response (by ``order``); one shuffle of partial aggregates, of which
    a group's state is one response."""
    rows = df.dropna(subset=keys).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in MEANS], F.count("*").alias("n"), F.min_by(F.substring(response, 1, 201), order).alias("sample"))
    rows = rows.withColumn("overall_score", combo_score(*[F.col(m) for m in MEANS[:1]], F.col("repetition_penalty"), F.col("coherence_score"), F.col("readability_score")))
    words = interpretation(F.col("temperature"), F.col("repetition_penalty"), F.col("coherence_score"))
    return top(rows, "overall_score", k, keys).withColumn("words", words)


def configuration_report(df: DataFrame, *, keys: list[str] | None = None, response: str = "response", order: str = "id", k: int = 10, decay: float = 0.9) -> str:
    """The k best configurations: parameters, means, the first response's first 200 characters, what the means say, and what to start from.

    df: the keys, the means' columns, the response and a column that orders responses. Rows with a null key are left out."""
    keys = keys or varied_keys(df)
    rows = best_groups(df, keys, response, order, k).collect()
    out = ["# Best configurations", "", f"The {len(rows)} configurations with the highest combined score.", "", "Combined score: 0.4 quality + 0.3 (1 - repetition) + 0.2 coherence + 0.1 readability, of a configuration's means.", ""]
    for rank, r in enumerate(rows, 1):
        out += [f"## Rank {rank}", "", *[f"- {key}: `{r[key]:.{PLACES.get(key, 3)}f}`" for key in keys], f"- adaptive_decay: `{decay}` (fixed)", ""]
        out += [f"- combined score: **{r['overall_score']:.3f}**", *[f"- {m}: {r[m]:.3f}" for m in MEANS[:4]], f"- mean response length: {r['response_length']:.1f} characters", f"- responses: {r['n']}", ""]
        if r["sample"]:
            out += ["```", r["sample"][:200] + ("..." if len(r["sample"]) > 200 else ""), "```", ""]
        w = r["words"]
        out += [f"- {WORDS[w['temperature']]}", f"- {WORDS['repetition ' + w['repetition']]}", f"- {WORDS['coherence ' + w['coherence']]}", ""]
    if rows:
        best = rows[0]
        start = ", ".join(f'"{key}": {best[key]:.{PLACES.get(key, 3)}f}' for key in CONFIG_KEYS)
        out += ["## To start from", "", "```json", f'{{{start}, "adaptive_decay": {decay}}}', "```", ""]
    else:
        out += ["No configuration has a response.", ""]
    return "\n".join(out)


def _number(x, places: int) -> str:
    return "N/A" if x is None else f"{x:.{places}f}" if isinstance(x, float) else str(x)


def sweep_report(frame: DataFrame, parameters: list[str], *, responses: DataFrame | None = None, model: str = "", prompts: int = 0, mode: str = "all", samples: int = 3, n: int = 10) -> str:
    """The n best trials of a sweep: totals, a table to compare, and a part for each with its parameters, scores, prompts, patterns and texts.

    frame: completed trials as ``sweep.trials_frame`` has them (lazy_patterns_found is optional: an array of pattern and n). responses: trial, prompt,
    text and, as far as known, quality_score, lazy_score, prose_penalty, repetition_penalty and lint_score; only those of the n trials are fetched."""
    wanted = ["trial", *TRIAL_SCORES, "num_prompts_evaluated", "score_variance", "score_min", "lazy_pattern_count", "response_text", *parameters, *[c for c in ("lazy_patterns_found",) if c in frame.columns]]
    have = {c.lower() for c in frame.columns}
    frame = saved(frame.select(*[F.col(c) if c.lower() in have else F.lit(None).cast("double").alias(c) for c in dict.fromkeys(wanted)]))
    totals = frame.agg(F.count("*").alias("n"), F.min("overall_score").alias("low"), F.max("overall_score").alias("high"), F.avg("overall_score").alias("mean")).first()
    if not totals["n"]:
        return "# Sweep results\n\nNo completed trials.\n"
    rows = top(frame, "overall_score", n, ["trial"]).collect()
    by_trial: dict = {}
    if responses is not None:
        columns = [F.col(c) if c in responses.columns else F.lit(None).cast("double").alias(c) for c in ("quality_score", "lazy_score", "prose_penalty", "repetition_penalty", "lint_score")]
        for r in responses.where(F.col("trial").isin([r["trial"] for r in rows])).select("trial", "prompt", F.substring(strip(F.col("text")), 1, 2000).alias("text"), *columns).collect():
            by_trial.setdefault(r["trial"], []).append(r)
    several = any((r["num_prompts_evaluated"] or 1) > 1 for r in rows)
    out = [f"# The {len(rows)} best trials of a sweep", "", f"- model: {model}", f"- trials: {totals['n']}", f"- prompts: {prompts}, mode {mode}" + (f" ({samples} a trial)" if mode == "sample" else "")]
    out += [f"- scores: {totals['low']:.3f} to {totals['high']:.3f}, mean {totals['mean']:.3f}", f"- parameters: {', '.join(parameters)}", ""]
    head = ["rank", "trial", "score", *parameters, "lazy", "prose", "repetition", *(["variance", "least"] if several else [])]
    out += ["| " + " | ".join(head) + " |", "|" + "---:|" * len(head)]
    for rank, r in enumerate(rows, 1):
        cells = [str(rank), f"#{r['trial']}", f"{r['overall_score']:.3f}", *[_number(r[p], 2) for p in parameters], *[_number(r[c], 2) for c in ("lazy_score", "prose_penalty", "repetition_penalty")]]
        out.append("| " + " | ".join([*cells, *([_number(r[c], 3) for c in ("score_variance", "score_min")] if several else [])]) + " |")
    for rank, r in enumerate(rows, 1):
        out += ["", f"## {rank}. Trial {r['trial']}, score {r['overall_score']:.3f}", "", "| parameter | value |", "|---|---|", *[f"| {p} | {_number(r[p], 4)} |" for p in parameters], ""]
        out += ["| metric | value |", "|---|---|", *[f"| {c} | {_number(r[c], 3)} |" for c in TRIAL_SCORES], ""]
        own = sorted(by_trial.get(r["trial"], []), key=lambda x: (-(x["quality_score"] or 0.0), x["prompt"]))
        if len(own) > 1:
            out += ["| prompt | score | lazy | prose | repetition | lint |", "|---|---:|---:|---:|---:|---:|"]
            out += [f"| {x['prompt']} | {x['quality_score'] or 0:.3f} | {x['lazy_score'] or 0:.2f} | {x['prose_penalty'] or 0:.2f} | {x['repetition_penalty'] or 0:.2f} | {50 if x['lint_score'] is None else x['lint_score']:.0f} |" for x in own]
            out += ["", f"Variance over prompts {r['score_variance'] or 0:.4f}, worst {r['score_min'] or 0:.3f}.", ""]
        hits = r["lazy_patterns_found"] if "lazy_patterns_found" in r else None
        if hits and (r["lazy_pattern_count"] or 0) > 0:
            out += [f"Stock phrases ({int(r['lazy_pattern_count'])} hits): " + ", ".join(f"{h['pattern']} ({h['n']}x)" for h in hits[:10]), ""]
        texts = [(f"**{x['prompt']}** (score {x['quality_score'] or 0:.3f})", x["text"]) for x in own] if len(own) > 1 else [("", own[0]["text"] if own else r["response_text"])]
        for title, text in texts:
            out += [*([title, ""] if title else []), *(["```", text, "```", ""] if text else ["(no text)", ""])]
    return "\n".join(out) + "\n"

"""The two-phase budget of a study as a ledger over its recorded trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseline.sources.scratch import saved

from .ordered import numbered


def ledger(trials: DataFrame, total: int, startup: int, prompts: int, again: int = 3) -> DataFrame:
    """trial, place, phase, original_trial, original_value, change, left: what each recorded trial was, in the order of the trials.

    The first ``startup`` trials see one prompt each (phase startup). If trials see more prompts than one, the ``again`` best completed ones among
    them (by value, the earlier one of ties) are queued again and come first in the second phase (phase revalidation; original_trial and
    original_value tell of which one, change by how much the new value differs, null if it was not completed). Then come the others of the
    second phase (search), as many as ``total`` less the startup ones; those past the budget are of phase over. left: how many trials of
    the budget, revalidations included, were left after it. With one prompt a trial, or no startup trials, all are of one phase (search).

    trials: trial, state, value. Null trials are passed over; of trials that repeat each is one. The order is found in ranges
    (``ordered.numbered``); only the startup trials and those queued again meet in one place."""
    rows = saved(numbered(trials.where("trial IS NOT NULL").select("trial", "state", F.col("value").cast("double").alias("value")), ["trial", "state", "value"]).withColumnRenamed("i", "place"))
    startup = startup if prompts > 1 else 0
    first = rows.where((F.col("place") <= startup) & (F.col("state") == "COMPLETE") & F.col("value").isNotNull()).orderBy(F.col("value").desc(), "trial", "place").limit(again)
    queue = first.select(F.col("trial").alias("original_trial"), F.col("value").alias("original_value"), (startup + F.row_number().over(Window.orderBy(F.col("value").desc(), "trial", "place"))).cast("long").alias("queued"))
    reach = rows.agg(F.max("place").alias("most")).first()["most"] or 0
    # a phase that has not ended has queued nothing
    queue = saved(queue if reach >= startup else queue.limit(0))
    n = queue.count()  # at most ``again``
    joined = rows.join(F.broadcast(queue), F.col("place") == F.col("queued"), "left")
    phase = F.when(F.col("place") <= startup, "startup").when(F.col("queued").isNotNull(), "revalidation").when(F.col("place") <= total + n, "search").otherwise("over")
    change = F.when(F.col("state") == "COMPLETE", F.col("value") - F.col("original_value"))
    return joined.select("trial", "place", phase.alias("phase"), "original_trial", "original_value", change.alias("change"), F.greatest(F.lit(0).cast("long"), total + n - F.col("place")).alias("left"))

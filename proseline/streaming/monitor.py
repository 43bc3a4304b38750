"""A live study: the best value so far and the number of pruned trials, every few trials, from a stream of trials."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["proseline"])

PROGRESS = "study string, trial long, n long, best double, pruned long"


def live_progress(trials: DataFrame, every: int = 5) -> DataFrame:
    """(study, trial, n, best, pruned) after every so many trials of a study, as ``sweep.progress`` has it for a recorded one.

    trials: a stream of study, trial, state, value, with a study's trials in order from one micro-batch to the next (within one they are
    sorted). Kept of a study are three numbers; a micro-batch's trials of one study are one task's. Rows without a trial are passed over."""

    def step(key: tuple, parts, state):
        n, best, pruned = state.get if state.exists else (0, None, 0)
        rows = pd.concat([p for p in parts], ignore_index=True).dropna(subset=["trial"]).sort_values("trial", kind="stable")
        out = []
        for trial, kind, value in zip(rows["trial"], rows["state"], rows["value"], strict=True):
            n += 1
            pruned += kind == "PRUNED"
            if kind == "COMPLETE" and value == value:
                best = value if best is None else max(best, value)
            if n % every == 0:
                out.append((key[0], int(trial), n, best, pruned))
        state.update((n, best, int(pruned)))
        yield pd.DataFrame(out, columns=["study", "trial", "n", "best", "pruned"]).astype({"study": object, "trial": "int64", "n": "int64", "best": "float64", "pruned": "int64"})

    return trials.groupBy("study").applyInPandasWithState(step, PROGRESS, "n long, best double, pruned long", "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a query that writes each micro-batch to a folder of its own number, over what an interrupted run of the same micro-batch left:
    whatever is replayed after a restart, each row is there once. Read the path with Spark (batch is a column)."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

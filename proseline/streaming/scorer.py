"""EXTENSION: scoring a stream of texts. The scorer is row-local, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.functions.score import score


def windowed_quality(stream: DataFrame, *, text: str = "text", time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean quality and number of texts in windows of event time; texts that come later than ``late`` are not counted."""
    scored = score(stream.withWatermark(time, late), text).select(time, "quality_score")
    return scored.groupBy(F.window(time, width)).agg(F.avg("quality_score").alias("avg_quality_score"), F.count("*").alias("n")).select("window.start", "window.end", "avg_quality_score", "n")

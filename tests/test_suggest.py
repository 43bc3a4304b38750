"""Suggestions: what is good rises, and edges are defined."""

import pytest

from proseline.operators.suggest import suggest


def test_gain_rises_where_good_trials_are(spark):
    trials = spark.createDataFrame([(k, "COMPLETE", 1.0 - abs((k % 50) / 50 - 0.7), (k % 50) / 50, 3.0) for k in range(400)] + [(900, "PRUNED", 9.0, 0.0, 3.0), (901, "COMPLETE", None, 0.0, 3.0), (902, "COMPLETE", 9.0, None, 3.0)], "trial long, state string, value double, a double, b double")
    asked = spark.createDataFrame([(0.7, 3.0), (0.2, 3.0), (0.701, 3.0), (None, 3.0), (5.0, 3.0)], "a double, b double")
    got = [r["gain"] for r in suggest(trials, asked, ["a", "b"]).collect()]
    assert got[0] > 0 > got[1] and got[2] == pytest.approx(got[0], abs=0.05) and got[3] is got[4] is None
    none = suggest(trials.limit(0), asked, ["a", "b"]).collect()
    assert [r["gain"] for r in none] == [0.0, 0.0, 0.0, None, 0.0]
    assert suggest(trials, asked.limit(0), ["a"]).count() == 0
    one = suggest(trials.where("trial = 1"), asked, ["a"]).collect()
    assert one[0]["gain"] == 0.0

"""Order statistics and folds against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseline.operators import ordered
from proseline.operators.ordered import first_stop, quantiles, running_medians
from proseline.operators.sweep import convergence, median_prune

SHARES = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "z": 1.0}


@pytest.mark.parametrize("small", [65_536, 3])
def test_quantiles(spark, monkeypatch, small):
    """small: so few distinct values that all rounds are gone through."""
    monkeypatch.setattr(ordered, "SMALL", small)
    rng = random.Random(small)
    groups = {"one": [5.0], "ties": [1.0] * 50 + [2.0] * 7, "none": [None, float("nan")], None: [rng.gauss(0, 1) for _ in range(40)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(101)] + [0.0, -0.0, float("inf")], "near": [1 + k * 2.0**-52 for k in range(30)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", SHARES).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, r in got.items():
        values = sorted(v for v in groups[g] if v is not None and v == v)
        assert r["n"] == len(values)
        for name, share in SHARES.items():
            place = (len(values) - 1) * share
            low, high = values[int(np.floor(place))], values[int(np.ceil(place))]
            want = low + (high - low) * (place - np.floor(place))
            assert r[name] == want or (np.isnan(r[name]) and np.isnan(want)), (g, name, r[name], want)
    whole = quantiles(df.where("g = 'ties'"), [], "v", {"m": 0.5}).collect()
    assert [tuple(r) for r in whole] == [(1.0, 57)]
    assert quantiles(df.where("g = 'none'"), [], "v", {"m": 0.5}).count() == quantiles(df.limit(0), ["g"], "v", SHARES).count() == 0


def plain_medians(rows, startup):
    out = {}
    for s, t in {(s, t) for s, t, _ in rows if s is not None and t is not None}:
        v = [x for s2, t2, x in rows if s2 == s and t2 is not None and t2 < t and x is not None]
        if len(v) >= startup:
            out[s, t] = (len(v), float(np.median(v)))
    return out


@pytest.mark.parametrize(("seed", "blocks"), [(1, 512), (2, 2), (3, 7), (4, 20)])
def test_running_medians(spark, monkeypatch, seed, blocks):
    """Ties, trends, gaps and repeated trials, with few and many blocks."""
    monkeypatch.setattr(ordered, "BLOCKS", blocks)
    monkeypatch.setattr(ordered.F, "sqrt", (lambda c, f=F.sqrt: f(c) * 100)) if blocks < 512 else None
    rng, rows = random.Random(seed), []
    for s in range(3):
        for t in range(0, 240, rng.choice([1, 2])):
            for _ in range(rng.choice([1, 1, 1, 3])):
                v = rng.choice([None, 0.5, 0.5, round(rng.gauss(t / 50 * (s - 1), 1), 1), rng.random()])
                rows.append((s, t, v))
    rows += [(None, 1, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "step int, trial long, value double").repartition(4)
    got = {(r["step"], r["trial"]): (r["n"], r["median"]) for r in running_medians(df, 3).collect()}
    want = plain_medians(rows, 3)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_running_medians_without_rows(spark):
    none = spark.createDataFrame([], "step int, trial long, value double")
    assert running_medians(none, 1).count() == 0
    assert running_medians(spark.createDataFrame([(1, 1, None)], none.schema), 0).count() == 0
    assert median_prune(spark.createDataFrame([], "trial long, step int, value double, state string")).count() == 0


def plain_stop(rows, patience, delta):
    seen = best = None
    done = total = 0
    for trial, complete, value in sorted(rows, key=lambda r: (r[0], not r[1], r[2] is not None, r[2] or 0)):
        if complete and value is not None:
            seen = value if seen is None else max(seen, value)
        better = complete and (best is None or seen > best + delta)
        done, total = (0, 0) if better else (done + complete, total + 1)
        best = seen if better else best
        if done >= patience or total >= 2 * patience:
            return trial, best
    return None, best


@pytest.mark.parametrize("seed", range(8))
def test_fold(spark, monkeypatch, seed):
    """Random studies, rising ones, and ones that end before they stop, in blocks of a few rows."""
    monkeypatch.setattr(ordered, "FOLD_ROWS", random.Random(seed).choice([5, 11, 30]))
    rng = random.Random(seed)
    rise, patience = rng.choice([0.0, 0.002, 0.01]), rng.choice([1, 2, 5])
    rows = [(k // rng.choice([1, 1, 2]), rng.random() < rng.choice([0.9, 0.3]), None if rng.random() < 0.1 else rise * k + rng.choice([0.1, 0.5]) * rng.random()) for k in range(rng.choice([0, 1, 40, 400]))]
    df = spark.createDataFrame(rows, "trial long, complete boolean, value double").repartition(3)
    stop, best = first_stop(df, patience, 0.01)
    assert (None if stop is None else int(stop), best) == plain_stop(rows, patience, 0.01)


def test_fold_over_many_blocks(spark, monkeypatch):
    """Blocks in groups of 64, twice over."""
    monkeypatch.setattr(ordered, "FOLD_ROWS", 3)
    rows = [(k, k % 3 != 1, k * 0.1 if k < 13_000 else 0.0) for k in range(13_500)]
    df = spark.createDataFrame(rows, "trial long, complete boolean, value double")
    assert first_stop(df.where("trial < 900"), 1, 0.01) == (None, pytest.approx(89.9))
    states = df.selectExpr("trial", "IF(complete, 'COMPLETE', 'PRUNED') AS state", "value")
    assert tuple(convergence(states, 4, 0.01).first()) == plain_stop(rows, 4, 0.01)

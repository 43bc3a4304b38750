import random

import numpy as np
import pytest

from proseline.llm import hardneg, sql
from proseline.llm.hardneg import Bounds, Best, brute_force, codebooks, encode, exact, op12_hard_negatives

from ..conftest import compare
from .helpers import folder

KIND = "vec_id long, embedding array<float>, label int, row string"


def run(spark, tmp_path, rows):
    made = spark.createDataFrame([(i, v, label, "x") for i, label, v in rows], KIND).repartition(3)
    got = op12_hard_negatives(spark, folder(spark, tmp_path, embeddings=made))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_against_sql(spark):
    compare(spark, "op12", op12_hard_negatives, sql.OP12)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    out = []
    for i in range(420):
        v = centres[rng.integers(6)] + 0.4 * rng.normal(size=12)
        out.append((i, int(rng.integers(4)), np.float32(v / np.sqrt((v * v).sum())).tolist()))
    return out


def test_brute_force(spark, tmp_path, rows):
    want = sorted(brute_force(rows), key=str)
    assert len(want) > 50
    assert run(spark, tmp_path, rows) == want


def test_rounds(spark, tmp_path, rows, monkeypatch):
    """Several rounds of anchors, small blocks."""
    monkeypatch.setattr(hardneg, "ROUND_BYTES", 300)
    monkeypatch.setattr(hardneg, "ROWS", 50)
    monkeypatch.setattr(hardneg, "TILE", 2)
    assert run(spark, tmp_path, rows) == sorted(brute_force(rows), key=str)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        n = rng.choice([3, 3, 3, 2])
        rows.append((rng.choice([i, i, i // 2, None, 50 * (i // 20)]), rng.choice([0, 1, 1, None, 9]), [rng.choice([0.0, 0.5, 1.0, -0.25]) for _ in range(n)]))
    rows += [(50, 1, None), (100, 1, []), (150, 1, []), (200, 1, [float("nan"), 1.0, 1.0]), (250, 1, [float("inf"), 1.0, 1.0]), (300, 1, [None, 1.0, 1.0]), (350, 1, [3e30, 1.0, 2e30]), (351, 1, [3e30, 1.0, 0.0]), (353, 0, [1.0, 1.0, 1.0])]
    got, want = run(spark, tmp_path, rows), sorted(brute_force(rows), key=str)
    clip = lambda x: x if x is None else max(-(2**63), min(2**63 - 1, x))
    small = [r for r in want if all(clip(x) == x for x in r)]
    assert [r for r in got if r[0] != 350 and r[1] not in (350, 351)] == [r for r in small if r[0] != 350 and r[1] not in (350, 351)]
    assert len(small) > 40


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(1, 1, [1.0])]) == []
    assert run(spark, tmp_path, [(50, 1, [1.0])]) == []


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(5000, 10)))
    books = codebooks(x[:2000])
    codes, missed = encode(x, books)
    a = x[:40]
    low, high = Bounds(a, books).of(codes, missed, np.sqrt((x * x).sum(1)))
    score = a @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high - low).mean() < 0.6 * (2 * np.sqrt((a * a).sum(1))[:, None] * np.sqrt((x * x).sum(1))).mean()


def test_best_ties_and_large_scores():
    best = Best(2)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 7, 7, 1]), np.array([1, 3, 2, 9]), np.zeros(4, bool))
    best.add(np.array([0]), np.array([7]), np.array([1]), np.array([False]))
    assert best.kept[0].tolist() == [0, 0, 1] and best.kept[2].tolist() == [1, 2, 9]
    assert best.least(np.arange(3)).tolist() == [7, -np.inf, -np.inf]
    big = np.array([[2.0**60, 1.0]])
    assert exact(big, np.array([[1.0, 1.0], [2.0**60, 0.0]]), np.array([0, 0]), np.array([0, 1])).tolist() == [2**60 + 1, 2**63 - 1]


def test_adding_sorts_only_the_lists_added_to(monkeypatch):
    """A block's work doesn't grow with the number of anchors that other blocks have (all lists were sorted anew before)."""
    best, sizes, sort = Best(3), [], np.lexsort
    own = np.repeat(np.arange(5000), 3)
    best.add(own, np.tile([9, 8, 7], 5000), np.arange(15000), np.zeros(15000, bool))
    monkeypatch.setattr(hardneg.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    best.add(np.array([17, 17, 40]), np.array([10, 8, 1]), np.array([1, 2, 3]), np.zeros(3, bool))
    assert sum(sizes) <= 9
    assert best.least(np.array([16, 17, 40])).tolist() == [7, 8, 7]
    assert best.kept[2][17 * 3 : 18 * 3].tolist() == [1, 51, 2]


def test_one_row_group_is_many_tasks(spark, tmp_path, monkeypatch):
    """Rows of a file with one row group are dealt out, so that the scans are not one task."""
    monkeypatch.setattr(hardneg, "SPREAD", 500)
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(3)), rng.normal(size=3).tolist()) for i in range(2000)]
    made = spark.createDataFrame([(i, v, label, "x") for i, label, v in rows], KIND).coalesce(1)
    kept = []
    plain = hardneg.prepared
    monkeypatch.setattr(hardneg, "prepared", lambda df, *rest: kept.append(df.rdd.getNumPartitions()) or plain(df, *rest))
    got = op12_hard_negatives(spark, folder(spark, tmp_path, embeddings=made))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute_force([(i, label, np.float32(v).tolist()) for i, label, v in rows]), key=str)
    assert kept == [4]

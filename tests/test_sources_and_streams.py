"""JSON arrays in many splits, a live study with a restart, and the two-phase ledger."""

import json
import random

import pytest
from pyspark.sql import functions as F

from proseline.operators.schedule import ledger
from proseline.operators.sweep import progress
from proseline.sources.arrays import _Elements, array_elements, read_arrays, structure
from proseline.streaming.monitor import live_progress, write_once

ODD = [{"a": 1, "s": 'x,]}"\\", [', "t": [1, [2, {"u": ","}], "]"]}, {"a": 2, "s": "\\\\", "t": []}, {"a": None, "s": "é,😀", "t": ["{"]}, {"a": 4, "s": ",,,", "t": None}, {"s": ""}]
KIND = "a long, s string, t string"


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_every_border(tmp_path):
    """A file cut at every comma, in every pair of places: the pieces make its elements."""
    text = ("\n" + json.dumps(ODD, ensure_ascii=False, indent=1) + "\n,").encode()
    commas = [k + 1 for k, c in enumerate(text) if c == ord(",")]
    for i in commas:
        for j in [k for k in commas if k > i]:
            found, open_, inside, depth = [], b"", 0, 0
            for a, b in ((0, i), (i, j), (j, len(text))):
                e = _Elements(inside, depth)
                for kind, piece in [*e.take(text[a:b]), *e.end()]:
                    if kind in ("tail", "middle"):
                        open_ += piece
                    else:
                        found.append(open_ + piece if kind == "head" else piece)
                        open_ = b"" if kind == "head" else open_
                inside, depth = e.inside, e.depth
            assert [json.loads(x) for x in found] == ODD, (i, j)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 50, 1000])
def test_splits(spark, tmp_path, size):
    """Splits of a few bytes each, several files, and files without elements."""
    write(tmp_path / "in", "a.json", json.dumps(ODD, ensure_ascii=False))
    write(tmp_path / "in", "b.json", json.dumps(ODD, indent=2))
    write(tmp_path / "in", "c.json", "[]")
    write(tmp_path / "in", "d.json", " [ ] \n")
    write(tmp_path / "in", "e.json", "")
    write(tmp_path / "in", "f.json", '[3, "a,b", null, [1, 2]]')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {}
        for r in array_elements(spark, str(tmp_path / "in")).collect():
            got.setdefault(r["path"][-6:], []).append(json.loads(r["text"]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert {k: sorted(map(key, v)) for k, v in got.items()} == {k: sorted(map(key, v)) for k, v in {"a.json": ODD, "b.json": ODD, "f.json": [3, "a,b", None, [1, 2]]}.items()}


def test_large_array_in_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"a": k, "s": rng.choice(["x", 'q"', "\\", ",", "]"]) * rng.randint(0, 90)} for k in range(30_000)]
    write(tmp_path / "in", "a.json", json.dumps(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
        df = read_arrays(spark, str(tmp_path / "in"), KIND)
        assert df.rdd.getNumPartitions() > 20
        assert sorted((r["a"], r["s"]) for r in df.collect()) == [(r["a"], r["s"]) for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_structure_of_quotes():
    import numpy as np

    outside, _, level, inside = structure(np.frombuffer(b'{"a\\\\":"\\"{"}', np.uint8), 0, 0)
    assert level[-1] == 0 and inside == 0 and outside[0] and outside[-1] and not outside[2]


def plain_progress(rows, every):
    out, best, pruned = [], None, 0
    for n, (_, trial, state, value) in enumerate(rows, 1):
        pruned += state == "PRUNED"
        if state == "COMPLETE" and value is not None:
            best = value if best is None else max(best, value)
        if n % every == 0:
            out.append((trial, best, pruned))
    return out


def test_live_progress_with_a_restart(spark, tmp_path):
    """Trials arrive in files, the query stops in the middle and goes on, and a micro-batch is written again: all rows are there once."""
    rng = random.Random(2)
    rows = [("s", k, rng.choice(["COMPLETE", "COMPLETE", "PRUNED", "FAIL"]), rng.choice([None, rng.random(), rng.random()])) for k in range(57)]
    kind = "study string, trial long, state string, value double"
    source = tmp_path / "in"
    for k in range(0, 57, 10):
        spark.createDataFrame([*rows[k : k + 10], ("other", k, "COMPLETE", 1.0)], kind).coalesce(1).write.mode("append").parquet(str(source))
        if k in (20, 50):
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
            query = write_once(live_progress(stream, 5), str(tmp_path / "out"), str(tmp_path / "check"))
            assert query.awaitTermination(240)
    # the last micro-batch's commit is lost, as if the run had died after writing: it is done again
    commits = sorted((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "check" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    assert write_once(live_progress(stream, 5), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(240)
    got = sorted((r["trial"], r["best"], r["pruned"]) for r in spark.read.parquet(str(tmp_path / "out")).where("study = 's'").collect())
    assert got == plain_progress(rows, 5)
    table = spark.createDataFrame(rows, kind)
    assert sorted(tuple(r) for r in progress(table, 5).select("trial", "best", "pruned").collect()) == got


def test_ledger(spark):
    trials = [(k, "COMPLETE" if k % 4 else "PRUNED", float(v)) for k, v in enumerate([9, 1, 5, 5, 9, 3, 8, 2, 2, 2])]
    df = spark.createDataFrame(trials, "trial long, state string, value double")
    got = [tuple(r)[1:] for r in ledger(df, 7, 5, 3, again=2).orderBy("place").collect()]
    assert got == [
        (1, "startup", None, None, None, 8), (2, "startup", None, None, None, 7), (3, "startup", None, None, None, 6), (4, "startup", None, None, None, 5), (5, "startup", None, None, None, 4),
        (6, "revalidation", 2, 5.0, -2.0, 3), (7, "revalidation", 3, 5.0, 3.0, 2), (8, "search", None, None, None, 1), (9, "search", None, None, None, 0), (10, "over", None, None, None, 0),
    ]
    assert {r["phase"] for r in ledger(df, 20, 5, 1).collect()} == {"search"}
    assert [r["phase"] for r in ledger(df.where("trial < 3"), 20, 5, 3).collect()] == ["startup"] * 3
    assert ledger(df.limit(0), 20, 5, 3).count() == 0
    assert ledger(df.withColumn("trial", F.lit(None).cast("long")), 20, 5, 3).count() == 0

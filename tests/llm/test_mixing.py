import re
from collections import defaultdict

import pytest

from proseline.llm import mixing
from proseline.llm.mixing import mix, op3_mixing
from tests.llm.helpers import docs, real


def brute_targets(sizes, weights=(3, 1, 2)):
    """Iterated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        left = total - sum(out[s] for s in names if s not in open_)
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def check(rows, words):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    want = brute_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sum(x["size"] for x in rs) for r in rs)
        assert all(0 <= r["copies"] <= 2 for r in rs)
        taken = sum(r["size"] * r["copies"] for r in rs)
        assert abs(taken - want[s]) <= max(r["size"] for r in rs)


def test_real_documents(spark):
    rows = mix(real(spark, "documents")).collect()
    check(rows, None)
    texts = {r["doc_id"]: r["text"] for r in real(spark, "documents").collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in rows)
    again = {tuple(r) for r in mix(real(spark, "documents").repartition(7)).collect()}
    assert again == {tuple(r) for r in rows}


def test_edges(spark):
    texts = [None, "", " \n ", "a b", "a b", "w " * 5000, "é ü x", *["one two three"] * 40]
    df = docs(spark, texts)
    df = df.withColumn("source", df["source"].substr(1, 0)).unionByName(df).unionByName(df.limit(3).selectExpr("doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "n_chars"))
    rows = mix(df).collect()
    assert len(rows) == 2 * len(texts) + 3
    check(rows, None)
    assert mix(df.limit(0)).count() == 0
    assert {r["copies"] for r in mix(docs(spark, [None, ""])).collect()} == {0}
    assert sorted(r["size"] for r in mix(docs(spark, ["a b c"])).collect()) == [2]


def test_expected_copies(spark):
    """Over seeds, documents are taken as often as their rate says."""
    df = docs(spark, [f"{'w ' * (i + 1)}" for i in range(12)]).selectExpr("doc_id", "text", "'s' AS source").unionByName(docs(spark, ["v " * 400]).selectExpr("100 AS doc_id", "text", "'t' AS source"))
    total = defaultdict(float)
    for seed in range(30):
        for r in mix(df, seed=seed).collect():
            total[r["doc_id"]] += r["copies"] / 30
            rate = r["target"] / r["source_size"]
            if r["source"] == "s":
                assert abs(total[r["doc_id"]] * 30 / (seed + 1) - rate) <= 1
    assert all(0.5 <= v <= 2.0 for k, v in total.items() if k < 12)


def test_native(spark):
    plan = op3_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("total", [1.25, 1.75])
def test_equal_documents_have_equal_rates(spark, total):
    """400 sources of one layout, a long document and fifteen equal short ones: each place in it is taken at its rate."""
    df = spark.range(6400).selectExpr("id AS doc_id", "repeat('w ', IF(id % 16 = 0, 400, 30)) AS text", "CAST(id DIV 16 AS STRING) AS source")
    got = defaultdict(list)
    for r in mix(df, weights=(1,), total=total).collect():
        got[r["doc_id"] % 16].append(r["copies"])
    bound = 4 * (0.25 * 0.75 / 400) ** 0.5
    assert all(len(v) == 400 and abs(sum(v) / 400 - total) < bound for v in got.values()), {k: sum(v) / 400 for k, v in got.items()}


def test_classes_fold_to_small_residuals(spark):
    """A source of many documents of many sizes ends nearer to its target than its longest document is long."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + pow(2, (id * 7919) % 1000 / 100.0D) AS INT)) AS text", "IF(id % 3 = 0, 'a', 'b') AS source")
    rows = mix(df).collect()
    check(rows, None)
    for s in ("a", "b"):
        rs = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in rs) - rs[0]["target"]) < 100


def test_repeats_in_runs(spark, monkeypatch):
    """Rows that repeat often are numbered by many tasks, to the same result."""
    df = docs(spark, ["one two three"] * 90 + ["a b"] * 40 + ["c"] * 4 + [None] * 9).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "'s' AS source")
    df = df.unionByName(docs(spark, ["x y z"] * 8).selectExpr("doc_id % 2 AS doc_id", "text", "'t' AS source"))
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    plain = mix(df).collect()
    check(plain, None)
    assert len(plain) == 151
    monkeypatch.setattr(mixing, "REPEATS", 4)
    assert key(mix(df).collect()) == key(plain)
    counts = df.selectExpr("doc_id", "source", "CAST(length(text) AS LONG) AS size").groupBy("doc_id", "source", "size").count()
    rows = mixing.numbered(counts)
    assert rows.groupBy("doc_id", "source", "size").agg({"dup": "max", "*": "count"}).where("`max(dup)` <> `count(1)`").count() == 0
    assert rows.distinct().count() == rows.count() == 151

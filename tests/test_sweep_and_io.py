import pytest
from pyspark.sql import functions as F

from proseline.operators import reports as R
from proseline.operators import sweep as S
from proseline.sources import io
from proseline.streaming.scorer import windowed_quality


def test_space_and_settings(monkeypatch):
    found = S.parse_space({"a": [0, 10], "b": [0, 1.0], "c": [0, 1, "FLOAT"], "d": [0.0, 5.0, "int"]})
    assert [p.type for p in found] == ["int", "float", "float", "int"]
    with pytest.raises(ValueError):
        S.parse_space({"a": [1]})
    monkeypatch.setenv("X_TRIALS", "7")
    assert S.settings({"trials": 30, "model": "m"}, "X_", {"model": ""}) == {"trials": 7, "model": ""}
    assert S.budget(30, 12, 0, 3) == (12, 21)


def test_prompts(spark):
    known = {f"p{i}": {"text": str(i), "category": "c"} for i in range(5)}
    prompts, mode, k = S.prompt_pool(spark, {"prompts": {"pool": ["p1", "p2"], "custom": [{"messages": [{"role": "user", "content": "hi"}]}], "samples_per_trial": 2}}, known)
    assert {r["id"]: r["format"] for r in prompts.collect()} == {"p1": "completion", "p2": "completion", "custom_2": "chat"}
    trials = spark.range(10).withColumnRenamed("id", "trial")
    picked = S.select_prompts(trials, prompts, mode, k, "s", startup=4).groupBy("trial").count().collect()
    assert {r["trial"]: r["count"] for r in picked} == {i: 1 if i < 4 else 2 for i in range(10)}
    with pytest.raises(ValueError):
        S.prompt_pool(spark, {"prompts": {"pool": ["nope"]}}, known)
    assert S.prompt_pool(spark, {"prompt": "x"}, known)[1:] == ("all", 1)


def trials(spark, rows):
    return spark.createDataFrame(rows, "trial long, state string, value double")


def test_convergence(spark):
    c, p = "COMPLETE", "PRUNED"
    stop = lambda rows, patience: S.convergence(trials(spark, [(i, *r) for i, r in enumerate(rows)]), patience, 0.01).first()
    assert tuple(stop([(c, 0.5), (c, 0.505), (c, 0.4), (c, 0.9)], 2)) == (2, 0.5)
    assert tuple(stop([(c, 0.5), (c, 0.6), (c, 0.7)], 2)) == (None, 0.7)
    assert tuple(stop([(c, 0.5), (p, None), (p, None), (p, None), (p, None)], 2)) == (4, 0.5)
    assert tuple(stop([("FAIL", None)], 2)) == (None, None)


def test_convergence_in_chunks(spark):
    c, p = "COMPLETE", "PRUNED"
    rows = [(c, 0.5), (p, None), (c, 0.505), (c, 0.6), (p, None), (c, 0.4), (c, 0.605), (c, 0.1), (c, 0.9)]
    df = trials(spark, [(i, *r) for i, r in enumerate(rows)])
    for chunk in (1, 2, 4, 100):
        assert tuple(S.convergence(df, 3, 0.01, chunk).first()) == (7, 0.6)
        assert tuple(S.convergence(df, 9, 0.01, chunk).first()) == (None, 0.9)


def test_whole_studies(spark):
    """Queries without SQL go over every trial, over borders of blocks too."""
    from proseline.plans import catalog

    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").selectExpr("o_orderkey", "o_totalprice / 1e6").collect()
    best, pruned, want = None, 0, {}
    for n, (trial, value) in enumerate(sorted(map(tuple, orders)), 1):
        if trial % 4 == 3:
            pruned += 1
        else:
            best = max(value, best or value)
        if n % 5 == 0:
            want[trial] = (round(best, 6), pruned)
    got = {r["trial"]: (r["best"], r["pruned"]) for r in catalog.progress(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
    picked = catalog.select_prompts(spark, "/root/testdata/sf0.01")
    assert picked.select("trial").distinct().count() == len(orders) and picked.count() == 12 + 3 * (len(orders) - 12)


def test_convergence_after_the_first_trials(spark, tmp_path):
    """A stop past the 400th trial, beyond what used to be read."""
    from proseline.plans import catalog

    spark.range(1000).selectExpr("id AS o_orderkey", "CASE WHEN id % 4 = 3 THEN 0 ELSE least(id, 450) * 10000.0 END AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    assert tuple(catalog.convergence(spark, str(tmp_path)).first()) == (484, 4.5)  # the 25th completed trial after 450


def test_prune_revalidate_and_summary(spark):
    steps = spark.createDataFrame([(t, s, float(v), "COMPLETE") for t, v in enumerate([5, 6, 7, 1, 9]) for s in (0, 1)], "trial long, step long, value double, state string")
    got = {(r["trial"], r["step"]): r["prune"] for r in S.median_prune(steps, startup=3, warmup=1).collect()}
    assert got == {(3, 1): True, (4, 1): False}
    frame = S.trials_frame(trials(spark, [(0, "COMPLETE", 0.4), (1, "COMPLETE", 0.9), (2, "PRUNED", 1.0), (3, "COMPLETE", 0.5)]))
    assert [r["trial"] for r in S.revalidation(frame, 3, 2).collect()] == [1, 0]
    assert S.revalidation(frame, 3, 1).count() == 0
    assert S.trial_summary(frame).first()["best_trial"] == 0
    r = spark.range(1).select(S.route_parameters(F.create_map(F.lit("temperature"), F.lit(1.0), F.lit("min_p"), F.lit(0.1)), F.create_map(F.lit("min_p"), F.lit(9.0), F.lit("x"), F.lit(2.0))).alias("r")).first()["r"]
    assert r["native"] == {"temperature": 1.0} and r["extra_body"] == {"min_p": 0.1, "x": 2.0}


def test_trials_frame_columns(spark):
    """Parameters become columns, missing attributes their defaults, and the first response is there."""
    rows = spark.sql("SELECT 1L AS trial, 'COMPLETE' AS state, 0.5D AS value, named_struct('temperature', 1.5D, 'min_p', 0.1D) AS parameters, map('p1', 'first', 'p2', 'second') AS response_texts, 0.25D AS score_min, CAST(NULL AS DOUBLE) AS lint_score")
    r = S.trials_frame(rows).first().asDict()
    want = {"trial": 1, "value": 0.5, "temperature": 1.5, "min_p": 0.1, "response_text": "first", "score_min": 0.25, "lint_score": 50.0, "lint_band": "unknown", "lint_violations": 0.0, "prompt_mode": "single", "num_prompts_evaluated": 1.0}
    assert all(r[k] == v for k, v in want.items()) and len(set(S.TRIAL_DEFAULTS) - set(r)) == 0


def test_objective_prunes(spark):
    text = "The sky was wide and blue over the hills. A small dog ran after the cart, and nobody called it back."
    rows = spark.createDataFrame([(1, text), (1, "short"), (2, " short "), (2, None), (3, text)], "trial long, text string")
    got = {r["trial"]: r for r in S.objective(rows).collect()}
    assert (got[1]["prompts"], got[1]["failed_prompts"], got[1]["state"]) == (2, 1, "COMPLETE") and got[1]["mean_score"] == got[3]["mean_score"] == got[1]["score_min"]
    assert (got[2]["failed_prompts"], got[2]["mean_score"], got[2]["state"]) == (2, None, "PRUNED")
    assert {r["state"] for r in S.objective(rows, floor=0.99).collect()} == {"PRUNED"}


def test_worst_band_quirk_and_correlations(spark):
    df = spark.createDataFrame([(1, 1, "heavy"), (1, 2, "saturated"), (2, 1, "moderate"), (2, 2, "saturated")], "t int, o int, band string")
    got = {r["t"]: (r["worst_band"], r["worst_band_fixed"]) for r in R.worst_band(df, "t", "band", "o").collect()}
    assert got == {1: ("heavy", "saturated"), 2: ("moderate", "saturated")}
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    assert {(r["a"], r["b"]): round(r["r"], 9) for r in R.correlations(df, ["a", "b"]).collect()} == {(x, y): 1.0 for x in "ab" for y in "ab"}
    assert R.varied_keys(df) == R.CONFIG_KEYS
    text = R.top_report(df.withColumn("k", F.col("a").cast("int")), "Best", "a", ["k"], ["b"], n=2)
    assert text.startswith("# Best") and "## 2. a 3.0000" in text


def test_files(spark, tmp_path):
    (tmp_path / "s_1.json").write_text('[{"prompt": "p", "parameters": {"temperature": 1, "min_p": 0.1, "adaptive_target": 0.5, "adaptive_decay": 0.9}, "response": "hi", "success": true}]')
    (tmp_path / "s_2.json").write_text("[]")
    assert io.latest(spark, str(tmp_path / "s_*.json")).endswith("s_2.json")
    with pytest.raises(FileNotFoundError):
        io.latest(spark, str(tmp_path / "no_*.json"))
    rows = R.flatten_parameters(io.read_json_array(spark, str(tmp_path / "s_1.json")))
    assert rows.first()["top_nsigma"] == 1.0
    io.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["response"] == "hi"
    io.write_json(rows, str(tmp_path / "j"))
    assert io.read_json_lines(spark, str(tmp_path / "j"), "response string").first()["response"] == "hi"
    for _ in range(2):
        io.append_trials(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("A day. It rained all the time.", f"2024-01-01 00:0{i}:00") for i in range(8)], "text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_quality(stream).writeStream.outputMode("complete").format("memory").queryName("quality").start()
    try:
        query.processAllAvailable()
        assert sorted(r["n"] for r in spark.table("quality").collect()) == [3, 5]
    finally:
        query.stop()


def test_average_by_trial_list_and_missing_columns(spark):
    hits = lambda *x: [{"pattern": p, "n": n} for p, n in x]
    rows = [("t", 2, 0.5, "saturated", hits(("the", 2), ("the", 2), ("a", 1))), ("t", 1, 0.7, "moderate", hits(("the", 2), ("the", 3))), ("u", 1, 0.1, None, None), (None, 1, 0.2, "heavy", hits(("b", 1)))]
    df = spark.createDataFrame(rows, "trial string, o long, quality_score double, lint_band string, lazy_patterns_found array<struct<pattern:string,n:bigint>>")
    trials = R.average_by_trial(df, order="o")
    got = {r["trial"]: r for r in trials.collect()}
    assert {k: r["lint_band"] for k, r in got.items()} == {"t": "moderate", "u": "unknown", None: "heavy"}
    assert [tuple(x) for x in got["t"]["lazy_patterns_found"]] == [("a", 1, 1), ("the", 2, 3), ("the", 3, 1)]
    assert got["u"]["lazy_patterns_found"] == [] and len(got[None]["lazy_patterns_found"]) == 1
    assert got["t"]["telling_verb_density"] == 0 and got["t"]["response_length"] == 0 and got["t"]["lazy_pattern_count"] == 0
    frequencies = lambda x: sorted(tuple(r)[:3] for r in R.pattern_frequency(x).collect())
    assert frequencies(trials) == frequencies(df) == [("a", 1, 1), ("b", 1, 0), ("the", 9, 1)]  # a null trial is none
    bare = R.average_by_trial(df.drop("lint_band", "lazy_patterns_found")).collect()
    assert all(r["lint_band"] == "unknown" and r["lazy_patterns_found"] == [] for r in bare)

import pytest

from proseline.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import DATA, compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry_point_without_the_llm_folders(tmp_path):
    """In a copy that lacks the training-data operators and their pipeline, the rest imports and its queries run."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")])
    code = "import __spark_entry__ as e; assert 'op1_decontamination' not in e.queries() and 'lint_score' in e.queries() and e.oracle_sql(); from pyspark.sql import SparkSession; assert e.queries()['repetition'](SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(), '/root/testdata/sf0.001').count() == 200"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=240)


def test_full_reports(spark):
    """The reports over all families against score()'s own rows."""
    from proseline.functions.score import score
    from proseline.operators import reports as R

    rows = score(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "source", *R.CALIBRATION_METRICS, "lazy_pattern_count").toPandas()
    got = QUERIES["average_by_trial"](spark, DATA).toPandas().set_index("trial")
    means = rows.groupby("source")[["quality_score", "lazy_score", "prose_penalty", "lint_score"]].mean()
    for k in means.columns:
        assert ((got["mean_score" if k == "quality_score" else k] - means[k]).abs() < 2e-6).all()
    assert (got["lazy_pattern_count"].sort_index() == rows.groupby("source")["lazy_pattern_count"].sum()).all()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    merged = rows.merge(labels, on="doc_id")
    found = {(r["corpus"], r["metric"]): r["mean"] for r in QUERIES["calibration"](spark, DATA).collect()}
    assert {m for _, m in found} == set(R.CALIBRATION_METRICS)
    for (corpus, metric), mean in found.items():
        assert abs(mean - merged[merged["quality"] == corpus][metric].mean()) < 2e-6


def test_seeds_reach_every_rule(spark):
    """Over the seeded documents every count is above 0 somewhere, and so are literals and all but the rarest regexes."""
    from proseline.functions.lazy import STANDARD_REGEXES

    counts = QUERIES["lint_counts_seeded"](spark, DATA).toPandas()
    assert (counts.drop(columns="doc_id").sum() > 0).all()
    hits = ";".join(r["hits"] for r in QUERIES["lazy_hits_seeded"](spark, DATA).collect())
    assert all(f"{p}=" in hits for p in STANDARD_REGEXES) and len({h.split("=")[0] for h in hits.split(";")}) > 200


def test_objective_has_unicode_word_characters_in_its_sql(spark, tmp_path):
    """A word that begins with a letter beyond ASCII is one for the patterns of the SQL too."""
    texts = ["La casa es no ñcota un, no no ra la mi de todo.", "No é verdad para mi, not bien y ya no más aquí.", "The ñslowly moved one, and the slowly\u00a0moved one stood here."]
    rows = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows.toPandas().to_parquet(tmp_path / "conversations.parquet")
    compare(spark, "objective", QUERIES["objective"], ORACLE_SQL["objective"], str(tmp_path))
    values = {r["trial"]: r["mean_score"] for r in QUERIES["objective"](spark, str(tmp_path)).collect()}
    assert len(values) == len(texts)


def test_average_by_trial_has_the_worst_band_and_every_hit(spark, tmp_path):
    """Both were left out. Bands that tie go by the first prompt, equal entries of several prompts are counted, and the list accounts for all hits."""
    plain = "The river ran past the mill and the boy walked home along it before the rain came down that night. "
    listy = plain + "I delve into the tapestry, a testament to the vibrant landscape. Moreover, it is crucial, pivotal and robust. "
    texts = [plain, listy, plain + "Wait... what!!! No!!!! ", plain + "Wait... what!!! ", "", None, listy * 3, plain + "as an ai "]
    rows = spark.createDataFrame([(i, t, "en", ["a", "a", "b", "b", "c", "c", None, "d"][i], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    compare(spark, "average_by_trial", QUERIES["average_by_trial"], ORACLE_SQL["average_by_trial"], str(tmp_path))
    got = {r["trial"]: r for r in QUERIES["average_by_trial"](spark, str(tmp_path)).collect()}
    assert got["c"]["lint_band"] == "unknown" and got["c"]["lazy_patterns_found"] == ""
    assert got["a"]["lint_band"] != "clean"
    assert "=2x1" in got["b"]["lazy_patterns_found"] and "=1x" in got["b"]["lazy_patterns_found"]
    for r in got.values():
        entries = [e.rsplit("=", 1)[1].split("x") for e in r["lazy_patterns_found"].split(";") if e]
        assert sum(int(n) * int(times) for n, times in entries) == r["lazy_pattern_count"]

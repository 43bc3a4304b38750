"""Operators whose broadcasts are classes of the package, with a driver that starts elsewhere and workers that can't import it."""

import os
import subprocess
import sys
import textwrap

from tests.conftest import ROOT

CODE = """
import sys
root = sys.argv[1]
sys.path.insert(0, root)  # this process only: no PYTHONPATH, another folder
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
try:
    spark.range(1).mapInPandas(lambda parts: __import__("proseline") and parts, "id long").collect()
    raise SystemExit("workers can import the package, so this proves nothing")
except Exception:
    pass
queries = e.queries()
for name in ("op1_decontamination", "op5_lm_scores", "op7_embedding_duplicates", "op8_language_id", "op9_token_counts", "op10_toxicity", "op11_alignment", "op12_hard_negatives", "pipeline", "median_prune", "summary_stats"):
    print(name, queries[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(textwrap.dedent(CODE))
    got = subprocess.run([sys.executable, str(tmp_path / "run.py"), ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0 and len(got.stdout.splitlines()) == 11, (got.stdout, got.stderr[-1500:])

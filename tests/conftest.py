import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def compare(spark, name, query, sql, data=DATA):
    """The query's rows against DuckDB's: same columns, same values, whatever the order."""
    import glob

    import duckdb

    got = query(spark, data).toPandas()
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want), name
    keys = sorted(columns, key=lambda c: got[c].dtype == float)
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if a[c].dtype == float:
            same |= (a[c] - b[c]).abs() <= 2e-6
        assert same.all(), (name, c, a[~same].head(3).to_dict(), b[~same].head(3).to_dict())

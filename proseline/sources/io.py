"""Readers and writers of the analyses' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import read_arrays

RESPONSES = "prompt string, parameters struct<temperature:double,min_p:double,adaptive_target:double,adaptive_decay:double,top_nsigma:double>, response string, success boolean"
TRIALS = (
    "trial_number long, state string, value double, parameters map<string,double>, user_attrs map<string,string>, response_texts map<string,string>, prompt_scores map<string,double>, "
    "score_variance double, score_min double, per_prompt_metrics map<string,map<string,double>>, prompt_ids array<string>, datetime_start string, datetime_complete string"
)


def read_json_array(spark: SparkSession, path: str, schema: str = RESPONSES) -> DataFrame:
    """Files that each hold one JSON array; large ones are split."""
    return read_arrays(spark, path, schema)


def read_json_lines(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json_array(spark, path, TRIALS)
    return rows.withColumns({c: F.to_timestamp(c) for c in ("datetime_start", "datetime_complete")}).withColumnRenamed("trial_number", "trial")


def latest(spark: SparkSession, pattern: str) -> str:
    """The path whose name sorts last among those that match; FileNotFoundError if none does."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    names = sorted((s.getPath().getName(), s.getPath().toString()) for s in found)
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1][1]


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_trials(df: DataFrame, path: str) -> None:
    """Study storage: an append-only table."""
    df.write.mode("append").parquet(path)


def checkpoint_trials(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)

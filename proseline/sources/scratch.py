"""Tables in the shared folder that are written once and read as often as needed: they cut lineage, so a lost executor costs a re-read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a temporary folder does if the executors are threads of this machine; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="proseline-"))


def saved(df: DataFrame) -> DataFrame:
    """df, written and to be read from there; deleted when the Python process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/proseline/{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _PATHS:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is gone; a cluster's own cleaner takes the folder
            return

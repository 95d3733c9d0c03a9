"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as spark.checkpoint.dir names it. In local mode (tests) a temporary one may stand in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="atelier-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `stored` has returned and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _TABLES:
            _TABLES.remove(path)
            _delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of jobs that are over: it does so when the driver collects what nothing refers to."""
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this process; results that were not written before can't be read afterwards."""
    while _TABLES:
        _delete(spark, _TABLES.pop())

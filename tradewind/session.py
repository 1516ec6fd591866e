"""Session with the settings the engine relies on: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tradewind", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, below: int = 64_000_000) -> DataFrame:
    """df dealt over all cores if Spark reckons it under so many bytes: a small table is often one file of one row

    group and so one task's, whatever is computed on it. A larger one has its own splits and is left as it is."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size < below else df


_scratch: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone; the shared folder is cleaned with the application
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir, deleted when the application ends.

    Where it is unset, a session whose executors are the driver's own threads gets a folder of this machine; any other
    must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_folder()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tradewind-")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

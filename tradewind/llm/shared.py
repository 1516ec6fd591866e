"""Helpers that the corpus operators share: table scans, row mapping and written intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master, whose driver and executors are one process, gets a folder of its own; on a
    cluster that would be a folder of one machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tradewind-")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the session may be gone; the shared folder is cleaned with the application
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str, few: bool = False) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: cuts the lineage, and survives the loss of any executor.

    With few, for tables of short rows behind a shuffle, it is written by at most as many tasks as the session has
    cores: as fast, in fewer files.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(max(2, spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    return stored(df, name, few)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    _written.remove((spark, path))
    _remove(spark, path)


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def map_batches(df: DataFrame, columns: Sequence[str], schema: str | StructType, step: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """One Arrow batch in, one out, over only the named columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out

    return in_arrow(df.select(*map(quoted, columns)), run, schema)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow for columns of any names: Spark itself can't hand over those with a dot or a backtick.

    Workers are kept for later tasks, so what a batch took is given back behind it."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batch.rename_columns(names) for batch in batches):
            yield out
            pa.default_memory_pool().release_unused()  # else a worker that is kept holds what its largest batch took

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(named, schema)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo: the folds that hold rows out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))

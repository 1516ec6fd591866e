"""Stored tables of daily partitions, changed a few days at a time, and runs over them that go on where the last ended."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.session import written

# ---- files ----


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _place(spark, path)
    return files.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)


# ---- daily partitions ----


def create(rows: DataFrame, path: str, at: str, unit: str = "day") -> None:
    """Stores rows below path in a folder for each day of the time `at`, or each month, named by its first day."""
    rows.withColumn("day", F.to_date(F.date_trunc(unit, at))).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Puts rows in the place of what the partitions that they fall in held; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def delete_before(spark: SparkSession, path: str, at: str, cutoff: datetime, unit: str = "day") -> int:
    """Deletes the rows of a stored table whose time lies before the cutoff, and gives their number.

    Days (or months) that end before it go as folders, unread but for their counts; of its own day what stays is written
    aside and then put in the day's place, so a run that breaks off leaves rows undeleted and never loses one. A rerun finds
    nothing more to delete. Rows without a time stay.
    """
    if not exists(spark, path):
        return 0
    held, day = spark.read.parquet(path), cutoff.date().replace(day=1) if unit == "month" else cutoff.date()
    whole = held.where(F.col("day") < F.lit(day)).groupBy("day").count().collect()  # a row a day
    own = held.where(F.col("day") == F.lit(day))
    if gone := own.where(F.col(at) < F.lit(cutoff).cast(held.schema[at].dataType)).count():
        left = written(own.where(~(F.col(at) < F.lit(cutoff).cast(held.schema[at].dataType))), "kept")
        if left.isEmpty():
            _delete(spark, f"{path}/day={day}")
        else:
            _overwrite(left, path, "day")
    for d in whole:
        _delete(spark, f"{path}/day={d['day']}")
    return gone + sum(d["count"] for d in whole)


# ---- spend counters ----


def record_usage(usage: DataFrame, folder: str, batch: str) -> None:
    """Adds usage (tenant, spend_date, tokens) to the counters below folder: tokens_used and calls_made a tenant and day.

    A batch's sums are kept under its name and replaced if it comes again; the days that it touches are then counted
    anew from all batches' sums. So no update is lost between batches and none is counted twice, wherever a run breaks off.
    """
    spark = usage.sparkSession
    sums = usage.groupBy("tenant", F.col("spend_date").alias("day")).agg(F.sum("tokens").alias("tokens_used"), F.count("*").alias("calls_made")).withColumn("batch", F.lit(batch))
    sums = written(sums, "usage")
    _overwrite(sums, f"{folder}/batches", "day", "batch")
    days = [r["day"] for r in sums.select("day").distinct().collect()]
    every = spark.read.schema(sums.schema).parquet(f"{folder}/batches").where(F.col("day").isin(days))
    counted = every.groupBy("tenant", "day").agg(F.sum("tokens_used").alias("tokens_used"), F.sum("calls_made").alias("calls_made"))
    if days:
        _overwrite(written(counted, "counters"), f"{folder}/counters", "day")


# ---- keyset batches with a stored cursor ----

#: The column that holds a row's own batch where a pass took several: its folder bears the first one's number.
IN_PASS = "_batch"


def cursor(spark: SparkSession, folder: str) -> tuple[int, int | None]:
    """(batches done, the last key of them): what the next run goes on from."""
    if not exists(spark, f"{folder}/cursor"):
        return 0, None
    done = spark.read.schema("batch long, last long").parquet(f"{folder}/cursor").agg(F.max("batch"), F.max("last")).first()
    return (0, None) if done[0] is None else (done[0] + 1, done[1])


def run_batches(rows: DataFrame, key: str, size: int, folder: str, work: Callable[[DataFrame], dict[str, DataFrame]], most: int | None = None, together: int | None = None) -> int:
    """Takes rows in batches of `size` in the order of a long key, from the stored cursor on, and gives how many it did.

    What work makes of a batch goes below folder under its names; then the cursor moves. A batch that broke off before
    that is done again in its own place, so nothing is repeated or left out, however often runs end early; what done_so_far
    reads never holds it. most ends a run after so many batches. Rows without a key are in no batch; rows that share a
    key should not, as a batch may end between them.

    A pass of Spark jobs costs seconds, however few rows a batch has. Where `together` is given a pass takes up to so many
    batches: work then gets their rows with the column batch, and what it makes must carry it. The cursor moves behind
    all of a pass, so its `size * together` rows are what a run that breaks off does again, and what one task numbers.
    """
    spark, done = rows.sparkSession, 0
    while most is None or done < most:
        number, last = cursor(spark, folder)
        left = rows.where(F.col(key).isNotNull() if last is None else F.col(key) > last)
        batches = 1 if together is None else together if most is None else min(together, most - done)
        batch = left.orderBy(key).limit(size * batches)
        if together is not None:
            place = F.row_number().over(Window.orderBy(key)) - 1
            batch = batch.withColumn("batch", F.lit(number).cast("long") + F.floor(place / size))
        batch = written(batch, "batch")
        top, held = batch.agg(F.max(key), F.count("*")).first()
        if top is None:
            break
        for name, made in work(batch).items():
            if together is not None:
                made = made.withColumnRenamed("batch", IN_PASS)
            made.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        did = -(-held // size)
        spark.range(1).select(F.lit(top).cast("long").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cursor/batch={number + did - 1}")
        done += did
    return done


def done_so_far(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What the finished batches have put under a name, each row with its batch."""
    finished, _ = cursor(spark, folder)
    made = spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}").where(F.col("batch") < finished)
    own = F.coalesce(IN_PASS, F.col("batch").cast("long")) if IN_PASS in made.columns else F.col("batch").cast("long")
    return made.withColumn("batch", own).drop(IN_PASS)

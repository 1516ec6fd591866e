"""Alert rules over counters that only grow and start again at zero: increases over sliding ranges, staleness, duration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_deltas(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    """samples (the series' labels, at, sample_id, value) with delta, by how much each is above the one before it.

    A value under the one before means that the counter began anew: the whole value is new. The first has no delta.
    """
    before = F.lag("value").over(Window.partitionBy(*series).orderBy("at", "sample_id"))
    return samples.withColumn("delta", F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def increases(deltas: DataFrame, series: Sequence[str], by: Sequence[str], over: str, step: str) -> DataFrame:
    """end, by, increase: how far the counters of each group rose in each range of that length, one ending at every step.

    A range holds its start and not its end. Of each series' samples within it all deltas count but the first one's,
    which leads in from outside, as a range needs two samples to show a rise; nothing is extrapolated to its ends. A
    range is a group by time and series, aggregated where the samples lie, so no series is gathered.
    """
    w = F.window("at", over, step)
    each = deltas.groupBy(w.alias("w"), *series).agg((F.coalesce(F.sum("delta"), F.lit(0)) - F.coalesce(F.min_by("delta", F.struct("at", "sample_id")), F.lit(0))).alias("rise"), F.count("*").alias("n"))
    return each.where("n > 1").groupBy(F.col("w.end").alias("end"), *by).agg(F.sum("rise").alias("increase"))


def ratio(part: Column, whole: Column, seconds: int, least: float = 0.0) -> Column:
    """A rate's share of another, which counts as at least `least` a second; null where nothing is divided."""
    below = F.greatest(whole / seconds, F.lit(least)) if least else F.nullif(whole / seconds, F.lit(0.0))
    return (part / seconds) / below


def staleness(last: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """end, key, age: seconds from the latest success (key, at) to each point of the grid (key, end); null before the first.

    Successes and points are sorted into one sequence a key.
    """
    both = last.select(key, F.col("at").alias("when"), F.lit(0).alias("kind")).unionByName(grid.select(key, F.col("end").alias("when"), F.lit(1).alias("kind")))
    latest = F.last(F.when(F.col("kind") == 0, F.col("when")), ignorenulls=True).over(Window.partitionBy(key).orderBy("when", "kind").rowsBetween(Window.unboundedPreceding, 0))
    aged = both.withColumn("_last", latest).where("kind = 1")
    return aged.select(F.col("when").alias("end"), key, ((F.unix_micros(F.col("when").cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))) / 1_000_000).alias("age"))


def firing(conditions: DataFrame, by: Sequence[str], step_seconds: int, for_seconds: int) -> DataFrame:
    """conditions (end, by; one row where a rule's condition holds at a step) with firing: it has held for so long without a gap."""
    steps = -(-for_seconds // step_seconds)
    held = F.count("*").over(Window.partitionBy(*by).orderBy(F.unix_seconds(F.col("end").cast("timestamp"))).rangeBetween(-steps * step_seconds, 0))
    return conditions.withColumn("firing", held == steps + 1)

"""Structured Streaming jobs: article arrival, windowed failure counts, per-source circuit state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradewind.operators.dedup import ingest_hash
from tradewind.operators.lifecycle import FAILURES_TO_OPEN, OPEN_MINUTES
from tradewind.session import scratch


def new_articles(stream: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Articles whose ingest hash has not been seen within the lateness of publication times; state older than that goes."""
    return stream.withColumn("ingest_hash", ingest_hash()).withWatermark("published_at", lateness).dropDuplicatesWithinWatermark(["ingest_hash"])


def append_absent(stream: DataFrame, path: str, checkpoint: str, key: str = "ingest_hash", at: str | None = None):
    """Writes each micro-batch's rows whose key the table at path lacks; a batch run again adds nothing.

    at names the time that the key holds, as the ingest hash does that of publication. The table is then partitioned
    by its day, and a batch is compared with its own days' partitions only; without it, with the key column of the
    whole table. Batches are idempotent through the anti-join, the trigger takes what has arrived and ends. A batch is
    computed once, to a table of its own: what was dealt and held in state for it is not done again for each look at it.
    """
    days = [] if at is None else ["day"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, once = batch.sparkSession, scratch(batch.sparkSession, "batch")
        own = batch.dropDuplicates([key]).withColumns({d: F.to_date(at) for d in days})
        own.write.parquet(once)
        fresh = spark.read.schema(own.schema).parquet(once)
        jpath, jonce = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, once))
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        exists = jpath.getFileSystem(conf).exists(jpath)
        nothing = exists and fresh.isEmpty()
        if exists and not nothing:
            held = spark.read.parquet(path)
            if days:
                first, last = fresh.agg(F.min("day"), F.max("day")).first()
                held = held.where(F.col("day").between(first, last))
            fresh = fresh.join(held.select(key), key, "left_anti").select(fresh.columns)
        if not nothing:
            fresh.write.mode("append").partitionBy(*days).parquet(path)
        jonce.getFileSystem(conf).delete(jonce, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures_by_window(events: DataFrame, size: str = "15 minutes", slide: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Failures and their share by user and sliding event-time window."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", size, slide), "user_id")
    return w.agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count("*").alias("events")).select(F.col("window.start").alias("start"), "user_id", "failures", "events")


CIRCUIT = "source_id long, at timestamp, state string, failures int"


def _circuit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, open_until = state.get if state.exists else (0, 0)
    out = []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ts, ok in zip(rows["ts"], rows["ok"]):
        now = ts.timestamp()
        before = "closed" if failures < FAILURES_TO_OPEN else "open" if open_until > now else "half_open"
        if ok and before != "open":
            failures, open_until = 0, 0
        elif not ok:
            failures += 1
            if failures >= FAILURES_TO_OPEN:
                open_until = int(now) + OPEN_MINUTES * 60
        after = "closed" if failures < FAILURES_TO_OPEN else "open" if open_until > now else "half_open"
        if after != before:
            out.append((key[0], ts, after, failures))
    state.update((failures, int(open_until)))
    yield pd.DataFrame(out, columns=["source_id", "at", "state", "failures"])


def circuit_changes(outcomes: DataFrame) -> DataFrame:
    """source_id, at, state, failures at each change of a source's circuit, from outcomes (source_id, ts, event_id, ok).

    Five failures in a row open it for 30 minutes; a success while it is open does not count; after the cooldown it
    is half open, and one outcome decides.
    """
    return outcomes.groupBy("source_id").applyInPandasWithState(_circuit, CIRCUIT, "failures int, open_until long", "append", GroupStateTimeout.NoTimeout)


def stream_of(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)

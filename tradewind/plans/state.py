"""Queries whose rows rest on those before them: spend that is refused, leases, circuits with a probe, late arrivals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators import folds
from tradewind.plans.registry import query
from tradewind.session import scratch, table
from tradewind.streaming import ingest, ordered

CAP = 500


@query(sql=f"""WITH RECURSIVE c AS (SELECT user_id % 10 AS tenant, CAST(ts AS DATE) AS spend_date, event_id, CAST(floor(value) AS BIGINT) AS tokens, event_type = 'purchase' AS happened, row_number() OVER (PARTITION BY user_id % 10, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT tenant, spend_date, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS calls FROM (SELECT DISTINCT tenant, spend_date FROM c)
  UNION ALL SELECT c.tenant, c.spend_date, c.k, c.event_id, CASE WHEN c.happened THEN CASE WHEN used + tokens > {CAP} THEN 'overage' ELSE 'accepted' END WHEN tokens <= greatest(0, {CAP} - used) THEN 'accepted' ELSE 'refused' END,
    CASE WHEN c.happened OR tokens <= greatest(0, {CAP} - used) THEN used + tokens ELSE used END, CASE WHEN c.happened OR tokens <= greatest(0, {CAP} - used) THEN calls + 1 ELSE calls END
  FROM f JOIN c ON c.tenant = f.tenant AND c.spend_date = f.spend_date AND c.k = f.k + 1)
SELECT event_id, tenant, outcome, used AS tokens_used, calls AS calls_made FROM f WHERE k > 0""")
def spend_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call of a tenant's day, in order: accepted, refused, or counted beyond the cap because it had happened."""
    e = table(spark, sf_dir, "events")
    calls = e.select((F.col("user_id") % 10).alias("tenant"), F.to_date("ts").alias("spend_date"), folds.micros("ts").alias("at"), F.col("event_id").alias("call_id"), F.floor("value").cast("long").alias("tokens"), (F.col("event_type") == "purchase").alias("happened"))
    return folds.spend(calls, CAP).select(F.col("call_id").alias("event_id"), "tenant", "outcome", "tokens_used", "calls_made")


def _lease_sql(keeps_own: bool) -> str:
    live, mine = "f.expires >= e.ts", "f.owner = e.owner"
    renewed = mine if keeps_own else f"{mine} AND {live}"
    outcome = f"CASE WHEN e.request = 'claim' THEN CASE WHEN f.status IS NULL THEN 'claimed' WHEN f.status <> 'running' THEN 'refused' WHEN {renewed} THEN 'renewed' WHEN NOT ({live}) THEN 'stolen' ELSE 'refused' END WHEN f.status = 'running' AND {mine} AND {live} THEN CASE e.request WHEN 'fence' THEN 'fenced' WHEN 'complete' THEN 'completed' ELSE 'failed' END ELSE 'refused' END"
    return f"""WITH RECURSIVE e AS (SELECT user_id % 15 AS source_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS run, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS owner, CASE event_type WHEN 'click' THEN 'fence' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END AS request,
  row_number() OVER (PARTITION BY user_id % 15, CAST(floor(epoch(ts) / 21600) AS BIGINT) ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT source_id, run, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS TIMESTAMP) AS expires, CAST(0 AS BIGINT) AS attempts FROM (SELECT DISTINCT source_id, run FROM e)
  UNION ALL SELECT source_id, run, k, event_id, outcome, CASE WHEN outcome IN ('claimed', 'renewed', 'stolen') THEN 'running' WHEN outcome IN ('completed', 'failed') THEN outcome ELSE status END, CASE WHEN outcome IN ('claimed', 'renewed', 'stolen') THEN own WHEN outcome IN ('completed', 'failed') THEN NULL ELSE owner END,
    CASE WHEN outcome IN ('claimed', 'renewed', 'stolen') THEN ts + INTERVAL 65 MINUTE WHEN outcome IN ('completed', 'failed') THEN NULL ELSE expires END, CASE WHEN outcome IN ('claimed', 'renewed', 'stolen') THEN attempts + 1 ELSE attempts END
  FROM (SELECT e.source_id, e.run, e.k, e.event_id, e.ts, e.owner AS own, f.status, f.owner, f.expires, f.attempts, {outcome} AS outcome FROM f JOIN e ON e.source_id = f.source_id AND e.run = f.run AND e.k = f.k + 1))
SELECT event_id, source_id, run, outcome, status, owner AS lease_owner, CAST(epoch_us(expires) AS BIGINT) AS lease_expires_at, attempts FROM f WHERE k > 0"""


def _lease_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two owners' requests for the lease of each of fifteen sources in each six-hour run."""
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 15).alias("source_id"), F.floor(folds.micros("ts") / 21_600_000_000).alias("run"), folds.micros("ts").alias("at"), F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 3 == 0, "b").otherwise("a").alias("owner"), F.when(kind == "click", "fence").when(kind == "purchase", "complete").when(kind == "error", "fail").otherwise("claim").alias("request"))


def _leases(spark: SparkSession, sf_dir: str, keeps_own: bool) -> DataFrame:
    found = folds.leases(_lease_requests(spark, sf_dir), ["source_id", "run"], keeps_own)
    return found.select(F.col("request_id").alias("event_id"), "source_id", "run", "outcome", "status", "lease_owner", "lease_expires_at", "attempts")


@query(sql=_lease_sql(False))
def source_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request for a source's lease within a run: claimed, renewed, stolen, fenced, ended or refused, and the lease after it."""
    return _leases(spark, sf_dir, False)


@query(sql=_lease_sql(True))
def retrieval_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests by the rule of runs, whose owner may renew a lease that has run out."""
    return _leases(spark, sf_dir, True)


_circuit_sql = """WITH RECURSIVE e AS (SELECT user_id % 15 AS source_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS owner, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'success' ELSE 'request' END AS kind, row_number() OVER (PARTITION BY user_id % 15 ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT source_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS seen, '' AS outcome, CAST(0 AS BIGINT) AS failures, CAST(NULL AS TIMESTAMP) AS until, CAST(NULL AS VARCHAR) AS prober, CAST(NULL AS TIMESTAMP) AS lease FROM (SELECT DISTINCT source_id FROM e)
  UNION ALL SELECT source_id, k, event_id, ts, outcome, CASE WHEN kind = 'failure' THEN failures + 1 WHEN outcome = 'closed' THEN 0 ELSE failures END,
    CASE WHEN kind = 'failure' AND failures >= 4 THEN ts + INTERVAL 30 MINUTE WHEN outcome = 'closed' THEN NULL ELSE until END,
    CASE WHEN kind = 'failure' OR outcome = 'closed' THEN NULL WHEN outcome = 'probe' THEN owner ELSE prober END, CASE WHEN kind = 'failure' OR outcome = 'closed' THEN NULL WHEN outcome = 'probe' THEN ts + INTERVAL 65 MINUTE ELSE lease END
  FROM (SELECT e.source_id, e.k, e.event_id, e.ts, e.owner, e.kind, f.failures, f.until, f.prober, f.lease,
      CASE e.kind WHEN 'failure' THEN CASE WHEN f.failures = 4 THEN 'opened' WHEN f.failures > 4 THEN 'extended' ELSE 'counted' END WHEN 'success' THEN CASE WHEN f.failures < 5 OR coalesce(f.prober = e.owner, false) THEN 'closed' ELSE 'ignored' END
        ELSE CASE WHEN f.failures < 5 THEN 'allowed' WHEN f.until > e.ts THEN 'refused' WHEN f.prober = e.owner AND f.lease >= e.ts THEN 'again' WHEN f.prober IS NULL OR f.lease < e.ts THEN 'probe' ELSE 'refused' END END AS outcome
    FROM f JOIN e ON e.source_id = f.source_id AND e.k = f.k + 1))
SELECT event_id, source_id, outcome, CASE WHEN failures < 5 THEN 'closed' WHEN until > seen THEN 'open' ELSE 'half_open' END AS state, failures, prober AS probe_owner FROM f WHERE k > 0"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two owners meet at fifteen sources: requests, failures and successes."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    what = F.when(kind == "error", "failure").when((kind == "purchase") & (F.col("event_id") % 4 == 0), "success").otherwise("request")
    return e.select((F.col("user_id") % 15).alias("source_id"), folds.micros("ts").alias("at"), "event_id", F.when(F.col("event_id") % 3 == 0, "b").otherwise("a").alias("owner"), what.alias("kind"))


_shown = ("event_id", "source_id", "outcome", "state", "failures", "probe_owner")


@query(sql=_circuit_sql)
def circuit_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request, failure and success at a source, what it meets, and the circuit after it."""
    return folds.circuits(_outcomes(spark, sf_dir)).select(*_shown)


def _in_turn(rows: DataFrame, turns: int, src: str) -> Iterator[int]:
    """Writes the rows of each _turn as new files below src, and says so each time. They are told apart in one pass."""
    apart = scratch(rows.sparkSession, "turns")
    rows.write.partitionBy("_turn").parquet(apart)
    sorted_out = rows.sparkSession.read.schema(rows.schema).parquet(apart)
    for k in range(turns):
        sorted_out.where(F.col("_turn") == k).drop("_turn").write.mode("append").parquet(src)
        yield k


@query(sql=_circuit_sql)
def circuit_probes_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outcomes as a stream: files that arrive in three turns, every fifth row half a day late, folded in order

    behind a watermark of a day by a job that stops and goes on from its checkpoint at each turn."""
    rows = _outcomes(spark, sf_dir).withColumn("ts", F.timestamp_micros("at"))
    src, out, marks = (scratch(spark, f"circuits-{x}") for x in ("in", "out", "marks"))
    shift = F.when(F.col("event_id") % 5 == 0, F.expr("interval 12 hours")).otherwise(F.expr("interval 0 hours"))
    day = F.datediff(F.col("ts") + shift, F.lit("2024-01-01").cast("date"))
    stream = lambda: ordered.folded(ingest.stream_of(spark, src, rows.schema, 1_000_000), "source_id", "ts", ("at", "event_id"), ("at", "owner", "kind"), folds.CLOSED, folds.circuit_step, folds.CIRCUIT, "1 day")

    def run() -> None:
        with ordered.with_rocksdb(spark):
            stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    for _ in _in_turn(rows.withColumn("_turn", F.least(F.floor(day / 11), F.lit(2))), 3, src):
        run()
    ordered.ended(rows, "ts", "source_id", "1 day").write.mode("append").parquet(src)
    run()
    return spark.read.parquet(out).select(*_shown)


# ---- late and repeated arrivals ----

#: Turns of five days; every fiftieth event comes a turn late, every twentieth comes again in the next.
_turn = "least(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5, 5)"


@query(f"""arrived AS (SELECT event_id, ts, {_turn} + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END AS turn FROM events UNION ALL SELECT event_id, ts, {_turn} + 1 FROM events WHERE event_id % 20 = 0),
marks AS (SELECT turn, max(date_trunc('milliseconds', max(ts))) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS passed FROM arrived GROUP BY turn),
kept AS (SELECT DISTINCT event_id, ts FROM arrived JOIN marks USING (turn) WHERE passed IS NULL OR ts > passed)""", sql="SELECT e.day, e.n AS events, coalesce(k.n, 0) AS kept, e.n - coalesce(k.n, 0) AS late FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) e LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM kept GROUP BY 1) k USING (day)")
def late_arrivals_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day, those that a table holds after they arrived in turns, and those dropped as later than two days.

    Each turn's files are read by a job that goes on from its checkpoint, drops what the watermark has passed and what
    it has seen, and appends the rest where the table lacks it. After the last turn the job runs with nothing new, and
    again with the last turn's files repeated: neither adds a row.
    """
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    src, out, marks = (scratch(spark, f"arrivals-{x}") for x in ("in", "out", "marks"))
    turn = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 5), F.lit(5))
    first = events.withColumn("_turn", turn + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0))
    arrived = first.unionByName(events.where("event_id % 20 = 0").withColumn("_turn", turn + 1))
    fresh = lambda: ingest.stream_of(spark, src, events.schema, 1_000_000).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["event_id"])
    run = lambda: ingest.append_absent(fresh(), out, marks, "event_id", "ts").awaitTermination()
    for _ in _in_turn(arrived, 7, src):
        run()
    run()
    arrived.where("_turn >= 6").drop("_turn").write.mode("append").parquet(src)
    run()
    day = F.to_date("ts").alias("day")
    kept = spark.read.parquet(out).groupBy(day).agg(F.count("*").alias("kept"))
    found = events.groupBy(day).agg(F.count("*").alias("events")).join(kept, "day", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    return found.select("day", "events", "kept", (F.col("events") - F.col("kept")).alias("late"))

"""Queries of alert rules over counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.operators import rates
from tradewind.plans.registry import query
from tradewind.session import table

SAMPLES = """samples AS (SELECT user_id % 15 AS source, user_id % 4 AS tenant, event_type AS kind, ts AS seen, event_id AS sample_id, count(*) OVER (PARTITION BY user_id % 15, user_id % 4, event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events),
d AS (SELECT *, CASE WHEN value < before THEN value ELSE value - before END AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY source, tenant, kind ORDER BY seen, sample_id) AS before FROM samples))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a counter a source, tenant and kind of event shows at each event; all begin anew at midnight."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 15).alias("source"), (F.col("user_id") % 4).alias("tenant"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("sample_id"))
    day = Window.partitionBy("source", "tenant", "kind", F.to_date("at")).orderBy("at", "sample_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("value", F.count("*").over(day))


def _rises(name: str, over: int, step: int, by: str) -> str:
    """SQL of increases: name has end, by, and rise; over and step in seconds."""
    ends = f"make_timestamp((CAST(floor(epoch(seen) / {step}) AS BIGINT) + s.k) * {step} * 1000000)"
    group = f", {by}" if by else ""
    return f"""{name} AS (SELECT stop{group}, CAST(sum(up) AS BIGINT) AS rise, CAST(coalesce(sum(up) FILTER (kind = 'error'), 0) AS BIGINT) AS failed FROM (
  SELECT {ends} AS stop, source, tenant, kind, coalesce(sum(delta), 0) - coalesce(first(delta ORDER BY seen, sample_id), 0) AS up
  FROM d, (SELECT unnest(range(1, {over // step + 1})) AS k) s GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)"""


def _rule(name: str, source: str, label: str, value: str, condition: str, step: int, lasts: int) -> str:
    steps = -(-lasts // step)
    return f"SELECT '{name}' AS rule, {label} AS label, stop AS \"end\", round(value, 6) AS value, count(*) OVER (PARTITION BY {label} ORDER BY stop RANGE BETWEEN INTERVAL {steps * step} SECOND PRECEDING AND CURRENT ROW) = {steps + 1} AS firing FROM (SELECT *, {value} AS value FROM {source}) WHERE {condition}"


_stale = "(SELECT g.source, g.stop, (epoch_us(g.stop) - max(epoch_us(o.seen))) / 1000000 AS age FROM (SELECT DISTINCT source, make_timestamp((CAST(floor(epoch(seen) / 1800) AS BIGINT) + 1) * 1800000000) AS stop FROM samples) g JOIN samples o ON o.source = g.source AND o.kind = 'purchase' AND o.seen <= g.stop GROUP BY g.source, g.stop)"
_dead = _rises("dead", 3600, 1800, "source, kind")
_refused = _rises("refused", 3600, 1800, "tenant, kind")


@query(SAMPLES, _rises("five", 300, 300, ""), _rises("half", 1800, 1800, ""), _rises("eight", 28800, 1800, "source"), _dead, _refused, sql=" UNION ALL ".join([
    _rule("api_errors", "five", "'all'", "(failed / CAST(300 AS DOUBLE)) / nullif(rise / CAST(300 AS DOUBLE), 0)", "value > 0.05", 300, 600),
    _rule("calls_failing", "half", "'all'", "(failed / CAST(1800 AS DOUBLE)) / greatest(rise / CAST(1800 AS DOUBLE), 0.001)", "value > 0.5", 1800, 1800),
    _rule("source_failing", "eight", "CAST(source AS VARCHAR)", "CAST(failed AS DOUBLE)", "value > 0", 1800, 900),
    _rule("dead_letters", "(SELECT * FROM dead WHERE kind = 'signup')", "CAST(source AS VARCHAR)", "CAST(rise AS DOUBLE)", "value > 0", 1800, 300),
    _rule("refusals", "(SELECT * FROM refused WHERE kind = 'purchase')", "CAST(tenant AS VARCHAR)", "CAST(rise AS DOUBLE)", "value > 0", 1800, 900),
    _rule("stale", _stale, "CAST(source AS VARCHAR)", "CAST(age AS DOUBLE)", "value > 21600", 1800, 900),
]))
def operational_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six alert rules over the counters: each step at which a rule's condition holds for a source, a tenant or all, with

    the value that it judges and whether it has held long enough to fire."""
    series = ("source", "tenant", "kind")
    held = samples(spark, sf_dir)
    d = rates.with_deltas(held, series)
    half_hour = F.lit("all").alias("label")

    def rises(over: str, step: str, by: tuple[str, ...]) -> DataFrame:
        return rates.increases(d, series, (*by, "kind"), over, step)

    def shares(over: str, seconds: int, least: float) -> DataFrame:
        both = rises(over, over, ()).groupBy("end").agg(F.sum("increase").alias("whole"), F.coalesce(F.sum(F.when(F.col("kind") == "error", F.col("increase"))), F.lit(0)).alias("part"))
        return both.select("end", half_hour, rates.ratio(F.col("part").cast("double"), F.col("whole").cast("double"), seconds, least).alias("value"))

    def counted(over: str, key: str, kind: str) -> DataFrame:
        return rises(over, "30 minutes", (key,)).where(F.col("kind") == kind).select("end", F.col(key).cast("string").alias("label"), F.col("increase").cast("double").alias("value"))

    grid = held.select("source", F.window("at", "30 minutes")["end"].alias("end")).distinct()
    age = rates.staleness(held.where("kind = 'purchase'"), grid, "source").select("end", F.col("source").cast("string").alias("label"), F.col("age").alias("value"))
    rules = [
        ("api_errors", shares("5 minutes", 300, 0.0), 0.05, 300, 600), ("calls_failing", shares("30 minutes", 1800, 0.001), 0.5, 1800, 1800), ("source_failing", counted("8 hours", "source", "error"), 0.0, 1800, 900),
        ("dead_letters", counted("1 hour", "source", "signup"), 0.0, 1800, 300), ("refusals", counted("1 hour", "tenant", "purchase"), 0.0, 1800, 900), ("stale", age, 21600.0, 1800, 900),
    ]
    found = None
    for name, values, above, step, lasts in rules:
        one = rates.firing(values.where(F.col("value") > above), ["label"], step, lasts).select(F.lit(name).alias("rule"), "label", "end", F.round("value", 6).alias("value"), "firing")
        found = one if found is None else found.unionByName(one)
    return found

"""Watchlists and alert rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.signals import severity_rank


def watched(entries: DataFrame, watchlists: DataFrame, suppliers: DataFrame) -> DataFrame:
    """organization_id, public_id of active suppliers on any of an organisation's watchlists, each once."""
    return entries.join(watchlists, "watchlist_id").join(suppliers.where("is_active").select(F.col("id").alias("supplier_id"), "public_id"), "supplier_id").select("organization_id", "public_id").distinct()


def evaluate(events: DataFrame, rules: DataFrame, watched_suppliers: DataFrame) -> DataFrame:
    """rule_id, event_id, suppliers: rules that an event satisfies, with the sorted watched suppliers that caused it.

    Events meet rules through their suppliers and the organisations that watch these, all by equality; type and
    severity are checked on what remains, so no event is paired with every rule.
    """
    one = events.select(F.col("id").alias("event_id"), "risk_type", "severity", F.explode(F.array_distinct("affected_supplier_ids")).alias("public_id"))
    on = rules.where("is_enabled").select("rule_id", "organization_id", "min_severity", "risk_types")
    met = one.join(watched_suppliers, "public_id").join(on, "organization_id")
    met = met.where((F.size("risk_types") == 0) | F.array_contains("risk_types", F.col("risk_type"))).where(severity_rank(F.col("severity")) >= severity_rank(F.col("min_severity")))
    return met.groupBy("rule_id", "event_id").agg(F.array_sort(F.collect_set("public_id")).alias("suppliers"))

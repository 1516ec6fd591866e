"""Registered queries of the engine and their SQL."""

from tradewind.plans import articles, matching, people, rates, records, relations, state, stores, tables
from tradewind.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "articles", "matching", "people", "rates", "records", "relations", "state", "stores", "tables"]

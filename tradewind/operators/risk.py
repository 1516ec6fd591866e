"""Risk events: detection, keys, upserts, filters and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.functions.signals import canonical_region, regions
from tradewind.functions.text import contains_any, distinct_ignoring_case, normal, phrases_in, strip


def article_text(*parts: Column) -> Column:
    """The non-blank parts, stripped, one space between."""
    return F.array_join(F.filter(F.transform(F.array_compact(F.array(*parts)), strip), lambda x: x != ""), " ")


def text_terms(risk_type: str) -> frozenset[str]:
    """What the text must hold: exact phrases for the conservative types, all terms of the type for the rest."""
    exact = D.RISK_EXACT_PHRASES.get(risk_type)
    if exact is None:
        return D.risk_terms(risk_type)
    return frozenset(v for p in exact for v in (p, p.replace("_", " ")))


ACTION_TERMS = D.expand_terms(D.RISK_ACTION_PHRASES)


def article_terms(values: Column) -> Column:
    """Normal search terms of stored signal values: those of a risk type that a value names, else its own aliases."""
    types = {}
    for t in D.RISK_TYPE_ORDER:
        for alias in (*D.RISK_ALIASES[t], t):
            types[D.normal_term(alias)] = t
    table: dict[str, frozenset[str]] = {a: D.risk_terms(t) for a, t in types.items()}
    for term, group in D.SIGNAL_CLOSURE.items():
        table.setdefault(term, D.expand_terms([term]))
    lookup = F.create_map(*(x for k, v in sorted(table.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.transform(F.array_compact(values), normal), lambda v: v != ""), lambda v: F.coalesce(F.try_element_at(lookup, v), F.array(v, F.replace(v, F.lit(" "), F.lit("_")), F.replace(v, F.lit("_"), F.lit(" ")))))))


def _overlaps(terms: Column, wanted: frozenset[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, sorted(wanted))))


def evidence(text: Column, low: Column, terms: frozenset[str]) -> Column:
    """The text from 90 characters before the first term to 170 after it, stripped; its first 260 if no term stands in it.

    low is the text in lower case, which every term is looked up in.
    """
    at = F.array_min(F.filter(F.array(*(F.instr(low, t) for t in sorted(terms))), lambda p: p > 0))
    start = F.greatest(at - 90, F.lit(1))
    return strip(F.when(at.isNull(), F.substring(text, 1, 260)).otherwise(F.substring(text, start, at + 170 - start)))


def detect(articles: DataFrame) -> DataFrame:
    """One row an article and risk type it shows.

    Needs id, text, signal_values (array), priority_signal, detected_suppliers, detected_regions and categories (arrays).
    The terms of all types are looked up in one pass over the text; conservative types need their exact phrase in it, the
    geopolitical pair an action term besides, and of that pair the stronger event stays.
    """
    kinds = {kind: (text_terms(kind) if kind in D.RISK_EXACT_PHRASES else {t for t in text_terms(kind) if len(t) >= 3}) for kind in D.RISK_TYPE_ORDER}
    actions = {t for t in ACTION_TERMS if len(t) >= 3}
    n = articles.withColumns({"_terms": article_terms(F.col("signal_values")), "_low": F.lower("text"), "_said": phrases_in(normal(F.col("text")), set().union(actions, *kinds.values()))})
    n = n.withColumns({"_action": _overlaps(F.col("_terms"), ACTION_TERMS) | _overlaps(F.col("_said"), frozenset(actions)), "_override": contains_any(F.col("_low"), D.SEVERITY_OVERRIDE_WORDS)})
    extra = F.when(F.coalesce("priority_signal", F.lit("")) != "", 0.05).otherwise(0.0), F.when(F.size("detected_suppliers") > 0, 0.03).otherwise(0.0), F.when(F.size("detected_regions") > 0, 0.02).otherwise(0.0)
    found = []
    for place, kind in enumerate(D.RISK_TYPE_ORDER):
        terms = text_terms(kind)
        exact = kind in D.RISK_EXACT_PHRASES
        in_text = _overlaps(F.col("_said"), frozenset(kinds[kind]))
        meta = _overlaps(F.col("_terms"), D.risk_terms(kind))
        meta = meta & in_text if exact else meta
        hit = in_text | meta
        if kind in ("geopolitical", "regional_conflict"):
            hit = hit & F.col("_action")
        score = F.least(F.lit(0.5) + F.when(meta, 0.25).otherwise(0.0) + F.when(in_text, 0.25).otherwise(0.0) + extra[0] + extra[1] + extra[2], F.lit(0.95))
        severity = F.when(F.col("_override"), "critical" if kind in D.SEVERITY_OVERRIDE_CRITICAL else "high").otherwise(D.RISK_SEVERITY[kind])
        found.append(F.when(hit & (score >= 0.55), F.struct(F.lit(place).alias("place"), F.lit(kind).alias("risk_type"), severity.alias("severity"), F.round(score, 6).alias("confidence"), evidence(F.col("text"), F.col("_low"), terms).alias("evidence_snippet"), F.lit(D.RISK_RECOMMENDATION[kind]).alias("recommendation"))))
    n = n.withColumn("_events", F.array_compact(F.array(*found)))
    n = n.withColumn("_named", F.when(F.size("_events") > 0, regions(F.col("text"))))
    pair = F.filter("_events", lambda e: e["place"] < 2)
    weaker = F.when(F.size(pair) == 2, F.when(F.element_at(pair, 2)["confidence"] > F.element_at(pair, 1)["confidence"], 0).otherwise(1)).otherwise(-1)
    n = n.withColumn("_weaker", weaker).withColumn("_event", F.explode(F.filter("_events", lambda e: e["place"] != F.col("_weaker"))))
    places = distinct_ignoring_case(F.transform(F.concat("detected_regions", "_named"), canonical_region))
    return n.select("id", *(F.col(f"_event.{c}") for c in ("risk_type", "severity", "confidence", "evidence_snippet", "recommendation")), distinct_ignoring_case(F.col("detected_suppliers")).alias("affected_suppliers"), places.alias("affected_locations"), distinct_ignoring_case(F.col("categories")).alias("affected_categories"))


def event_key(article_id: Column, risk_type: Column, suppliers: Column, locations: Column) -> Column:
    part = lambda values: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(strip(v))), lambda v: v != ""))), ",")
    return F.substring(F.sha2(F.concat_ws(":", article_id.cast("string"), risk_type, part(suppliers), part(locations)), 256), 1, 40)


def upsert(old: DataFrame, new: DataFrame, key: str = "event_key", kept: tuple[str, ...] = ("status", "created_at")) -> DataFrame:
    """old and new by key: mutable columns from new where it has the key, the kept ones from old where it has."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    of = lambda side, c: F.col(f"{side}.{c}")
    present = of("n", key).isNotNull()
    columns = [F.coalesce(of("o", c), of("n", c)).alias(c) if c in kept else F.coalesce(of("n", key), of("o", key)).alias(c) if c == key else F.when(present, of("n", c)).otherwise(of("o", c)).alias(c) for c in old.columns]
    return joined.select(*columns)


def rank_score(suppliers: list[str], locations: list[str], categories: list[str], risk_types: list[str]) -> Column:
    """Confidence with what the user's preferences add, at most 1."""
    hit = lambda column, values: F.arrays_overlap(F.transform(column, F.lower), F.array(*map(F.lit, values)))
    score = F.col("confidence")
    for column, values, more in (("affected_suppliers", suppliers, 0.15), ("affected_locations", locations, 0.15), ("affected_categories", categories, 0.1)):
        if values:
            score = score + F.when(hit(column, values), more).otherwise(0.0)
    if risk_types:
        score = score + F.when(F.col("risk_type").isin(*risk_types), 0.1).otherwise(0.0)
    return F.when(score > 1.0, 1.0).otherwise(score)

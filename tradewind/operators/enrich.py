"""Deterministic analysis of articles, routing between cache, rules and a model, and budgets."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.functions.signals import canonical_category, canonical_tag, canonical_tags, classify, inferred_category, regions, suppliers
from tradewind.functions.text import extractive_summary, strip, union_distinct


def _filled(c: Column) -> Column:
    return F.when(strip(F.coalesce(c, F.lit(""))) != "", 1.0).otherwise(0.0)


def analyse(articles: DataFrame, summary_chars: int = 280) -> DataFrame:
    """articles with signal tags, suppliers, regions, category, summary, relevance and confidence (both to six places)."""
    title, description, snippet = F.col("title"), F.col("description"), F.col("content_snippet")
    blank = F.lit("")
    parts = F.filter(F.array(F.coalesce(title, blank), F.coalesce(description, blank), F.coalesce(snippet, blank)), lambda x: x != "")
    a = articles.withColumn("_text", F.array_join(parts, " "))
    a = a.withColumn("_signals", classify(F.col("_text"), title))
    a = a.withColumns({"signal_tags": canonical_tags(F.transform("_signals", lambda s: s["signal_type"])), "suppliers": suppliers(F.col("_text")), "regions": regions(F.col("_text")), "category": inferred_category([(title, 3), (description, 3), (snippet, 2), (F.col("query_group"), 1), (F.col("source_name"), 1)]), "summary": extractive_summary(description, snippet, title, summary_chars)})
    entity = F.least(F.lit(1.0), (F.size("suppliers") + F.size("regions")) / 2)
    query = F.when(F.col("query_group").isin(*D.QUERY_GROUPS), 1.0).otherwise(0.0)
    signal = F.when(F.size("signal_tags") > 0, 1.0).otherwise(0.0)
    has_category = F.when(F.col("category") != "general", 1.0).otherwise(0.0)
    complete = (_filled(title) + _filled(description) + _filled(snippet)) / 3
    strongest = F.coalesce(F.array_max(F.transform("_signals", lambda s: s["confidence"])), F.lit(0.0))
    r, c = D.RELEVANCE_WEIGHTS, D.CONFIDENCE_WEIGHTS
    bounded = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)
    a = a.withColumns({
        "relevance": bounded(r["signal"] * signal + r["query_group"] * query + r["entity"] * entity + r["category"] * has_category),
        "confidence": bounded(c["signal"] * strongest + c["entity"] * entity + c["category"] * has_category + c["completeness"] * complete),
        "priority_signal": F.get(F.filter("signal_tags", lambda t: t.isin(*D.PRIORITY_SIGNAL_TAGS)), F.lit(0)),
    })
    return a.drop("_text", "_signals")


def route(cached: Column, relevance: Column, confidence: Column, budget: Column, min_relevance: float = D.MIN_RELEVANCE, min_confidence: float = D.MIN_CONFIDENCE) -> tuple[Column, Column]:
    """(route, reason) in strict order: cache, too irrelevant, rules suffice, model, deferred."""
    cases = ((cached, "cached", "compatible_cache_hit"), (relevance < min_relevance, "skipped", "below_relevance_threshold"), (confidence >= min_confidence, "deterministic", "deterministic_confident"), (budget, "llm", "ambiguous_relevant"))
    where, why = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for condition, name, reason in cases[1:]:
        where, why = where.when(condition, name), why.when(condition, reason)
    return where.otherwise("deferred"), why.otherwise("llm_budget_exhausted")


def estimated_tokens(*texts: Column) -> Column:
    chars = sum((F.length(F.coalesce(t, F.lit(""))) for t in texts[1:]), F.length(F.coalesce(texts[0], F.lit(""))))
    return F.greatest(F.lit(1), F.floor(chars / 4).cast("int") + 400)


def reserve(candidates: DataFrame, run: str, place: str, tokens: str, max_calls: int = 5, max_tokens: int = 6000) -> DataFrame:
    """run, place, reserved: within a run, in order of place, each candidate that still fits both caps takes its share.

    A candidate that doesn't fit is passed over and a later, smaller one may fit, so this is a fold and no running sum.
    At most max_calls can be taken, so as many rounds each take the least place after the last taken that fits what is
    left. A round is a grouped minimum: a run of any size is aggregated where its rows lie and never gathered.
    """
    at = [F.col(place).cast("long").alias("place"), F.col(tokens).cast("long").alias("tokens")]
    alike = candidates.where(F.col(tokens) <= max_tokens).groupBy(run, *at).agg(F.count("*").alias("n"))
    state = alike.groupBy(run).agg(F.min(F.struct("place", "tokens", "n")).alias("next")).select(run, "next", F.lit(0).cast("long").alias("calls"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("taken"))
    some = F.col("next").isNotNull()
    fit = F.when(F.col("next.tokens") > 0, F.floor((max_tokens - F.col("used")) / F.col("next.tokens"))).otherwise(F.col("next.n"))
    took = F.when(some, F.least(F.col("next.n"), max_calls - F.col("calls"), fit)).otherwise(0)
    for k in range(max_calls):
        if k > 0:
            held = state.select(run, F.struct("at", "calls", "used", "taken").alias("held"))
            left = F.col("held.at").isNotNull() & (F.struct("place", "tokens") > F.struct("held.at.place", "held.at.tokens")) & (F.col("held.calls") < max_calls) & (F.col("held.used") + F.col("tokens") <= max_tokens)
            state = alike.join(held, run).groupBy(run).agg(F.any_value("held").alias("held"), F.min(F.when(left, F.struct("place", "tokens", "n"))).alias("next")).select(run, "next", "held.calls", "held.used", "held.taken")
        state = state.select(run, F.col("next").alias("at"), (F.col("calls") + took).alias("calls"), F.when(some, F.col("used") + took * F.col("next.tokens")).otherwise(F.col("used")).alias("used"), F.when(some, F.concat("taken", F.array("next.place"))).otherwise(F.col("taken")).alias("taken"))
    reserved = state.select(run, F.explode("taken").alias("_place")).distinct().withColumn("reserved", F.lit(True))
    found = candidates.withColumn("_place", F.col(place).cast("long")).join(reserved, [run, "_place"], "left").drop("_place")
    return found.withColumn("reserved", F.coalesce("reserved", F.lit(False)))


def content_fingerprint(policy: str, taxonomy: str, columns: tuple[str, ...] = ("language", "title", "description", "content_snippet")) -> Column:
    """SHA-256 of versions and content as a JSON list: compatibility-composed, lower case, white space as one space, ASCII-escaped.

    Spark has no Unicode normalisation and JSON writer that escapes, so the exact bytes are made in Arrow batches.
    """

    @F.pandas_udf("string")
    def hashed(fields: pd.DataFrame) -> pd.Series:
        plain = lambda v: "" if v is None else " ".join(unicodedata.normalize("NFKC", v).lower().split())
        return pd.Series([hashlib.sha256(json.dumps([plain(v) for v in (policy, taxonomy, *row)], separators=(",", ":")).encode()).hexdigest() for row in fields.itertuples(index=False, name=None)])

    return hashed(F.struct(*columns))


def translation_key(language: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", language, text), 256)



def parsed_answer(answer: Column) -> Column:
    """A model's answer as a struct of checked fields, or null: the outermost {...} must be JSON with a fit summary.

    The summary must be text of 10 to 1,000 characters and a category must be there; one that is no text or no known
    category is general. Tags, if given, must be a list of texts, of which the known ones stay; entity lists keep
    their texts, stripped, each once, and anything else counts as an empty list.
    """
    first, last = F.instr(answer, "{"), F.length(answer) - F.instr(F.reverse(answer), "}") + 1
    read = F.try_parse_json(F.when((first > 0) & F.contains(answer, F.lit("}")) & (last > first), F.substring(answer, first, last - first + 1)))
    got = lambda path, kind: F.try_variant_get(read, path, kind)
    kind = lambda path: F.schema_of_variant(got(path, "variant"))
    is_text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    listed = lambda path: F.coalesce(F.when(F.coalesce(kind(path).startswith("ARRAY"), F.lit(False)), got(path, "array<variant>")), F.expr("cast(array() as array<variant>)"))
    of_text = lambda path: F.transform(F.filter(listed(path), lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))), lambda v: F.try_variant_get(v, "$", "string"))
    summary, category = got("$.summary", "string"), F.lower(got("$.category", "string"))
    known = canonical_category(category)
    tags = of_text("$.signal_tags")
    fit = is_text("$.summary") & F.length(summary).between(10, 1000) & kind("$.category").isNotNull()
    fit = fit & (kind("$.signal_tags").isNull() | (kind("$.signal_tags").startswith("ARRAY") & (F.size(tags) == F.size(listed("$.signal_tags")))))
    fields = F.struct(
        summary.alias("summary"), F.when(is_text("$.category") & known.isin(*D.CATEGORIES), known).otherwise("general").alias("category"), canonical_tags(tags).alias("signal_tags"),
        F.when(is_text("$.priority_signal"), canonical_tag(got("$.priority_signal", "string"))).alias("priority_signal"),
        *(union_distinct(of_text(f"$.detected_{k}")).alias(f"detected_{k}") for k in ("suppliers", "regions", "categories")),
    )
    return F.when(F.coalesce(fit, F.lit(False)), fields)


def later_copies(articles: DataFrame, fingerprint: str, place: str) -> Column:
    """Whether an earlier row of the batch has the same fingerprint: it is served from the cache."""
    return F.row_number().over(Window.partitionBy(fingerprint).orderBy(place)) > 1

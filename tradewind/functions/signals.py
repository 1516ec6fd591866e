"""Signals, categories, regions and suppliers found in text: literal patterns and maps built once from the dictionaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.functions.text import contains_any, let, normal, phrases_in, quoted, strip, union_distinct


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def classify(text: Column, headline: Column) -> Column:
    """array<struct<signal_type, confidence, severity, impact_areas>> in rule order: a rule fires where text or headline holds a keyword."""

    def fired(low: Column) -> Column:
        found = []
        for kind, confidence, severity, areas, words in D.SIGNAL_RULES:
            found.append(F.when(contains_any(low, words), F.struct(F.lit(kind).alias("signal_type"), F.lit(confidence).alias("confidence"), F.lit(severity).alias("severity"), F.array(*map(F.lit, areas)).alias("impact_areas"))))
        return F.array_compact(F.array(*found))

    # No keyword holds a line end, so none can span the two.
    return let(F.lower(F.concat_ws("\n", headline, text)), fired)


def expanded(terms: Column) -> Column:
    """array<string> of normal terms with every alias; a null element stands for the term "none"."""
    table = F.create_map(*(x for term, group in sorted(D.SIGNAL_CLOSURE.items()) for x in (F.lit(term), F.array(*map(F.lit, sorted(group))))))
    base = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: normal(F.coalesce(t, F.lit("none"))))
    spelled = F.filter(F.flatten(F.transform(base, lambda t: F.array(t, F.replace(t, F.lit(" "), F.lit("_")), F.replace(t, F.lit("_"), F.lit(" "))))), lambda t: t != "")
    more = F.flatten(F.transform(spelled, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(spelled, more)))


def canonical_tag(value: Column) -> Column:
    """The stored tag of a spelling, or the first in canonical order among its aliases; null if none."""
    table = {}
    for term, group in D.SIGNAL_CLOSURE.items():
        tag = next((t for t in D.SIGNAL_TAG_ORDER if t in group), None)
        if tag:
            table[term] = tag
    for tag in D.SIGNAL_TAG_ORDER:
        table |= {v: tag for v in D.signal_variants(tag)}
    return F.try_element_at(literal_map(table), normal(value))


def canonical_tags(values: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(values, F.array().cast("array<string>")), canonical_tag)))


def regions(text: Column) -> Column:
    """Canonical regions whose alias stands in the text between non-letters, in dictionary order; one pass for all aliases."""
    known = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(c).alias("region")) for a, c in D.REGION_ALIASES.items()))
    named = lambda found: F.array_distinct(F.transform(F.filter(known, lambda k: F.array_contains(found, k["alias"])), lambda k: k["region"]))
    return let(phrases_in(F.lower(F.coalesce(text, F.lit(""))), D.REGION_ALIASES, "a-z"), named)


def canonical_region(value: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(D.REGION_ALIASES), F.lower(strip(value))), strip(value))


#: COMPANY_SUFFIX with letters, digits and white space of ASCII alone at a word's edges and between words.
_edge = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_ASCII_SUFFIX = D.COMPANY_SUFFIX.replace(r"\b", _edge).replace(r"\s", r"[\t\n\f\r ]")


def suppliers(text: Column, ascii_only: bool = False) -> Column:
    """Known suppliers, longest name first and then by name, and names that end in a company suffix, each once.

    With ascii_only a letter beyond ASCII ends a word, as in SQL's patterns; else it belongs to it."""
    suffix = _ASCII_SUFFIX if ascii_only else D.COMPANY_SUFFIX
    text = F.coalesce(text, F.lit(""))
    known = sorted(D.KNOWN_SUPPLIERS, key=lambda s: (-len(s), s))
    found = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(s)) & text.rlike(f"(?<![A-Za-z]){quoted(s)}(?![A-Za-z])"), s) for s in known)))
    named = F.transform(F.regexp_extract_all(text, F.lit(suffix), F.lit(1)), lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", ""))
    return F.array_distinct(F.filter(F.concat(found, named), lambda x: x != ""))


def category_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip(value)), r"(?U)[-_\s]+", " "))


def canonical_category(value: Column) -> Column:
    """A category's own name, its alias's, or the one with most keywords among the words, the first of equals; else the key itself."""

    names = D.CATEGORY_KEYWORDS.items()
    telling = F.array(*map(F.lit, sorted({w for _, k in names for w in k})))

    def scored(words: Column) -> Column:
        return F.array_max(F.array(*(F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, k)))).alias("score"), F.lit(-i).alias("place"), F.lit(c).alias("name")) for i, (c, k) in enumerate(names))))

    def named(key: Column) -> Column:
        best = let(let(F.array_intersect(F.split(key, " "), telling), scored), lambda b: F.when(b["score"] > 0, b["name"]))
        return F.when(key.isin(*D.CATEGORIES), key).otherwise(F.coalesce(F.try_element_at(literal_map(D.CATEGORY_ALIASES), key), best, key))

    return let(category_key(value), named)


def inferred_category(candidates: Iterable[tuple[Column, int]]) -> Column:
    """The category with most weight over the candidates, the first seen of equals; general if none counts."""
    votes = [F.struct(canonical_category(F.coalesce(c, F.lit(""))).alias("name"), F.lit(w).alias("weight")) for c, w in candidates]

    def tallied(counted: Column) -> Column:
        weight = lambda v: F.aggregate(counted, F.lit(0), lambda a, x: a + F.when(x["name"] == v["name"], x["weight"]).otherwise(0))
        return F.array_max(F.transform(counted, lambda v, i: F.struct(weight(v).alias("score"), (-i).alias("place"), v["name"].alias("name"))))

    counted = F.filter(F.array(*votes), lambda v: v["name"].isin(*(c for c in D.CATEGORIES if c != "general")))
    return F.coalesce(let(counted, tallied)["name"], F.lit("general"))


def impact(signal_type: Column, severity: Column) -> list[Column]:
    """Impact on procurement, supply chain, compliance and pricing, each at most 1, and their mean."""
    factor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in D.SEVERITY_FACTOR.items() for x in p)), severity), F.lit(D.SEVERITY_FACTOR_DEFAULT))
    four = []
    for k, name in enumerate(("procurement", "supply_chain", "compliance", "pricing")):
        base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for t, v in D.IMPACT.items() for x in (t, v[k]))), signal_type), F.lit(D.IMPACT_DEFAULT[k]))
        four.append(F.least(F.lit(1.0), base * factor).alias(f"{name}_impact"))
    return [*four, ((four[0] + four[1] + four[2] + four[3]) / 4).alias("overall_risk_score")]


def severity_rank(severity: Column) -> Column:
    """0 for the weakest, and for what is no severity."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in D.SEVERITY_RANK.items() for x in p)), severity), F.lit(0))


__all__ = ["canonical_category", "canonical_region", "canonical_tag", "canonical_tags", "category_key", "classify", "expanded", "impact", "inferred_category", "literal_map", "regions", "severity_rank", "suppliers", "union_distinct"]

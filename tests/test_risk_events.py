"""Risk events of whole articles against a plain version of the rules, one article at a time."""

import re

from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.functions.text import phrases_in
from tradewind.operators import risk
from tradewind.plans import QUERIES, articles


def phrase(text, terms):
    return any(re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text) for t in terms)


def search_terms(values):
    types = {D.normal_term(a): t for t in D.RISK_TYPE_ORDER for a in (*D.RISK_ALIASES[t], t)}
    out = set()
    for v in values:
        v = " ".join(v.lower().split())
        out |= D.risk_terms(types[v]) if v in types else D.expand_terms([v]) if v in D.SIGNAL_CLOSURE else {v, v.replace(" ", "_"), v.replace("_", " ")}
    return out


def events_of(row):
    text = " ".join(p.strip() for p in (row.title, row.summary, row.description, row.content_snippet) if p and p.strip())
    low, norm = text.lower(), " ".join(text.lower().split())
    terms = search_terms(v for v in (row.priority_signal, *row.signal_tags) if v)
    acts = bool(terms & risk.ACTION_TERMS) or phrase(norm, [t for t in risk.ACTION_TERMS if len(t) >= 3])
    found = []
    for place, kind in enumerate(D.RISK_TYPE_ORDER):
        own, exact = risk.text_terms(kind), kind in D.RISK_EXACT_PHRASES
        in_text = phrase(norm, own if exact else [t for t in own if len(t) >= 3])
        meta = bool(terms & D.risk_terms(kind)) and (in_text or not exact)
        if not (in_text or meta) or (kind in ("geopolitical", "regional_conflict") and not acts):
            continue
        score = min(0.95, 0.5 + 0.25 * meta + 0.25 * in_text + 0.05 * bool(row.priority_signal) + 0.03 * bool(row.suppliers) + 0.02 * bool(row.regions))
        if score < 0.55 - 1e-9:
            continue
        severity = D.RISK_SEVERITY[kind]
        if any(w in low for w in D.SEVERITY_OVERRIDE_WORDS):
            severity = "critical" if kind in D.SEVERITY_OVERRIDE_CRITICAL else "high"
        at = min((low.index(t) for t in own if t in low), default=None)
        evidence = text[:260] if at is None else text[max(0, at - 90) : at + 170]
        found.append((place, kind, severity, round(score, 6), evidence.strip()))
    pair = [e for e in found if e[0] < 2]
    if len(pair) == 2:
        found.remove(pair[0] if pair[1][3] > pair[0][3] else pair[1])
    return {e[1:] for e in found}


def test_events_of_whole_articles(spark, sf):
    rows = articles.analysed(spark, sf).collect()
    got = {}
    for x in QUERIES["risk_events_detected"](spark, sf).collect():
        got.setdefault(x.id, set()).add((x.risk_type, x.severity, x.confidence, x.evidence_snippet))
        assert len(x.event_key) == 40
    want = {r.id: e for r in rows if (e := events_of(r))}
    assert len(want) > 50 and got == want


def test_places_are_looked_up_once_an_article(spark):
    rows = [(1, "new tariff and port strike in China", ["tariff"], "tariff", ["x"], ["y"], ["z"])]
    articles = spark.createDataFrame(rows, "id long, text string, signal_values array<string>, priority_signal string, detected_suppliers array<string>, detected_regions array<string>, categories array<string>")
    found = risk.detect(articles)
    behind = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "split(" not in behind
    assert {tuple(r.affected_locations) for r in found.collect()} == {("y", "China")}


def test_terms_stand_between_no_letters(spark):
    said = lambda text, *terms: set(spark.createDataFrame([(text,)], "t string").select(phrases_in(F.col("t"), terms)).first()[0])
    assert said("xé a. é a m&a u.s. u.sa nota recall", "é a", "m&a", "u.s.", "not", "recall") == {"é a", "m&a", "u.s.", "recall"}
    assert said("xé a", "é a") == set()
    assert said("recalls", "recall", "recall order") == set() == said("", "m&a")

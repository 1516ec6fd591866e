"""Feeds by preferences against a plain matcher over every user and article."""

import random
import re
from datetime import datetime, timedelta

import pytest

from tradewind import dictionaries as D
from tradewind.functions.signals import canonical_category, regions
from tradewind.operators import personal, preferences
from pyspark.sql import functions as F

ARTICLE = "id long, processed_at timestamp, title string, summary string, category string, categories array<string>, suppliers array<string>, supplier_ids array<string>, regions array<string>, priority_signal string, signal_tags array<string>"
LISTS = [f"{side}_{kind}" for side in ("wanted", "excluded") for kind in preferences.WISHES]
USER = "user_id long, " + ", ".join(f"{c} array<string>" for c in LISTS)


def token_set(values):
    return {v.strip().lower() for v in values or [] if v and v.strip()}


def region_set(values):
    return {D.REGION_ALIASES.get(v, v).lower() for v in token_set(values)}


def in_text(text, terms):
    return {t for t in terms if len(t) >= 3 and re.search(r"(?<![a-z0-9])" + re.escape(t) + r"(?![a-z0-9])", text)}


def plain(article, user, canonical, text_regions):
    """The scores of an article for a user, or None if it is left out."""
    text = " ".join(x.strip().lower() for x in (article["title"] or "", article["summary"] or "") if x.strip())
    want, drop = ({k: user[f"{side}_{k}"] or [] for k in preferences.WISHES} for side in ("wanted", "excluded"))
    cats = lambda values: {canonical[v] for v in values if v}
    ids, names = token_set(article["supplier_ids"]), token_set(article["suppliers"])
    places = region_set(article["regions"]) | {r.lower() for r in text_regions[article["id"]]}
    context = " ".join((text + " " + " ".join(sorted(places))).split())
    own = D.expand_terms([article["priority_signal"] or "none", *(article["signal_tags"] or [])])
    every = own | D.expand_terms(places)
    terms = {side: D.expand_terms(x["signals"]) if x["signals"] else frozenset() for side, x in (("want", want), ("drop", drop))}
    mine = cats([article["category"], *(article["categories"] or [])])
    hit = lambda t: bool(every & t or in_text(context, t))
    if ids & token_set(drop["supplier_ids"]) or names & token_set(drop["suppliers"]) or mine & cats(drop["categories"]) or places & region_set(drop["regions"]) or terms["drop"] and hit(terms["drop"]):
        return None
    wc, ws, wr = cats(want["categories"]), token_set(want["suppliers"]), region_set(want["regions"])
    said = in_text(text, ws)
    supplier = bool(ids & token_set(want["supplier_ids"])) if ids else bool(names & ws or said)
    if not (mine & wc or supplier if wc or ws else places & wr if wr else hit(terms["want"]) if terms["want"] else True):
        return None
    graded = lambda n: min(1.0, 0.5 + 0.25 * n) if n else 0.3
    c = 0.5 if not wc else 1.0 if canonical[article["category"] or ""] in wc else 0.3
    s = 0.5 if not (names | said) or not ws else graded(len((names | said) & ws) + len(ids & token_set(want["supplier_ids"])))
    r = 0.5 if not places or not wr else graded(len(places & wr))
    first = D.expand_terms([article["priority_signal"]]) if article["priority_signal"] else frozenset()
    g = 0.5 if not terms["want"] else 1.0 if first & terms["want"] else graded(len(own & terms["want"]) + bool(in_text(context, terms["want"])))
    return (c, s, r, g, c * 0.3 + s * 0.3 + r * 0.2 + g * 0.2)


@pytest.mark.parametrize("limit, stretch", [(5, 100), (40, 7)])
def test_feeds(spark, monkeypatch, limit, stretch):
    monkeypatch.setattr(personal, "STRETCH", stretch)
    monkeypatch.setattr(personal, "FIRST", stretch)
    r = random.Random(limit)
    some = lambda values, most: r.sample(values, r.randrange(most + 1)) if r.random() < 0.6 else r.choice([None, []])
    cats, sups, ids = ["chips", "automotive", "Raw Materials", "general", "odd things"], ["Siemens AG", "bosch", " ABB", "Acme Co."], ["s1", "s2", "s3"]
    places, signals = ["Germany", "us", "Hormuz", "Atlantis"], ["tariff", "port strike", "recall", "sanctions", "my own term"]
    articles = []
    for i in range(140):
        title = " ".join(r.choice(["Siemens AG", "cabbage", "tariff", "strikes", "port strike", "in Germany", "near the red sea", "my own term", "abb,", "Acme Co."]) for _ in range(r.randrange(4)))
        articles.append((i, datetime(2024, 1, 1) + timedelta(hours=r.randrange(20)), title, r.choice([None, "", "a recall"]), r.choice([None, *cats]), some(cats, 2), some(sups, 2), some(ids, 2), some(places, 2), r.choice([None, *signals]), some(signals, 2)))
    users = []
    for u in range(60):
        users.append((u, *(some(v, 2) if r.random() < (0.6 if k < 5 else 0.35) else None for k, v in enumerate([cats, sups, ids, places, signals] * 2))))
    users += [(100, *[None] * 10), (101, *[[]] * 10), (102, *[None] * 5, cats + [""], None, None, None, None)]
    a, u = spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(users, USER)
    names = sorted({c for x in articles for c in (x[4] or "", *(x[5] or []))} | set(cats) | {""})
    canonical = {x.v: x.c for x in spark.createDataFrame([(n,) for n in names], "v string").select("v", canonical_category(F.col("v")).alias("c")).collect()}
    said = F.lower(F.concat_ws(" ", "title", "summary"))
    text_regions = {x.id: x.found for x in a.select("id", regions(said).alias("found")).collect()}
    want = {}
    for user in users:
        user = dict(zip(["user_id", *LISTS], user))
        scored = []
        for x in articles:
            x = dict(zip([c.split()[0] for c in ARTICLE.split(", ")], x))
            if (m := plain(x, user, canonical, text_regions)) and m[4] >= 0.3:
                scored.append((-round(m[4], 9), -x["processed_at"].timestamp(), x["id"], m))
        for place, (_, _, i, m) in enumerate(sorted(scored)[:limit], 1):
            want[user["user_id"], i] = (place, *(round(v, 9) for v in m))
    got = {(x.user_id, x.id): (x.rank, *(round(v, 9) for v in (x.category_match, x.supplier_match, x.region_match, x.signal_match, x.rank_score))) for x in preferences.feeds(a, u, limit).collect()}
    assert len(want) > 150 and not {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)}


def test_pairs_are_of_kinds_and_wishes(spark, monkeypatch):
    """Articles that differ in id and time alone, and profiles that differ in exclusions alone, are not all paired."""
    start, pairs = datetime(2024, 1, 1), preferences._pairs
    articles = [(i, start + timedelta(hours=i % 50), f"no {i}", None, "chips", None, None, ["s1"] if i % 3 else ["s2"], None, None, None) for i in range(240)]
    users = [(u, ["chips"], None, None, None, None, None, [f"Maker {u}"] if u % 4 else None, ["s2"] if u % 2 else None, None, None) for u in range(24)]
    counted = []
    monkeypatch.setattr(preferences, "_pairs", lambda *of: counted.append((found := pairs(*of)).count()) or found)
    got = preferences.feeds(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(users, USER), 90).collect()
    want = {u: [x[0] for x in sorted(articles, key=lambda x: (-x[1].timestamp(), x[0])) if x[7] == ["s1"] or u % 2 == 0][:90] for u in range(24)}
    assert counted == [2] and {u: [x.id for x in sorted(got, key=lambda x: x.rank) if x.user_id == u] for u in range(24)} == want


def test_empty(spark):
    a, u = spark.createDataFrame([], ARTICLE), spark.createDataFrame([(1, *[None] * 10)], USER)
    assert preferences.feeds(a, u).collect() == [] and preferences.feeds(a, u.where("false")).collect() == []

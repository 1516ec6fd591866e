"""Conversations, saved preferences and payload order on small tables."""

import itertools
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tradewind.functions.payload import ordered_text
from tradewind.operators import chat, dedup, lifecycle, personal, preferences, supply

T0 = datetime(2024, 1, 1)
at = lambda m: T0 + timedelta(minutes=m)


def test_conversations(spark):
    convs = spark.createDataFrame([("a", 1, at(0)), ("b", 1, at(5)), ("c", 1, at(9)), ("d", 2, at(0)), ("e", 1, at(10))], "conversation_id string, user_id long, created_at timestamp")
    rows = [("a", 1, 1, "user", "", at(1)), ("a", 1, 2, "user", "q" * 300, at(2)), ("a", 1, 3, "assistant", "x", at(20)), ("b", 1, 4, "user", "hello", at(6)), ("c", 1, 5, "assistant", "y", at(21)), ("d", 2, 6, "user", None, at(1)), ("a", 2, 7, "user", "not mine", at(3))]
    said = spark.createDataFrame(rows, "conversation_id string, user_id long, message_id long, role string, content string, created_at timestamp")
    of = {r.conversation_id: (r.title, r.message_count, r.last_message_at) for r in chat.threads(convs, said).collect()}
    assert of["a"] == ("q" * 200, 2, at(20)) and of["b"] == ("hello", 0, None) and of["c"] == (None, 2, at(21)) and of["d"] == (None, 0, None) and of["e"] == (None, 0, None)
    places = {(r.user_id, r.place): r.conversation_id for r in chat.listed(chat.threads(convs, said)).collect()}
    assert places == {(1, 1): "e", (1, 2): "b", (1, 3): "c", (1, 4): "a", (2, 1): "d"}
    assert sorted((r.conversation_id, r.place, r.message_id, r.total_count) for r in chat.history(convs, said).collect() if r.conversation_id == "a") == [("a", 1, 1, 3), ("a", 2, 2, 3), ("a", 3, 3, 3)]
    cleared = spark.createDataFrame([(1, at(5)), (1, at(2)), (3, at(1))], "user_id long, cleared_at timestamp")
    assert sorted(r.conversation_id for r in chat.left_after(convs, cleared, "created_at").collect()) == ["c", "d", "e"]


def test_saved_preferences(spark):
    lists = ("preferred_categories", "preferred_suppliers", "preferred_regions", "preferred_signals", "excluded_categories", "excluded_topics", "excluded_suppliers", "excluded_regions", "excluded_signals")
    schema = "user_id long, " + ", ".join(f"{n} array<string>" for n in lists) + ", platform_language string"
    row = lambda user, lang=None, **x: (user, *(x.get(n) for n in lists), lang)
    s = spark.createDataFrame([(1, "p1", "Acme", True), (2, "p2", "Bosch GmbH", True)], "id long, public_id string, canonical_name string, is_active boolean")
    stored = spark.createDataFrame([row(1, "de", **{n: ["x"] for n in lists}), row(2, "fr", **{n: ["x"] for n in lists})], schema)
    asks = [(1, row(1, preferred_suppliers=["ACME", "Nobody"], excluded_categories=[], excluded_topics=["chips"])), (2, row(1, " EN ", excluded_topics=["Chips", "electronics"])), (1, row(3, excluded_categories=[], excluded_topics=["chips"], excluded_suppliers=["bosch", "Acme"])), (2, row(3, "", preferred_suppliers=[])), (1, row(4, excluded_categories=["automotive"], excluded_topics=["chips"]))]
    requests = spark.createDataFrame([(*r, p) for p, r in asks], schema + ", place int")
    got = {r.user_id: r for r in preferences.saved(stored, requests, supply.register(s), s).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[2].excluded_categories == ["x"] and got[2].preferred_supplier_ids is None and got[2].platform_language == "fr"
    assert (got[1].preferred_suppliers, got[1].preferred_supplier_ids, got[1].excluded_categories, got[1].excluded_topics, got[1].platform_language, got[1].preferred_regions) == (["ACME", "Nobody"], ["p1"], ["electronics"], ["electronics"], "en", ["x"])
    assert (got[3].excluded_categories, got[3].excluded_topics, got[3].excluded_supplier_ids, got[3].preferred_regions) == (["electronics"], ["electronics"], ["p1", "p2"], [])
    assert (got[4].excluded_categories, got[4].excluded_topics) == (["automotive"], ["electronics"])
    feed = spark.createDataFrame([(1, 5), (2, 6)], "user_id long, id long")
    assert [r.user_id for r in preferences.feeds_left(feed, requests).collect()] == [2]


def test_retry_seconds(spark):
    rows = spark.createDataFrame([("normalise", 1), ("normalise", 6), ("enrich", 3), ("release", 1), ("task", 0), ("task", 3), ("other", 1)], "stage string, attempt long")
    assert [r.s for r in rows.select(lifecycle.retry_seconds(F.col("stage"), F.col("attempt")).alias("s")).collect()] == [900, 21600, 7200, 60, 60, 480, None]


def test_payload_order(spark):
    """Payloads that differ in the order of keys alone are one; a float is not the integer of its value; arrays keep their order."""
    assert ordered_text('{"a":1,"b":{"c":[1,2.0],"d":null}}') == ordered_text(' {"b": {"d": null, "c": [1, 2.0]}, "a": 1}')
    texts = [None, "", "no json", '{"a":1}', '{"a":1.0}', '{"a":1.50}', '{"a":[1,2]}', '{"a":[2,1]}', '{"a":{"b":1}}', "[]", "{}", "1", "1.0", '"1"', "true", "null", '{"é":1}', '{"a":12345678901234567890}']
    keys = [ordered_text(t) for t in texts]
    assert len(set(keys)) == len(texts) and ordered_text('{"a":1.50}') == ordered_text('{"a":1.5}')
    r = random.Random(3)
    pay = [{"k": 1, "z": [1, {"q": 2.0, "p": "x"}]}, {"k": 1.0, "z": []}, {"k": 1, "z": [1, {"q": 2, "p": "x"}]}]
    spelt = [json.dumps(dict(r.sample(list(p.items()), len(p)))) for p in pay for _ in range(2)]
    least = min(map(ordered_text, spelt))
    for order in itertools.islice(itertools.permutations(range(len(spelt))), 0, 720, 241):
        rows = [(k, "rss", "", f"t{k // 6}", "https://a.example/x", "blog", spelt[k % 6]) for k in order] + [(50, "rss", "", "t0", "https://a.example/y", "blog", None)]
        a = spark.createDataFrame(rows, "id long, provider string, provider_article_id string, title string, article_url string, source_class string, body string").withColumns({"description": F.lit(None).cast("string"), "published_at": F.lit(T0)})
        won = {x.article_url: x.body for x in dedup.winners(a, ["title"], payload="body").collect()}
        assert ordered_text(won["https://a.example/x"]) == least and won["https://a.example/y"] is None


def test_whole_lists_are_not_ranked_anew(spark):
    none = "cast(array() as array<string>)"
    articles = spark.range(1, 71).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as processed_at", "array('metals') as categories", f"{none} as suppliers", f"{none} as regions", f"{none} as signals")
    users = spark.range(1, 4).selectExpr("id as user_id", "array('metals') as wanted_categories", *(f"{none} as {c}" for c in personal.WANTED[1:]))
    had = spark.createDataFrame([(2, 70), (2, 68), (2, 5), (2, 5), (2, 900), *((3, k) for k in range(1, 71))], "user_id long, id long")
    made = personal.generate(articles, users, had)
    assert made._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    got = sorted((r.user_id, r["rank"], r.id) for r in made.collect())
    kept = {1: list(range(70, 20, -1)), 2: [69, *range(67, 18, -1)]}
    assert got == [(u, k, i) for u, ids in kept.items() for k, i in enumerate(ids, 1)]

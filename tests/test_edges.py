"""Edges of rules: times that are just in or out, long chains, repeated titles, own canonical URLs, languages."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradewind.operators import dedup, lifecycle, quality, stores, supply

T0 = datetime(2024, 1, 1)


def test_a_failure_two_hours_old_no_longer_counts(spark):
    rows = [(1, T0), (1, T0 + timedelta(minutes=1)), (1, T0 + timedelta(hours=2)), (2, T0), (2, T0 + timedelta(microseconds=1)), (2, T0 + timedelta(hours=2, microseconds=-1))]
    got = sorted((r.user_id, r.ts, r.n, r.wait_s) for r in lifecycle.throttled(spark.createDataFrame(rows, "user_id long, ts timestamp")).collect())
    assert [x[2:] for x in got] == [(1, None), (2, None), (2, None), (1, None), (2, None), (3, 1)]


def test_long_chains_of_merges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500), (600, 150)], "drop_id long, keep_id long")
    assert {r.drop_id: r.keep_id for r in supply.final_keepers(chain).collect()} == {**{i: 300 for i in range(300)}, 600: 300}
    with pytest.raises(ValueError):
        supply.final_keepers(spark.createDataFrame([(1, 2), (2, 1)], "drop_id long, keep_id long")).count()


def test_titles_that_a_source_repeats(spark):
    hour = lambda h: T0 + timedelta(hours=h)
    stored = spark.createDataFrame([("t", "s", hour(h)) for h in range(50)] + [("t", "other", hour(99)), ("u", "s", None), ("", "s", hour(1))], "ingest_hash string, source_name string, published_at timestamp")
    asked = [(1, "s", hour(97)), (2, "s", hour(98)), (3, "s", hour(0)), (4, "s", hour(-1)), (5, "other", hour(99)), (6, "other", hour(98)), (7, "s", None)]
    incoming = spark.createDataFrame([(i, s, at, f"x{i}", "t", f"y{i}") for i, s, at in asked], "id long, source_name string, published_at timestamp, url_hash string, title_hash string, ingest_hash string")
    got = {r.id: r.level for r in stores.duplicate_level(incoming, stored).collect()}
    assert got == {1: 2, 2: None, 3: 2, 4: None, 5: 2, 6: None, 7: None}
    by_second = sum(1 for r in stores.duplicate_level(incoming.unionByName(incoming), stored).collect() if r.level)
    assert by_second == 6


def test_a_feeds_own_canonical_url(spark):
    rows = [(1, "rss", "https://a.example/x?id=1", "https://a.example/story"), (2, "rss", "https://a.example/x?id=2", "https://a.example/story"), (3, "rss", "https://a.example/x?id=3", "")]
    a = spark.createDataFrame(rows, "id long, provider string, article_url string, own string").withColumns({"provider_article_id": F.lit(""), "title": F.lit("t"), "description": F.lit(None).cast("string"), "published_at": F.lit(T0), "source_class": F.lit("blog")})
    assert sorted(r.id for r in dedup.winners(a, ["id"]).collect()) == [1, 2, 3]
    assert sorted(r.id for r in dedup.winners(a, ["id"], "own").collect()) == [1, 3]


def test_normaliser_asks_the_language_gate(spark):
    rows = [(1, "The price of steel is up in the north", "en"), (2, "Der Preis von Stahl ist nicht hoch", "en"), (3, "Zzz qqq xxx yyy www", "en"), (4, "Der Preis von Stahl ist nicht hoch", "de"), (5, "short", "en")]
    a = spark.createDataFrame(rows, "id long, title string, language string").withColumns({"description": F.lit("something long enough to count as content"), "content_snippet": F.lit(None).cast("string"), "article_url": F.lit("https://www.reuters.com/a"), "published_at": F.lit(T0)})
    got = {r.id: (r.reject_reason, r.language) for r in quality.normalise(a, F.lit(T0)).collect()}
    assert got == {1: (None, "en"), 2: ("Language mismatch", "de"), 3: ("Language not detected", "en"), 4: (None, "de"), 5: ("Title too short", "en")}

"""Changes of stored tables on small rows with odd values, and the breaker in batch and stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tradewind.functions import text as T
from tradewind.operators import audit, enrich, lifecycle, stores, supply
from tradewind.streaming import ingest

OUTCOMES = "source_id long, ts timestamp, event_id long, ok boolean"


def outcomes():
    """Random outcomes of some sources, minutes or hours apart, and hand-made runs around the fifth failure."""
    r, rows, at = random.Random(3), [], dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    for source in range(40):
        t = at
        for _ in range(r.randrange(1, 40)):
            t += dt.timedelta(minutes=r.choice((1, 5, 20, 29, 30, 31, 90)))
            rows.append((source, t, len(rows), r.random() < 0.25))
    minute = lambda m: at + dt.timedelta(minutes=m)
    rows += [(100, minute(k), len(rows) + k, False) for k in range(5)] + [(100, minute(10), len(rows) + 9, True)]  # a success while open
    rows += [(101, minute(k), len(rows) + k, False) for k in range(5)] + [(101, minute(34), len(rows) + 9, True)]  # after the cooldown
    rows += [(102, minute(k), len(rows) + k, False) for k in range(4)] + [(102, minute(5), len(rows) + 9, True), (102, minute(6), len(rows) + 10, False)]
    return rows


def folded(rows):
    out = {}
    for source, ts, _, ok in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        failures, last = out.get(source, (0, None))
        if ok:
            out[source] = (0, None) if failures < 5 or ts >= last + dt.timedelta(minutes=30) else (failures, last)
        else:
            out[source] = (failures + 1, ts)
    return {s: (f, last if f >= 5 else None) for s, (f, last) in out.items()}


def test_circuits_by_brute_force(spark):
    rows = outcomes()
    got = {x.source_id: (x.failures, x.opened_at and x.opened_at.replace(tzinfo=dt.UTC)) for x in lifecycle.circuit_fold(spark.createDataFrame(rows, OUTCOMES)).collect()}
    want = folded(rows)
    assert {s: g[0] for s, g in got.items()} == {s: w[0] for s, w in want.items()}
    assert {s for s, g in got.items() if g[1]} == {s for s, w in want.items() if w[1]}
    assert got[100][0] == 5 and got[101][0] == 0 and got[102][0] == 1


def test_batch_and_stream_agree_on_circuits(spark, tmp_path):
    rows = outcomes()
    df = spark.createDataFrame(rows, OUTCOMES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.circuit_changes(ingest.stream_of(spark, str(tmp_path / "in"), OUTCOMES)).writeStream.format("memory").queryName("agree").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {x.source_id: x.state for x in spark.table("agree").orderBy("at").collect()}
    batch = {x.source_id: x.failures for x in lifecycle.circuit_fold(df).collect()}
    assert {s for s, f in batch.items() if f >= 5} == {s for s, state in last.items() if state != "closed"}


def test_nulls_and_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    feed = spark.createDataFrame([(1, 5, None), (1, None, True), (2, 5, False)], "user_id long, id long, is_read boolean")
    got = stores.marked(feed, spark.createDataFrame([(5,), (5,), (None,)], "id long"), ["id"], "is_read")
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(["(1, 5, True)", "(1, None, True)", "(2, 5, True)"])
    assert stores.membership(empty("a long, b long"), empty("a long, b long"), empty("a long, b long")).count() == 0
    raw = spark.createDataFrame([(1, "s", dt.datetime(2024, 1, 2), "", "t", "i"), (2, None, None, "u", None, None)], "id long, source_name string, published_at timestamp, url_hash string, title_hash string, ingest_hash string")
    stored = spark.createDataFrame([("t", "s", dt.datetime(2024, 1, 1)), ("", "s", dt.datetime(2024, 1, 1)), (None, None, None)], "ingest_hash string, source_name string, published_at timestamp")
    assert {x.id: x.level for x in stores.duplicate_level(raw, stored).collect()} == {1: 2, 2: None}
    assert lifecycle.circuit_fold(empty(OUTCOMES)).count() == 0


def test_merges_of_chains_and_circles(spark):
    chain = spark.createDataFrame([(3, 2), (4, 3), (5, 4), (6, 5), (9, 9)], "drop_id long, keep_id long")
    assert {(x.drop_id, x.keep_id) for x in supply.final_keepers(chain).collect()} == {(3, 2), (4, 2), (5, 2), (6, 2)}
    with pytest.raises(ValueError):
        supply.final_keepers(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "drop_id long, keep_id long"), most=6)


def test_names_beyond_ascii(spark):
    """Compatibility forms, case folding and accents, resolved through the registry without ascii_only."""
    s = spark.createDataFrame([(1, "p1", "Société Générale SA", True), (2, "p2", "Straße GmbH", True)], "id long, public_id string, canonical_name string, is_active boolean")
    names = spark.createDataFrame([("SOCIETE GENERALE",), ("société générale",), ("ＳＴＲＡＳＳＥ",), ("strasse gmbh",), ("nobody",), (None,)], "surface_form string")
    got = {x.surface_form: x.supplier_id for x in supply.resolve(names, supply.register(s), s).collect()}
    assert got == {"SOCIETE GENERALE": 1, "société générale": 1, "ＳＴＲＡＳＳＥ": 2, "strasse gmbh": 2, "nobody": None, None: None}
    asked = spark.createDataFrame([(1, 1, "STRASSE"), (2, 2, "Straße"), (3, 1, "neu"), (4, 2, "NEU"), (5, 1, "!")], "request_id long, supplier_id long, name string")
    assert {x.request_id: x.outcome for x in supply.claims_of_aliases(asked, supply.register(s)).collect()} == {1: "conflict", 2: "own", 3: "added", 4: "conflict", 5: "empty"}


def test_content_fingerprint_is_of_ascii_escaped_json(spark):
    import hashlib

    rows = spark.createDataFrame([("EN", " Ｆｕｌｌ  Width é", None, "x\ny")], "language string, title string, description string, content_snippet string")
    want = hashlib.sha256(b'["p","t","en","full width \\u00e9","","x y"]').hexdigest()
    assert rows.select(enrich.content_fingerprint("p", "t").alias("f")).first().f == want


def test_answers_that_are_null_or_hold_braces(spark):
    given = [None, "", "}{", '{"summary": "Holds {braces} inside", "category": "logistics", "priority_signal": "tariff"}', '[{"summary": "x"}]']
    got = [x.m for x in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, a string").orderBy("k").select(enrich.parsed_answer(F.col("a")).alias("m")).collect()]
    assert got[:3] == [None, None, None] and got[3].summary == "Holds {braces} inside" and got[3].priority_signal == "tariff" and got[4] is None


def test_scrubbing_and_names_in_text(spark):
    rows = spark.createDataFrame([('{"Password": {"a": 1}, "b": [{"api_key": null}, 2]}',), ("not json",), (None,)], "d string")
    assert [x.s for x in rows.select(audit.scrub_detail(F.col("d")).alias("s")).collect()] == ['{"Password":"[redacted]","b":[{"api_key":"[redacted]"},2]}', "not json", None]
    pairs = [("ABB grows", "abb", True), ("cabbage", "abb", False), ("3m-long", "3m", False), ("Bosch-owned", "Bosch", True), ("a (b+c) d", "(b+c)", True), (r"x \E y", r"\E y", True), (None, "abb", False), ("abb", None, False)]
    got = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(pairs)], "k int, t string, n string").orderBy("k").select(T.names(F.col("t"), F.col("n")).alias("hit")).collect()
    assert [x.hit for x in got] == [hit for *_, hit in pairs]


def test_append_absent_by_day(spark, tmp_path):
    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    schema = "ingest_hash string, published_at timestamp"
    for keys in (["a1", "b2", "b2"], ["b2", "c9"], ["a1", "d1"]):
        spark.createDataFrame([(k, dt.datetime(2024, 1, int(k[1]))) for k in keys], schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        assert ingest.append_absent(ingest.stream_of(spark, src, schema), out, marks, at="published_at").awaitTermination(60)
    assert sorted(r.ingest_hash for r in spark.read.parquet(out).collect()) == ["a1", "b2", "c9", "d1"]

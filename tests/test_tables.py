"""Stored tables: deletion by day, counters that are not counted twice, batches that break off and go on."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradewind.operators import rates, supply, tables

NOW = datetime(2024, 3, 10, 12)


def test_delete_before(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, NOW - timedelta(hours=7 * i)) for i in range(30)] + [(99, None)]
    for unit in ("day", "month"):
        tables.create(spark.createDataFrame(rows, "id long, at timestamp"), path, "at", unit)
        cutoff = NOW - timedelta(days=4)
        old = {i for i, t in rows if t and t < cutoff}
        assert any(t == cutoff - timedelta(hours=2) for _, t in rows) and tables.delete_before(spark, path, "at", cutoff, unit) == len(old)
        left = lambda: {r.id for r in spark.read.parquet(path).collect()}
        assert left() == {i for i, _ in rows} - old and tables.delete_before(spark, path, "at", cutoff, unit) == 0
        assert tables.delete_before(spark, path, "at", cutoff.replace(hour=0), unit) == 0 and left() == {i for i, _ in rows} - old
        assert tables.delete_before(spark, path, "at", NOW + timedelta(days=40), unit) == 30 - len(old) and left() == {99}
    assert tables.delete_before(spark, str(tmp_path / "none"), "at", NOW) == 0


def test_usage_is_counted_once(spark, tmp_path):
    folder = str(tmp_path)
    usage = lambda rows: spark.createDataFrame([(t, datetime(2024, 1, d).date(), n) for t, d, n in rows], "tenant string, spend_date date, tokens long")
    held = lambda: {(r.tenant, r.day.day): (r.tokens_used, r.calls_made) for r in spark.read.parquet(f"{folder}/counters").collect()}
    tables.record_usage(usage([("a", 1, 5), ("a", 1, 6), ("b", 2, 1)]), folder, "one")
    tables.record_usage(usage([("a", 1, 10), ("a", 3, 2)]), folder, "two")
    want = {("a", 1): (21, 3), ("b", 2): (1, 1), ("a", 3): (2, 1)}
    assert held() == want
    tables.record_usage(usage([("a", 1, 10), ("a", 3, 2)]), folder, "two")
    tables.record_usage(usage([]), folder, "none")
    assert held() == want


def test_batches_go_on_from_the_cursor(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(i, f"v{i}") for i in (5, 1, 9, 3, 7, 11, 2)] + [(None, "x")], "id long, v string")
    calls = []

    def work(batch):
        calls.append(sorted(r.id for r in batch.collect()))
        if len(calls) == 2:  # a run that breaks off behind its first output
            batch.write.mode("overwrite").parquet(f"{folder}/seen/batch=1")
            raise RuntimeError("lost")
        return {"seen": batch}

    with pytest.raises(RuntimeError):
        tables.run_batches(rows, "id", 3, folder, work)
    assert sorted(r.id for r in tables.done_so_far(spark, folder, "seen").collect()) == [1, 2, 3] and tables.cursor(spark, folder) == (1, 3)
    assert tables.run_batches(rows, "id", 3, folder, work, 1) == 1 and tables.run_batches(rows, "id", 3, folder, work) == 1 and tables.run_batches(rows, "id", 3, folder, work) == 0
    assert calls == [[1, 2, 3], [5, 7, 9], [5, 7, 9], [11]]
    assert sorted((r.id, r.batch) for r in tables.done_so_far(spark, folder, "seen").collect()) == [(1, 0), (2, 0), (3, 0), (5, 1), (7, 1), (9, 1), (11, 2)]
    more = rows.unionByName(spark.createDataFrame([(20, "n")], rows.schema))
    assert tables.run_batches(more, "id", 3, folder, work) == 1 and tables.cursor(spark, folder) == (4, 20)


def test_batches_of_one_pass(spark, tmp_path):
    """Several batches go through the work at once, as they would one by one."""
    folder = str(tmp_path)
    rows = spark.createDataFrame([(i,) for i in (5, 1, 9, 3, 7, 11, 2, None, 20, 13)], "id long")
    calls = []

    def work(batch):
        calls.append(sorted((r.batch, r.id) for r in batch.collect()))
        if len(calls) == 2:  # a run that breaks off behind its first output
            batch.withColumnRenamed("batch", tables.IN_PASS).write.mode("overwrite").parquet(f"{folder}/seen/batch=1")
            raise RuntimeError("lost")
        return {"seen": batch}

    run = lambda most=None, of=rows: tables.run_batches(of, "id", 2, folder, work, most, 3)
    seen = lambda: sorted((r.batch, r.id) for r in tables.done_so_far(spark, folder, "seen").collect())
    assert run(1) == 1 and tables.cursor(spark, folder) == (1, 2)
    with pytest.raises(RuntimeError):
        run()
    assert seen() == [(0, 1), (0, 2)] and run(2) == 2 and tables.cursor(spark, folder) == (3, 9)
    assert run() == 2 and run() == 0 and tables.cursor(spark, folder) == (5, 20)
    assert calls[2:] == [[(1, 3), (1, 5), (2, 7), (2, 9)], [(3, 11), (3, 13), (4, 20)]]
    assert seen() == [(0, 1), (0, 2), (1, 3), (1, 5), (2, 7), (2, 9), (3, 11), (3, 13), (4, 20)]
    assert run(of=spark.createDataFrame([(21,)], "id long")) == 1 and seen()[-1] == (5, 21)


def test_lists_resolved_anew(spark):
    s = spark.createDataFrame([(1, "p1", "Acme", True), (2, "p2", "Müller", True), (3, "p3", "Gone", False)], "id long, public_id string, canonical_name string, is_active boolean")
    rows = spark.createDataFrame([(1, ["müller", "ACME", "acme "], None), (2, ["Gone", "Nobody"], ["p3"]), (3, None, []), (4, ["Acme"], ["p1"]), (5, [None, ""], None)], "k long, names array<string>, ids array<string>")
    got = {r.k: (r.ids, r.changed) for r in supply.re_resolved_lists(rows, "k", "names", "ids", supply.register(s), s).collect()}
    assert got == {1: (["p1", "p2"], True), 2: ([], True), 3: ([], False), 4: (["p1"], False), 5: ([], False)}


def test_rates(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("a", 1, 10, 1), ("a", 4, 13, 2), ("a", 9, 2, 3), ("a", 11, 2, 4), ("b", 2, 7, 5), ("a", 31, 9, 6), ("a", 31, 12, 7)]
    d = rates.with_deltas(spark.createDataFrame([(s, at(m), i, v) for s, m, v, i in rows], "s string, at timestamp, sample_id long, value long"), ["s"])
    assert {(r.sample_id): r.delta for r in d.collect()} == {1: None, 2: 3, 3: 2, 4: 0, 5: None, 6: 7, 7: 3}
    found = {(r.end.hour * 60 + r.end.minute): r.increase for r in rates.increases(d, ["s"], [], "10 minutes", "5 minutes").collect()}
    assert found == {5: 3, 10: 5, 15: 0, 35: 3, 40: 3}
    held = spark.createDataFrame([("x", at(m)) for m in (5, 10, 15, 25, 30)] + [("y", at(10))], "label string, end timestamp")
    assert sorted((r.label, r.end.minute) for r in rates.firing(held, ["label"], 300, 600).where("firing").collect()) == [("x", 15)]
    assert {r.end.minute for r in rates.firing(held, ["label"], 300, 1).where("firing").collect()} == {10, 15, 30}
    ages = rates.staleness(spark.createDataFrame([("x", at(3)), ("x", at(12))], "k string, at timestamp"), spark.createDataFrame([("x", at(0)), ("x", at(10)), ("x", at(12)), ("y", at(5))], "k string, end timestamp"), "k")
    assert sorted((r.k, r.end.minute, r.age) for r in ages.collect()) == [("x", 0, None), ("x", 10, 420.0), ("x", 12, 0.0), ("y", 5, None)]
    share = spark.range(1).select(rates.ratio(F.lit(1.0), F.lit(2.0), 60).alias("a"), rates.ratio(F.lit(0.0), F.lit(0.0), 60).alias("b"), rates.ratio(F.lit(0.0), F.lit(0.0), 60, 0.001).alias("c")).first()
    assert (share.a, share.b, share.c) == (0.5, None, 0.0)

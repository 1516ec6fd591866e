"""Ordered folds: each rule against a plain loop, and the streaming job against the batch on the same rows."""

import random
from collections import defaultdict
from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from tradewind.operators import folds
from tradewind.streaming import ingest, ordered


def plain(rows, key, value, start, step):
    held, out = defaultdict(lambda: start), {}
    for r in rows:
        held[key(r)], found = step(held[key(r)], value(r))
        out[r] = found
    return out


def test_spend_refuses_and_goes_on(spark):
    rows = [("a", "d", 1, 1, 60, False), ("a", "d", 2, 2, 50, False), ("a", "d", 3, 3, 40, False), ("a", "d", 4, 4, 0, False), ("a", "d", 5, 5, 30, True), ("a", "d", 6, 6, 1, False), ("a", "d", 7, 7, 0, False), ("a", "e", 1, 8, 100, False), (None, "d", 1, 9, 101, False), ("b", "d", 1, 10, None, False)]
    calls = spark.createDataFrame(rows, "tenant string, spend_date string, at long, call_id long, tokens long, happened boolean").repartition(4)
    got = {r.call_id: (r.outcome, r.tokens_used, r.calls_made) for r in folds.spend(calls, 100).collect()}
    assert got == {1: ("accepted", 60, 1), 2: ("refused", 60, 1), 3: ("accepted", 100, 2), 4: ("accepted", 100, 3), 5: ("overage", 130, 4), 6: ("refused", 130, 4), 7: ("accepted", 130, 5), 8: ("accepted", 100, 1), 9: ("refused", 0, 0), 10: ("accepted", 0, 1)}
    assert folds.spend(calls.where("false"), 100).collect() == []


def lease_rows():
    """One run's requests: renewed, refused, fenced, stolen after 65 minutes and a microsecond, ended."""
    m = folds.MINUTE
    return [
        (1, 0, "a", "fence", "refused", None), (2, m, "a", "claim", "claimed", "a"), (3, 2 * m, "b", "claim", "refused", "a"), (4, 66 * m, "a", "fence", "fenced", "a"), (5, 66 * m, "b", "claim", "refused", "a"),
        (6, 66 * m + 1, "a", "complete", "refused", "a"), (7, 66 * m + 1, "b", "claim", "stolen", "b"), (8, 67 * m, "a", "fail", "refused", "b"), (9, 68 * m, "b", "claim", "renewed", "b"), (10, 133 * m, "b", "complete", "completed", None), (11, 134 * m, "b", "claim", "refused", None), (12, 135 * m, "b", "fence", "refused", None),
    ]


def test_leases(spark):
    rows = lease_rows()
    requests = spark.createDataFrame([(7, i, at, who, what) for i, at, who, what, _, _ in rows], "run_id long, request_id long, at long, owner string, request string")
    got = {r.request_id: (r.outcome, r.lease_owner) for r in folds.leases(requests, ["run_id"]).collect()}
    assert got == {i: (outcome, owner) for i, _, _, _, outcome, owner in rows}
    late = spark.createDataFrame([(1, 1, 0, "a", "claim"), (1, 2, 70 * folds.MINUTE, "a", "claim")], requests.schema)
    assert [[r.outcome for r in folds.leases(late, ["run_id"], keeps_own=own).orderBy("at").collect()] for own in (False, True)] == [["claimed", "stolen"], ["claimed", "renewed"]]


def test_single_probe(spark):
    m = folds.MINUTE
    rows = [(k, k * m, "a", "failure", "counted" if k < 5 else "opened", "closed" if k < 5 else "open") for k in range(1, 6)]
    rows += [(6, 6 * m, "a", "request", "refused", "open"), (7, 7 * m, "a", "success", "ignored", "open"), (8, 35 * m, "b", "success", "ignored", "half_open"), (9, 35 * m, "a", "request", "probe", "half_open"), (10, 36 * m, "b", "request", "refused", "half_open"), (11, 37 * m, "a", "request", "again", "half_open"), (12, 101 * m, "b", "request", "probe", "half_open")]
    rows += [(13, 102 * m, "a", "success", "ignored", "half_open"), (14, 103 * m, "b", "failure", "extended", "open"), (15, 133 * m, "c", "request", "probe", "half_open"), (16, 134 * m, "c", "success", "closed", "closed"), (17, 135 * m, "a", "request", "allowed", "closed")]
    events = spark.createDataFrame([(1, at, i, who, kind) for i, at, who, kind, _, _ in rows], "source_id long, at long, event_id long, owner string, kind string")
    assert {r.event_id: (r.outcome, r.state) for r in folds.circuits(events).collect()} == {i: (outcome, state) for i, _, _, _, outcome, state in rows}


def test_stream_agrees_with_batch(spark, tmp_path):
    """Rows in three files, out of order within the lateness, over several keys and owners: the same outcomes as at once."""
    r = random.Random(3)
    rows = sorted((r.randrange(4), r.randrange(600) * folds.MINUTE, i, r.choice("ab"), r.choice(["request", "failure", "failure", "success"])) for i in range(160))
    want = plain(sorted(rows, key=lambda x: (x[0], x[1], x[2])), lambda x: x[0], lambda x: (x[1], x[3], x[4]), folds.CLOSED, folds.circuit_step)
    assert {w[0] for w in want.values()} >= {"opened", "probe", "refused", "ignored", "closed"}
    events = spark.createDataFrame(rows, "source_id long, at long, event_id long, owner string, kind string").withColumn("ts", F.timestamp_micros("at"))
    batch = folds.circuits(events.drop("ts"))
    got = lambda df: {(x.source_id, x.at, x.event_id, x.owner, x.kind): (x.outcome, x.state, x.failures, x.probe_owner) for x in df.collect()}
    assert got(batch) == want
    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    stream = lambda: ordered.folded(ingest.stream_of(spark, src, events.schema, 10), "source_id", "ts", ("at", "event_id"), ("at", "owner", "kind"), folds.CLOSED, folds.circuit_step, folds.CIRCUIT, "2 hours")
    hour = 60 * folds.MINUTE
    parts = [events.where(F.floor((F.col("at") + F.when(F.col("event_id") % 3 == 0, hour).otherwise(0)) / (4 * hour)) == k) for k in range(3)]
    for part in (*parts, ordered.ended(events, "ts", "source_id", "2 hours")):
        part.coalesce(1).write.mode("append").parquet(src)
        with ordered.with_rocksdb(spark):
            assert stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination(120)
    assert got(spark.read.parquet(out)) == want


class Held:
    """A state as a dict, a list or one value, which counts the values that are put and taken."""

    def __init__(self):
        self.kept, self.put_in, self.taken = {}, 0, 0

    def updateValue(self, k, v):
        self.put_in += 1
        self.kept[k] = v

    def appendList(self, values):
        for v in values:
            self.updateValue(len(self.kept), v)

    def put(self, values):
        self.kept.clear()
        self.appendList(values)

    def getValue(self, k):
        self.taken += 1
        return self.kept[k]

    def get(self):
        return iter([self.getValue(k) for k in list(self.kept)])

    def keys(self):
        return iter(self.kept)

    def removeKey(self, k):
        del self.kept[k]


class One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


class Handle:
    def __init__(self):
        self.waiting, self.timers = Held(), set()

    def getValueState(self, *_):
        return One()

    def getListState(self, *_):
        return self.waiting

    getMapState = getListState

    def registerTimer(self, at):
        self.timers.add(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_are_held_together(monkeypatch):
    """Rows of two days go into few values; a timer touches the spans that the watermark has reached alone."""
    hour, r = 60 * folds.MINUTE, random.Random(5)
    rows = [(1, at, i, "a", "failure") for i, at in enumerate(r.randrange(48 * hour) for _ in range(3000))]
    names = ["source_id", "at", "event_id", "owner", "kind"]
    job, handle = ordered._InOrder("source_id", ("at", "event_id"), ("at", "owner", "kind"), folds.CLOSED, folds.circuit_step, names, ["outcome", "state", "failures", "probe_owner"]), Handle()
    monkeypatch.setattr(ordered, "AT_ONCE", 1000, raising=False)
    job.init(handle)
    list(job.handleInputRows((1,), iter(pd.DataFrame(rows[k : k + 500], columns=names) for k in range(0, 3000, 500)), Watermark(0)))
    assert handle.waiting.put_in <= 30 and handle.timers == {min(x[1] for x in rows) // 1000}
    got = []
    for passed in (7 * hour, 13 * hour, 50 * hour):
        before = handle.waiting.taken
        got += [x for part in job.handleExpiredTimer((1,), Watermark(passed // 1000), None) for x in part[["event_id", "failures"]].itertuples(index=False, name=None)]
        assert handle.waiting.taken - before <= 24
    in_order = sorted(rows, key=lambda x: (x[1], x[2]))
    assert got == [(x[2], k) for k, x in enumerate(in_order, 1)] and not handle.waiting.kept

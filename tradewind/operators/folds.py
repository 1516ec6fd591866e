"""Ordered folds: rules by which each row's outcome rests on those before it, the same in batch and in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators.lifecycle import FAILURES_TO_OPEN, OPEN_MINUTES

MINUTE = 60_000_000
LEASE_MINUTES = 65
State = tuple
#: From what is held and a row's values to what is held afterwards and the row's outcome.
Step = Callable[[State, tuple], tuple[State, tuple]]


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: State, step: Step, outcome: str) -> DataFrame:
    """rows with the outcome columns (DDL) that step gives each, in order, from the values of the row and what is held for its keys.

    Rows are dealt by key and sorted; one pass over a task's rows holds the state of one key and one Arrow batch, so
    a key of any number of rows is streamed and never gathered. Null keys are a key like any other; rows that tie in
    order may come either way round, so order should end in a column without repeats.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(outcome).fields])
    added = StructType.fromDDL(outcome).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            of = [batch.column(k).to_pylist() for k in keys]
            found = []
            for key, row in zip(zip(*of), zip(*(batch.column(v).to_pylist() for v in values))):
                if key != at:
                    at, held = key, start
                held, out = step(held, row)
                found.append(out)
            columns = [pa.array(x) if any(v is not None for v in x) else pa.nulls(len(x)) for x in map(list, zip(*found))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(c.cast(_arrow(schema[n].dataType.typeName())) for n, c in zip(added, columns))], names=[*batch.schema.names, *added])

    return dealt.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[kind]


# ---- spend under a cap ----

SPEND = "outcome string, tokens_used long, calls_made long"
NO_SPEND: State = (0, 0)


def spend_step(cap: int, held: State, row: tuple) -> tuple[State, tuple]:
    """(tokens, happened): a call that still fits is accepted; one that doesn't is refused and leaves the counters; one

    that has happened already is counted beyond the cap too. Null tokens are none."""
    used, calls = held
    tokens, happened = row[0] or 0, row[1]
    if not happened and tokens > max(0, cap - used):
        return held, ("refused", used, calls)
    held = (used + tokens, calls + 1)
    return held, ("overage" if happened and used + tokens > cap else "accepted", *held)


def spend(calls: DataFrame, cap: int, keys: Sequence[str] = ("tenant", "spend_date"), order: Sequence[str] = ("at", "call_id")) -> DataFrame:
    """calls (tenant, spend_date, at, call_id, tokens, happened) with outcome and the counters of the tenant's day after it."""
    return fold(calls, keys, order, ("tokens", "happened"), NO_SPEND, partial(spend_step, cap), SPEND)


# ---- leases ----

LEASE = "outcome string, status string, lease_owner string, lease_expires_at long, attempts long"
NO_LEASE: State = (None, None, None, 0)


def lease_step(keeps_own: bool, held: State, row: tuple) -> tuple[State, tuple]:
    """(at in microseconds, owner, request): claim, fence, complete or fail.

    A first claim makes the row; its holder's claim renews it while it lives, and with keeps_own, as runs do, after it
    too; a lease that has run out is stolen; a claim on a live lease of another or on what has ended is refused. The
    other requests need a live lease of their owner. A lease lives up to and at the microsecond it expires.
    """
    status, owner, expires, attempts = held
    at, who, request = row
    running = status == "running"
    live = running and expires >= at
    mine = running and owner == who
    if request == "claim":
        outcome = "claimed" if status is None else "renewed" if mine and (live or keeps_own) else "stolen" if running and not live else "refused"
        if outcome != "refused":
            held = ("running", who, at + LEASE_MINUTES * MINUTE, attempts + 1)
    elif mine and live:
        outcome = {"fence": "fenced", "complete": "completed", "fail": "failed"}[request]
        if request != "fence":
            held = (outcome, None, None, attempts)
    else:
        outcome = "refused"
    return held, (outcome, *held)


def leases(requests: DataFrame, keys: Sequence[str], keeps_own: bool = False, order: Sequence[str] = ("at", "request_id")) -> DataFrame:
    """requests (the keys, at in microseconds, request_id, owner, request) with each one's outcome and the lease after it."""
    return fold(requests, keys, order, ("at", "owner", "request"), NO_LEASE, partial(lease_step, keeps_own), LEASE)


# ---- circuits with a single probe ----

CIRCUIT = "outcome string, state string, failures long, probe_owner string"
CLOSED: State = (0, None, None, None)


def circuit_step(held: State, row: tuple) -> tuple[State, tuple]:
    """(at in microseconds, owner, kind): request, failure or success.

    Failures add up; from the fifth on each opens the circuit for half an hour and ends a probe. While it is open
    requests are refused; then it is half open, and one owner at a time may probe, under a lease: again at will while
    the lease lives, another owner once it has run out. A success closes the circuit if it is the prober's or if the
    circuit is not open, and counts for nothing otherwise.
    """
    failures, until, prober, lease = held
    at, who, kind = row
    tripped = failures >= FAILURES_TO_OPEN
    if kind == "failure":
        failures += 1
        if failures >= FAILURES_TO_OPEN:
            until = at + OPEN_MINUTES * MINUTE
        prober = lease = None
        outcome = "opened" if failures == FAILURES_TO_OPEN else "extended" if failures > FAILURES_TO_OPEN else "counted"
    elif kind == "success":
        outcome = "closed" if not tripped or prober == who and who is not None else "ignored"
        if outcome == "closed":
            failures, until, prober, lease = CLOSED
    elif not tripped:
        outcome = "allowed"
    elif until > at:
        outcome = "refused"
    elif prober is None or lease < at or prober == who:
        outcome = "again" if prober == who and lease >= at else "probe"
        if outcome == "probe":
            prober, lease = who, at + LEASE_MINUTES * MINUTE
    else:
        outcome = "refused"
    state = "closed" if failures < FAILURES_TO_OPEN else "open" if until > at else "half_open"
    return (failures, until, prober, lease), (outcome, state, failures, prober)


def circuits(outcomes: DataFrame, keys: Sequence[str] = ("source_id",), order: Sequence[str] = ("at", "event_id")) -> DataFrame:
    """outcomes (source_id, at in microseconds, event_id, owner, kind) with what each meets and the circuit after it."""
    return fold(outcomes, keys, order, ("at", "owner", "kind"), CLOSED, circuit_step, CIRCUIT)


def micros(at: str):
    """A timestamp column as microseconds, as the folds count time."""
    return F.unix_micros(F.col(at).cast("timestamp"))

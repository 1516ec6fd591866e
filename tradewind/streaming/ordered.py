"""The ordered folds as streaming jobs: rows wait in state until the watermark has passed them, then go in order."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tradewind.operators.folds import State, Step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Waiting rows are held by spans of six hours of their time, in microseconds; so many of a key are put there or go on at a time.
SPAN, AT_ONCE = 21_600_000_000, 50_000


class _InOrder(StatefulProcessor):
    """Holds a key's rows that the watermark has not passed and the fold's state; an event-time timer takes the rows on.

    Rows wait in a map by span, many in one value. A timer reads the spans that the watermark has reached, one at a
    time, so neither the rows that wait longer are read or written again, nor are all of a key's in memory at once.
    """

    def __init__(self, key: str, order: Sequence[str], values: Sequence[str], start: State, step: Step, names: Sequence[str], added: Sequence[str]):
        self.key, self.order, self.values, self.start, self.step, self.names, self.added = key, tuple(order), tuple(values), start, step, tuple(names), tuple(added)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string")
        self.parts = handle.getValueState("parts", "n long")
        self.waiting = handle.getMapState("waiting", "span long, part long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, first, count, spans = self.names.index(self.order[0]), None, 0, defaultdict(list)
        part = self.parts.get()[0] if self.parts.exists() else 0
        for batch in rows:
            for row in zip(*(_plain(batch[c]) for c in self.names)):
                if row[at] is not None:  # as that of ended, which has no turn
                    spans[row[at] // SPAN].append(row)
            count += len(batch)
            if spans and count >= AT_ONCE:
                first, part, count = self._put(spans, at, first, part), part + 1, 0
                spans.clear()
        if spans:
            first, part = self._put(spans, at, first, part), part + 1
        if first is not None:
            self.parts.update((part,))
            self.handle.registerTimer(first // 1000)
        yield pd.DataFrame(columns=[*self.names, *self.added])

    def _put(self, spans: dict[int, list[tuple]], at: int, first: int | None, part: int) -> int:
        """Puts rows into the state, and gives the least time of all so far."""
        for span, rows in spans.items():
            self.waiting.updateValue((span, part), (json.dumps(rows),))
        least = min(row[at] for row in spans[min(spans)])
        return least if first is None else min(first, least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        place, at = [self.names.index(c) for c in self.order], [self.names.index(v) for v in self.values]
        parts = defaultdict(list)
        for span, part in self.waiting.keys():
            parts[span].append(part)
        held = tuple(json.loads(self.held.get()[0])) if self.held.exists() else self.start
        out = []
        for span in sorted(parts):
            if span * SPAN // 1000 > passed:
                self.handle.registerTimer(span * SPAN // 1000)
                break
            rows = [row for part in parts[span] for row in json.loads(self.waiting.getValue((span, part))[0])]
            rows.sort(key=itemgetter(*place))
            ready = bisect_right(rows, passed, key=lambda row: row[place[0]] // 1000)
            if ready:
                for part in parts[span]:
                    self.waiting.removeKey((span, part))
                if ready < len(rows):
                    self.waiting.updateValue((span, parts[span][0]), (json.dumps(rows[ready:]),))
                for row in rows[:ready]:
                    held, found = self.step(held, tuple(row[k] for k in at))
                    out.append((*row, *found))
            if len(out) >= AT_ONCE:
                yield self._rows(out)
                out = []
            if ready < len(rows):
                self.handle.registerTimer(rows[ready][place[0]] // 1000)
                break
        self.held.update((json.dumps(held),))
        if out:
            yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(v, dtype=object if None in v else None) for c, v in zip([*self.names, *self.added], zip(*out))})

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """A column's numbers and texts as Python has them; whole numbers that nulls have made fractions are whole again."""
    if not column.hasnans:
        return column.tolist()
    return [None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v for v in column.tolist()]


def folded(stream: DataFrame, key: str, at: str, order: Sequence[str], values: Sequence[str], start: State, step: Step, outcome: str, lateness: str) -> DataFrame:
    """What operators.folds.fold gives for the rows of a stream (numbers and texts, and the timestamp `at`), append mode.

    A row waits until the watermark passes its time, so rows that come out of order, or in several batches, are
    folded in order; a row later than the watermark is dropped, as lateness states. order starts with the row's time in
    microseconds. State is the fold's and the rows within the lateness.
    """
    names = [c for c in stream.columns if c != at]
    schema = StructType([*(stream.schema[c] for c in names), *StructType.fromDDL(outcome).fields])
    added = StructType.fromDDL(outcome).fieldNames()
    processor = _InOrder(key, order, values, start, step, names, added)
    return stream.withWatermark(at, lateness).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def with_rocksdb(spark: SparkSession):
    """Context in which streaming queries start with the state store that these jobs need."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        before = spark.conf.get(PROVIDER, None)
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(PROVIDER)
            else:
                spark.conf.set(PROVIDER, before)

    return held()


def ended(df: DataFrame, at: str, key: str, lateness: str) -> DataFrame:
    """One row that follows all of df by over the lateness: behind it the watermark has passed every row."""
    last = df.agg(F.max(at).alias("_last")).select((F.col("_last") + F.expr(f"interval {lateness}") + F.expr("interval 1 second")).alias(at))
    return last.select(*(F.col(at) if c == at else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))

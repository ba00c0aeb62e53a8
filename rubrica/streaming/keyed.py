"""Keyed stream state: rows taken in order behind a watermark, and state that ends.

State lives in typed variables of the state store: `now`, one value per key, and `waiting`, the key's rows that the watermark
has not passed. Event-time timers fire when it has.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that has typed variables and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(span: str) -> int:
    """Milliseconds of a span such as "30 days"."""
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", span)
    if not m:
        raise ValueError(f"not a span of seconds, minutes, hours or days: {span}")
    return int(m[1]) * _UNITS[m[2]]


class Waiting(StatefulProcessor):
    """What the processors here share: the values `now` and timers that never lie behind the watermark.

    A state entry holds the keys of one range, `now` one row per key. With `width` 1 a range is one key; a wider one takes as
    many keys in one call of Python and one read of the store, which is what most of the time goes to where keys are many
    and have few rows. Ranges grow in number with the keys and not in size. The rows of a wider range are kept `packed`, as
    columns in arrays: every element of a list costs a conversion in Python and one in the JVM, many times that of a number
    in an array.
    """

    state = ""
    key = ""  # the key column's name
    packed = False

    def init(self, handle) -> None:
        self.handle = handle
        self.now = self.rows_of("now", f"id bigint, {self.state}")

    def rows_of(self, name: str, columns: str):
        """A list of rows in the state of a range."""
        if self.packed:
            columns = ", ".join(f"{c} array<{kind}>" for c, kind in (c.split() for c in columns.split(",")))
        return self.handle.getListState(name, columns)

    def _kept(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows, strict=True)))] if self.packed else rows

    def ring(self, at: int, timerValues) -> None:
        self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))

    def held(self, state) -> list[tuple]:
        if not state.exists():
            return []
        kept = [tuple(r) for r in state.get()]
        return [row for columns in kept for row in zip(*columns, strict=True)] if self.packed else kept

    def add(self, state, rows: list[tuple]) -> None:
        state.appendList(self._kept(rows))

    def hold(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(self._kept(rows))
        elif state.exists():
            state.clear()

    def frame(self, rows: list[tuple], columns: tuple[str, ...]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, *columns])

    def close(self) -> None:
        pass


class InOrder(Waiting):
    """Takes a key's rows in seq order. `take(value, seq, row value, late)` gives the new value and the rows to emit.

    With `keep` (milliseconds) rows wait for the watermark, and a key whose value is closed and `keep` behind the watermark
    leaves no state. Without, rows are taken as they come, in seq order within a micro-batch, and state stays.
    """

    state = "value string, last bigint, at bigint"
    columns: tuple[str, ...] = ()
    start: str | None = None

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = self.rows_of("waiting", "id bigint, seq bigint, at bigint, value string")

    def take(self, value, seq, row, late):
        raise NotImplementedError

    def closed(self, value) -> bool:
        raise NotImplementedError

    def _taken(self, now: dict, rows: list[tuple]) -> list[tuple]:
        out = []
        for id, seq, when, row in sorted(rows, key=lambda r: r[:3]):
            value, last, at = now.get(id, (self.start, None, 0))
            late = last is not None and seq <= last
            value, emitted = self.take(value, seq, row, late)
            out += [(id, *e) for e in emitted]
            now[id] = (value, last, at) if late else (value, seq, max(at, when))
        return out

    def handleInputRows(self, key, rows, timerValues):
        columns = ("id", "seq", "at", "value")
        new = [r for pdf in rows for r in zip(*[pdf[c].tolist() for c in columns], strict=True)]
        if self.keep is not None:
            self.add(self.waiting, new)
            self.ring(min(r[2] for r in new), timerValues)
            return
        now = {r[0]: r[1:] for r in self.held(self.now)}
        out = self._taken(now, new)
        self.hold(self.now, [(id, *v) for id, v in now.items()])
        if out:
            yield self.frame(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = self.held(self.waiting)
        ready, rest = [r for r in rows if r[2] <= passed], [r for r in rows if r[2] > passed]
        now = {r[0]: r[1:] for r in self.held(self.now)}
        out = self._taken(now, ready)
        if ready:
            self.hold(self.waiting, rest)
        waits = {r[0] for r in rest}
        ends = {id: at + self.keep for id, (value, _, at) in now.items() if id not in waits and self.closed(value)}
        over = [id for id, end in ends.items() if end <= passed]
        for id in over:
            del now[id], ends[id]
        if ready or over:
            self.hold(self.now, [(id, *v) for id, v in now.items()])
        due = [*(r[2] for r in rest), *ends.values()]
        if due:
            self.ring(min(due), timerValues)
        if out:
            yield self.frame(out, self.columns)


def over_keys(
    stream: DataFrame, key: str, value: str, processor: StatefulProcessor, schema: str, delay: str, width: int = 1
) -> DataFrame:
    """Run a processor over `stream` (key, seq, ts and a value column); its rows have `schema`.

    `width` consecutive keys share a state entry; it can't change while a checkpoint is in use. A good width has some
    hundreds of rows to a range: where ids are sparse it is as much wider.
    """
    processor.key, processor.packed = key, width > 1
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = (
        stream.where(f"`{key}` IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL")
        .withWatermark("ts", delay)
        .select(
            F.expr(f"CAST(`{key}` AS bigint) DIV {int(width)}").alias(key), F.col(key).cast("bigint").alias("id"), F.col("seq").cast("bigint").alias("seq"),
            "ts", F.unix_millis("ts").alias("at"), F.col(value).alias("value"),
        )
    )
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")

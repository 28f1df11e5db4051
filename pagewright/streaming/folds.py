"""State folds over a stream of attempts, in Spark's own keyed state.

A micro-batch is cut into stretches of one key and one span of time; each stretch becomes a single composed shift, so a key with very
many rows is spread over its spans and sends one row for each of them. The stateful operator applies the few shifts of a key in order.
State lives in the query's checkpoint: a restart goes on from it, a replayed batch starts from the version before it, and
`stored_state` reads it as a table, whether a query runs or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagewright.operators.folds import Walk, _reduce_runs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "walks"


@dataclass(frozen=True)
class _Bounds:
    """What of a walk the workers need."""

    name: str
    start: int
    floor: int
    ceiling: int


def _shift_columns(names: list[str]) -> list[str]:
    return [f"{name}_{part}" for name in names for part in ("d", "lo", "hi")]


class _Fold(StatefulProcessor):
    """Current value of each walk of a key, and the time at which the key counts as idle."""

    def __init__(self, key: str, order: list[str], bounds: list[_Bounds], idle_ms: int | None):
        self.key, self.order, self.bounds, self.idle_ms = key, order, bounds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [f"{b.name} long" for b in self.bounds]
        self.state = handle.getValueState(_STATE, ", ".join([*fields, "idle_at long"]))

    def _row(self, key: tuple, values: list[int], idle: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], **{b.name: [v] for b, v in zip(self.bounds, values)}, "idle": [idle]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stretches = pd.concat(list(rows)).sort_values(self.order)
        *values, idle_at = self.state.get() if self.state.exists() else [*(b.start for b in self.bounds), None]
        for i, b in enumerate(self.bounds):
            for d, lo, hi in zip(*(stretches[f"{b.name}_{part}"].tolist() for part in ("d", "lo", "hi"))):
                values[i] = int(min(max(values[i] + d, lo), hi))
        if self.idle_ms is not None:
            seen = int(stretches["seen"].max().timestamp() * 1000) + self.idle_ms
            if idle_at is not None:
                self.handle.deleteTimer(idle_at)
            idle_at = seen if idle_at is None else max(seen, idle_at)
            self.handle.registerTimer(idle_at)
        self.state.update((*values, idle_at))
        yield self._row(key, values, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            *values, _ = self.state.get()
            self.state.clear()
            yield self._row(key, values, True)

    def close(self) -> None:
        pass


def _stretches(events: DataFrame, key: str, order: list[str], walks: dict[str, Walk], span: str, groups: int) -> DataFrame:
    """One row per key and span of time: its first order values, its last time, and the composed shifts.

    The keys of a span are reduced together, `groups` lots of them: a call for each key would cost more than its few rows.
    """
    bounds = [_Bounds(n, w.start, w.floor, w.ceiling) for n, w in walks.items()]
    rows = events.select(key, *order, *[w.step.cast("bigint").alias(n) for n, w in walks.items()])
    # Rows without a key make a lot of their own, so that the other keys stay whole numbers in pandas.
    lot = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    rows = rows.withColumns({"__span": F.date_trunc(span, order[0]), "__lot": lot})
    schema = T.StructType([rows.schema[c] for c in (key, *order)]).add("seen", T.TimestampType())
    for column in _shift_columns(list(walks)):
        schema = schema.add(column, T.LongType())

    def reduced(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([key, *order])
        keys = part[key].to_numpy()
        starts = np.r_[True, keys[1:] != keys[:-1]]
        run, first = np.cumsum(starts), np.flatnonzero(starts)
        out = part.iloc[first][[key, *order]].reset_index(drop=True)
        out["seen"] = part[order[0]].iloc[np.r_[first[1:], len(part)] - 1].reset_index(drop=True)
        for b in bounds:
            step = part[b.name].to_numpy(np.int64)
            _, shifts = _reduce_runs(run, (step, np.full_like(step, b.floor), np.full_like(step, b.ceiling)))
            for name, values in zip(("d", "lo", "hi"), shifts):
                out[f"{b.name}_{name}"] = values
        return out

    return rows.groupBy("__span", "__lot").applyInPandas(reduced, schema)


def folded(
    events: DataFrame,
    key: str,
    order: list[str],
    walks: dict[str, Walk],
    idle: int | None = None,
    delay: str = "0 seconds",
    span: str = "day",
    groups: int = 16,
) -> DataFrame:
    """Stream of changed states: `(key, *walks, idle)`, one row per key and micro-batch.

    order   columns that order a key's rows, the first of them the event time. Rows are ordered within a micro-batch; one that comes in a
            later batch is applied when it comes
    idle    seconds of event time without a row after which a key is reported once more, with `idle` set, and its state removed;
            the next row starts anew. None keeps keys for ever
    delay   how far the watermark stays behind the newest event, for `idle`
    span    unit of `date_trunc` that bounds a stretch
    groups  lots into which the keys of a span are dealt; the rows of a lot are one group
    """
    bounds = [_Bounds(n, w.start, w.floor, w.ceiling) for n, w in walks.items()]
    stretches = _stretches(events, key, order, walks, span, groups)
    if idle is not None:
        stretches = stretches.withWatermark("seen", delay)
    schema = T.StructType([stretches.schema[key]])
    for name in walks:
        schema = schema.add(name, T.LongType())
    processor = _Fold(key, order, bounds, None if idle is None else idle * 1000)
    return stretches.groupBy(key).transformWithStateInPandas(
        processor, schema.add("idle", T.BooleanType()), "Update", "None" if idle is None else "EventTime"
    )


def start_fold(states: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a stream of `folded` states for its state alone; to use the changes as well, write the stream to a sink of your own.

    The operator needs the RocksDB state store; the session's setting is put back once the query has taken it over.
    """
    conf = states.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = states.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(_PROVIDER, before)


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """`(key, *walks)` after the last finished batch of the query with this checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", _STATE).load(checkpoint)
    kept = [F.col(f"value.{f.name}") for f in rows.schema["value"].dataType if f.name != "idle_at"]
    return rows.select("key.*", *kept)


def first_visits(pages: DataFrame, url: str = "url", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each URL once: the visited set of a stream.

    Without `event_time` the set grows with the number of URLs, as a crawl's does. With it,
    repeats are recognised within `delay` and state stays bounded.
    """
    if event_time is None:
        return pages.dropDuplicates([url])
    return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([url])

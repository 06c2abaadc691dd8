"""Aggregates that the user writes, over keys, sliding windows and sessions.

What is to be made of a group is an ``Aggregate``: create, add, merge, result. Rows are added to partial states inside each
map task, by key and slice of time, and only states are shuffled; what reaches the task of a hot key is a few states for each
slice and task, however many rows it has. There they are merged in order of time, one group after another, so that no group is
held as a whole.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gavelstream.functions import bucket_start, interval_micros

#: Partial states that a map task holds before it passes them on, and rows that are given out at once.
HELD_STATES = 20_000
ROWS = 10_000


class Aggregate(ABC):
    """How rows become a result. States are pickled; any order of adding and merging must give the same result."""

    @abstractmethod
    def create(self):
        """The state of no rows."""

    @abstractmethod
    def add(self, state, row: tuple):
        """The state with one row more; ``state`` may be changed and given back."""

    @abstractmethod
    def merge(self, state, other):
        """The state of both's rows; either may be changed and given back."""

    @abstractmethod
    def result(self, state) -> tuple:
        """The group's values, in the order of the result's columns."""


_Merger = Callable[[Iterator[tuple[tuple, int, int, int, bytes]]], Iterator[tuple]]


def _partial_states(aggregate: Aggregate, n_keys: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            if states:
                rows = [(*key, first, last, pickle.dumps(state)) for key, (first, last, state) in states.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                states.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, us, values = row[:n_keys + 1], row[n_keys + 1], row[n_keys + 2:]
                held = states.get(key)
                if held is None:
                    held = states[key] = [us, us, aggregate.create()]
                held[0], held[1] = min(held[0], us), max(held[1], us)
                held[2] = aggregate.add(held[2], values)
            if len(states) >= HELD_STATES:
                yield from passed_on()
        yield from passed_on()
    return partials


def _whole_slices(aggregate: Aggregate, rows: Iterator[tuple]) -> Iterator[tuple[tuple, int, int, int, object]]:
    """(key, slice, first, last, state) with the states of one slice merged."""
    now = None
    for *key, at, first, last, data in rows:
        key, state = tuple(key), pickle.loads(data)
        if now is not None and now[0] == key and now[1] == at:
            now = (key, at, min(now[2], first), max(now[3], last), aggregate.merge(now[4], state))
        else:
            if now is not None:
                yield now
            now = (key, at, first, last, state)
    if now is not None:
        yield now


def _keys(aggregate: Aggregate) -> _Merger:
    def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, _, _, _, state in _whole_slices(aggregate, rows):
            yield (*key, *aggregate.result(state))
    return merged


def _sessions(aggregate: Aggregate, gap: int) -> _Merger:
    def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for key, _, first, last, state in _whole_slices(aggregate, rows):
            if now is not None and now[0] == key and first - now[2] <= gap:
                now = (key, now[1], last, aggregate.merge(now[3], state))
                continue
            if now is not None:
                yield (*now[0], now[1] // 1000, (now[2] + gap) // 1000, *aggregate.result(now[3]))
            now = (key, first, last, state)
        if now is not None:
            yield (*now[0], now[1] // 1000, (now[2] + gap) // 1000, *aggregate.result(now[3]))
    return merged


def _windows(aggregate: Aggregate, size: int, slide: int, pane: int) -> _Merger:
    def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple[int, bytes]] = []  # panes that a window to come may have, with their states
        now, start = None, None

        def closed(upto: int | None) -> Iterator[tuple]:
            nonlocal start
            while held:
                covering = -((size - pane - held[0][0]) // slide) * slide
                start = covering if start is None else max(start, covering)
                if upto is not None and start + size > upto:
                    return
                state = None
                for at, data in held:
                    if at < start + size:
                        state = pickle.loads(data) if state is None else aggregate.merge(state, pickle.loads(data))
                yield (*now, (start + size) // 1000, *aggregate.result(state))
                start += slide
                while held and held[0][0] < start:
                    held.pop(0)

        for key, at, _, _, state in _whole_slices(aggregate, rows):
            if key != now:
                yield from closed(None)
                now, start = key, None
            yield from closed(at)
            held.append((at, pickle.dumps(state)))
        yield from closed(None)
    return merged


def _aggregated(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregate: Aggregate, result: str, us: Column, at: Column,
                merger: _Merger, bounds: str) -> DataFrame:
    rows = df.select(*(F.col(k) for k in keys), at.alias("_slice"), us.alias("_us"), *(F.col(v).alias(f"_value{i}") for i, v in enumerate(values)))
    named = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"{named + ', ' if keys else ''}_slice long, _first long, _last long, _state binary"
    partials = _arrow_schema(ddl)
    out = _arrow_schema(f"{named + ', ' if keys else ''}{bounds}{result}")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []

        def given() -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for row in merger(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            found.append(row)
            if len(found) >= ROWS:
                yield given()
                found = []
        if found:
            yield given()

    states = rows.mapInArrow(_partial_states(aggregate, len(keys), partials), ddl)
    dealt = states.repartition(*keys) if keys else states.repartition(1)
    return (dealt.sortWithinPartitions(*keys, "_slice")
            .mapInArrow(merge, f"{named + ', ' if keys else ''}{bounds}{result}"))


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def by_key(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregate: Aggregate, result: str) -> DataFrame:
    """The keys and the columns of ``result`` (as in a schema string), one row per key; ``add`` gets a row's ``values``.

    A null key is one like any other.
    """
    none = F.lit(0).cast("long")
    return _aggregated(df, keys, values, aggregate, result, none, none, _keys(aggregate), "")


def by_window(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregate: Aggregate, result: str, size: str, slide: str,
              ts: str = "ts") -> DataFrame:
    """The same for each sliding window, with ``window_end_ms``; rows without a time are in none.

    Rows are added once, to their pane; a window merges its panes.
    """
    size_us, slide_us = interval_micros(size), interval_micros(slide)
    if slide_us > size_us:
        raise ValueError("the slide must not be longer than the window")
    pane, us = gcd(size_us, slide_us), F.unix_micros(ts)
    return _aggregated(df.where(F.col(ts).isNotNull()), keys, values, aggregate, result, us, bucket_start(us, pane),
                       _windows(aggregate, size_us, slide_us, pane), "window_end_ms long, ")


def by_session(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregate: Aggregate, result: str, gap: str, ts: str = "ts") -> DataFrame:
    """The same for each session, with ``start_ms`` and ``end_ms``; rows exactly one gap apart stay together."""
    gap_us, us = interval_micros(gap), F.unix_micros(ts)
    return _aggregated(df.where(F.col(ts).isNotNull()), keys, values, aggregate, result, us, bucket_start(us, gap_us),
                       _sessions(aggregate, gap_us), "start_ms long, end_ms long, ")


class BidCount(Aggregate):
    """How many bids, and the auction of the last that names one; values are time in microseconds and auction."""

    def create(self):
        return 0, None

    def add(self, state, row):
        us, auction = row
        return state[0] + 1, self._later(state[1], None if auction is None else (us, auction))

    def merge(self, state, other):
        return state[0] + other[0], self._later(state[1], other[1])

    def result(self, state):
        return state[0], state[1] and state[1][1]

    @staticmethod
    def _later(one, other):
        return max(one, other) if one and other else one or other

"""User sessions over bid streams."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelstream.functions import epoch_millis, interval_micros

RESULT = "bidder long, num long, end_ms_or_fire_ms long, is_final boolean"
Firing = Row("bidder", "num", "end_ms_or_fire_ms", "is_final")
OPEN_SESSIONS = ("first_us array<bigint>, last_us array<bigint>, num array<bigint>, "
                 "since_firing array<bigint>, timer_ms bigint")
INSTANTS = "bidder long, ms long, num long, first_us long, last_us long"


def session_counts(bids: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Bids per closed session, its bounds and the auction of the last bid that names one."""
    return (bids.withWatermark("ts", delay)
            .groupBy("bidder", F.session_window("ts", gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("num"),
                 F.max(F.when(F.col("auction").isNotNull(), F.struct("ts", "auction"))).alias("last_bid"))
            .select("bidder", "num", epoch_millis(F.col("session.start")).alias("start_ms"),
                    epoch_millis(F.col("session.end")).alias("end_ms"),
                    F.col("last_bid.auction").alias("last_auction")))


def _by_instant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bidder's bids of one millisecond as one row, ahead of the shuffle.

    Bids on the full millisecond go by themselves: the watermark has whole milliseconds, so bids of one row
    are then either all late or all in time.
    """
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by(["bidder", "ms", "full"], use_threads=False).aggregate(
            [("us", "count"), ("us", "min"), ("us", "max")])
        yield from rows.select(["bidder", "ms", "us_count", "us_min", "us_max"]).rename_columns(
            ["bidder", "ms", "num", "first_us", "last_us"]).to_batches()


class SessionFirings(StatefulProcessor):
    """Open sessions of a bidder; counts on every ``max_events``-th bid and at the end."""

    def __init__(self, gap_us: int, max_events: int):
        self.gap_us = gap_us
        self.max_events = max_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_SESSIONS)

    def _read(self) -> tuple[list[list[int]], int | None]:
        held = self.open.get()
        if not held:
            return [], None
        *columns, timer_ms = held
        return [list(session) for session in zip(*columns)], timer_ms

    def _write(self, sessions: list[list[int]], timer_ms: int | None) -> None:
        """Keep ``sessions``, in time order, and wake up when the first may be over."""
        if not sessions:
            self.open.clear()
            return
        if timer_ms is None:
            timer_ms = -(-(min(s[1] for s in sessions) + self.gap_us) // 1000)
            self.handle.registerTimer(timer_ms)
        self.open.update((*[list(column) for column in zip(*sessions)], timer_ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sessions, timer_ms = self._read()
        columns = [array("q") for _ in range(4)]
        for _, *instant in rows:
            for column, value in zip(columns, instant):
                column.append(value)
        ms, num, first_us, last_us = (np.frombuffer(c, np.int64) for c in columns)
        held = np.array(sessions, np.int64).reshape(-1, 4)
        # sessions so far and instants in time order; whatever lies within the gap of what came before it joins
        starts, ends = np.concatenate([held[:, 0], first_us]), np.concatenate([held[:, 1], last_us])
        order = np.argsort(starts, kind="stable")
        reached = np.maximum.accumulate(ends[order])
        opens = np.flatnonzero(np.append(True, starts[order][1:] - reached[:-1] > self.gap_us))
        sessions = []
        for at, upto in zip(opens.tolist(), [*opens[1:].tolist(), len(order)]):
            members = order[at:upto]
            before, new = members[members < len(held)], members[members >= len(held)] - len(held)
            total, since = (int(held[before, c].sum()) for c in (2, 3))
            counted = np.cumsum(num[new])
            arrived = int(counted[-1]) if len(new) else 0
            due = np.arange(max(1, self.max_events - since), arrived + 1, self.max_events)
            for more, fired_ms in zip(due.tolist(), ms[new[np.searchsorted(counted, due)]].tolist()):
                yield Firing(key[0], total + more, fired_ms, False)
            sessions.append([int(starts[members[0]]), int(reached[upto - 1]), total + arrived,
                             arrived - int(due[-1]) if len(due) else since + arrived])
        self._write(sessions, self._earlier(sessions, timer_ms))

    def _earlier(self, sessions, timer_ms):
        """The standing timer, unless a session has come up that may end before it."""
        due = -(-(min(s[1] for s in sessions) + self.gap_us) // 1000)
        if timer_ms is not None and due < timer_ms:
            self.handle.deleteTimer(timer_ms)
            return None
        return timer_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        sessions, _ = self._read()
        ended = [s for s in sessions if s[1] + self.gap_us <= watermark_us]
        self._write([s for s in sessions if s[1] + self.gap_us > watermark_us], None)
        for _, last_us, num, _ in ended:
            yield Firing(key[0], num, (last_us + self.gap_us) // 1000, True)


def session_firings(bids: DataFrame, gap: str, max_events: int, delay: str = "0 seconds") -> DataFrame:
    """Running count at each ``max_events``-th bid of a session, and its total at the end.

    A bid is late once the session it would open by itself is over, as for the session counts; the
    watermark is taken from that end, set back by the gap. In a micro-batch bids count in time
    order, on top of what their session held before. A bidder's task holds four numbers for each
    millisecond of the micro-batch in which the bidder bid; the reader's limits bound it.
    """
    gap_us = interval_micros(gap)
    if gap_us % 1000:
        raise ValueError("the gap must be in whole milliseconds")
    if max_events < 1:
        raise ValueError("max_events: 1 or more")
    us = F.unix_micros("ts")
    behind_ms = gap_us // 1000 + (pd.Timedelta(delay).value // 1_000_000)
    instants = (bids.where(F.col("ts").isNotNull())
                .select("bidder", epoch_millis(F.col("ts")).alias("ms"), (us % 1000 == 0).alias("full"), us.alias("us"))
                .mapInArrow(_by_instant, INSTANTS)
                .withColumn("ends", F.timestamp_micros(F.col("last_us") + gap_us))
                .withWatermark("ends", f"{behind_ms} milliseconds"))
    return (instants.groupBy("bidder")
            .transformWithState(SessionFirings(gap_us, max_events), RESULT, "Append", "EventTime"))

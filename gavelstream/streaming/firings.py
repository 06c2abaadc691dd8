"""Running counts of sessions over streams, for bidders too hot for one task.

A bidder's time is cut into slots. Slots count their own bids, wherever they are; only their totals meet at the bidder, which
tells each slot how many bids of the session lie ahead of it. A slot then finds its own bids at which a count is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelstream.functions import GROUPS, epoch_millis, group_of, interval_micros

INSTANT, AHEAD, FINAL = 0, 1, 2
NOTE = "slot long, kind int, ms long, num long, closed timestamp"
RESULT = "num long, end_ms_or_fire_ms long, is_final boolean"
SESSION = ["bidder", "named", "last_us", "num"]
HALF = ["bidder", "named", "slot", "kind", "ms", "num"]


def _arrays(columns: list[str]) -> str:
    return ", ".join(f"{c} array<{'boolean' if c == 'named' else 'bigint'}>" for c in columns)


def _columns(held: tuple | None, frames: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    """What the state holds, an array for each column, and behind it what came in."""
    frames = list(frames)
    kept = held or [[]] * len(names)
    return [np.concatenate([np.array(kept[place], np.int64), *[f[name].to_numpy(np.int64) for f in frames]])
            for place, name in enumerate(names)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Which rows, in order of the keys, are the first of theirs."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


class _Waking(StatefulProcessor):
    """Holds arrays for a group of keys, and one timer for the first of them that is due."""

    def _keep(self, columns: list[np.ndarray], due_ms: np.ndarray) -> None:
        held = self.due.get()
        ms = int(due_ms.min()) if len(due_ms) else None
        if held is not None and held[0] != ms:
            self.handle.deleteTimer(held[0])
            self.due.clear()
        if not len(due_ms):
            self.held.clear()
            return
        self.held.update(tuple(c.tolist() for c in columns))
        if held is None or held[0] != ms:
            self.handle.registerTimer(ms)
            self.due.update((ms,))


class Totals(_Waking):
    """Open sessions of a group of bidders, from the totals of slots: how many bids are ahead of each, and a session's total at its end."""

    def __init__(self, gap_us: int, slot_us: int):
        self.gap_us = gap_us
        self.slot_us = slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", _arrays(SESSION))
        self.due = handle.getValueState("due", "ms bigint")

    def _end_ms(self, last_us):
        return (last_us + self.gap_us) // 1000

    def _over_ms(self, last_us):
        # a bid just within the gap may lie anywhere in its slot: the session is over when that slot has closed
        reach = last_us + self.gap_us
        return (reach - reach % self.slot_us + self.slot_us) // 1000

    def _notes(self, bidder, named, slot, kind, ms, num, closed_ms) -> pd.DataFrame:
        return pd.DataFrame({"bidder": bidder, "named": named.astype(bool), "slot": slot, "kind": kind, "ms": ms, "num": num,
                             "closed": pd.to_datetime(closed_ms, unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # slots close in order of time, so what comes in is behind all that came before: a session so far stands for a slot ahead
        # of the others, in which its last bid is the first too
        held, frames = self.held.get(), list(rows)
        bidder, named, last_us, num = _columns(held, frames, SESSION)
        before = len(held[0]) if held is not None else 0
        slot, first_us = _columns(None, frames, ["slot", "first_us"])
        slot = np.concatenate([np.full(before, np.iinfo(np.int64).min), slot])
        first_us = np.concatenate([last_us[:before], first_us])
        order = np.lexsort((slot, named, bidder))
        came = order >= before
        bidder, named, slot, num, first_us, last_us = (c[order] for c in (bidder, named, slot, num, first_us, last_us))
        head = _starts(bidder, named)
        previous = np.concatenate([first_us[:1], last_us[:-1]])
        opens = head | (first_us - previous > self.gap_us)
        upto = np.cumsum(num)
        ahead = upto - num
        ahead -= ahead[np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))]
        closed_ms = (slot[came] + self.slot_us) // 1000
        yield self._notes(bidder[came], named[came], slot[came], AHEAD, 0, ahead[came], closed_ms)
        ended = np.flatnonzero(opens & ~head)
        if len(ended):
            # the session before a slot that opens one, known over when that slot closes
            yield self._notes(bidder[ended], named[ended], slot[ended], FINAL, self._end_ms(previous[ended]), ahead[ended - 1] + num[ended - 1],
                              (slot[ended] + self.slot_us) // 1000)
        tail = np.append(head[1:], True)
        self._keep([c[tail] for c in (bidder, named.astype(bool), last_us, ahead + num)], self._over_ms(last_us[tail]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bidder, named, last_us, num = _columns(self.held.get(), [], SESSION)
        over_ms = self._over_ms(last_us)
        over = over_ms <= timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        self._keep([c[~over] for c in (bidder, named.astype(bool), last_us, num)], over_ms[~over])
        last_us = last_us[over]
        yield self._notes(bidder[over], named[over], last_us - last_us % self.slot_us, FINAL, self._end_ms(last_us), num[over], over_ms[over])


class Due(_Waking):
    """Slots' bids by millisecond and the number ahead of them, whichever comes first; both go once a slot has them."""

    def __init__(self, max_events: int, keep_ms: int):
        self.max_events = max_events
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("half", _arrays(HALF))
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        bidder, named, slot, kind, ms, num = _columns(held, rows, HALF)
        final = kind == FINAL
        if final.any():
            yield self._result(bidder[final], named[final], num[final], ms[final], True)
        # of a slot the number ahead, then its bids in order of time
        order = np.lexsort((ms, kind != AHEAD, slot, named, bidder))
        order = order[~final[order]]
        bidder, named, slot, kind, ms, num = (c[order] for c in (bidder, named, slot, kind, ms, num))
        head = _starts(bidder, named, slot) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(order)))
        both = np.repeat((kind[at] == AHEAD) & (size > 1), size)
        if both.any():
            upto = np.cumsum(np.where(both, num, 0))
            upto -= np.repeat((upto - np.where(both, num, 0))[at], size)
            since = upto - num
            times = np.where(both & (kind == INSTANT), upto // self.max_events - since // self.max_events, 0)
            fired = np.repeat(np.arange(len(times)), times)
            if len(fired):
                place = np.arange(len(fired)) - np.repeat(np.cumsum(times) - times, times)
                due = (since[fired] // self.max_events + 1 + place) * self.max_events
                yield self._result(bidder[fired], named[fired], due, ms[fired], False)
        if held is not None or not both.all():
            left = ~both
            self._keep([c[left] for c in (bidder, named.astype(bool), slot, kind, ms, num)], slot[left] // 1000 + self.keep_ms)

    @staticmethod
    def _result(bidder, named, num: np.ndarray, ms: np.ndarray, is_final: bool) -> pd.DataFrame:
        return pd.DataFrame({"bidder": bidder, "named": named.astype(bool), "num": num, "end_ms_or_fire_ms": ms, "is_final": is_final})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the other half was late where its input was read, and was dropped there
        columns = _columns(self.held.get(), [], HALF)
        due_ms = columns[2] // 1000 + self.keep_ms
        left = due_ms > timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        bidder, named, *rest = (c[left] for c in columns)
        self._keep([bidder, named.astype(bool), *rest], due_ms[left])
        yield from ()


def session_firings_by_slots(bids: DataFrame, gap: str, max_events: int, delay: str = "0 seconds",
                             slot: str | None = None, groups: int = GROUPS) -> DataFrame:
    """Running count at each ``max_events``-th bid of a session, and its total at the end: the rows of the batch form.

    Bids count in time order, however they are cut into files and batches. A slot's rows come out when the watermark,
    ``delay`` behind the newest bid, has passed the slot; a bid whose slot it has passed is dropped. Slots are no longer than
    the gap; by default there are as many of them in a gap as state partitions, so that a hot bidder's bids are counted, put in order
    and fired in all of them. What meets in the bidder's own task is a row per slot in which it bid. The input is read
    and counted twice: by slots, and by milliseconds. A null bidder is one like any other; bids without a time are left out.
    A call for each bidder or slot would cost far more than its rows, so both are taken in ``groups``, to be kept for the life of
    a checkpoint.
    """
    if max_events < 1:
        raise ValueError("max_events: 1 or more")
    gap_us = interval_micros(gap)
    if gap_us % 1000:
        raise ValueError("the gap must be in whole milliseconds")
    partitions = int(bids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot_us = interval_micros(slot) if slot else max(1, gap_us // 1000 // partitions) * 1000
    if slot_us % 1000 or not 0 < slot_us <= gap_us:
        raise ValueError("slot: whole milliseconds, no longer than the gap")
    window = F.window("ts", f"{slot_us // 1000} milliseconds")
    # numbers are never null here: pandas would make them floating point, in which large ids are not exact
    bidder = [F.coalesce("bidder", F.lit(0).cast("long")).alias("bidder"), F.col("bidder").isNotNull().alias("named")]
    closed = [F.unix_micros("window.start").alias("slot"), F.window_time("window").alias("closed")]

    def timed() -> DataFrame:
        # made anew for each use, for two uses of one watermark would count as one
        return bids.where(F.col("ts").isNotNull()).withWatermark("ts", delay)

    us = F.unix_micros("ts")
    totals = (timed().groupBy(*bidder, window.alias("window"))
              .agg(F.count(F.lit(1)).alias("num"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
              .select("bidder", "named", *closed, "num", "first_us", "last_us"))
    notes = (totals.withColumn("group", group_of(groups, "bidder", "named")).groupBy("group")
             .transformWithStateInPandas(Totals(gap_us, slot_us), _keyed(NOTE), "Append", "EventTime", eventTimeColumnName="closed"))
    instants = (timed().groupBy(*bidder, window.alias("window"), epoch_millis(F.col("ts")).alias("ms"))
                .agg(F.count(F.lit(1)).alias("num"))
                .select("bidder", "named", *closed, F.lit(INSTANT).alias("kind"), "ms", "num"))
    both = instants.unionByName(notes)
    return (both.withColumn("group", group_of(groups, "bidder", "named", "slot")).groupBy("group")
            .transformWithStateInPandas(Due(max_events, 2 * (gap_us + slot_us) // 1000 + 1), _keyed(RESULT), "Append", "EventTime")
            .select(F.when(F.col("named"), F.col("bidder")).alias("bidder"), "num", "end_ms_or_fire_ms", "is_final"))


def _keyed(columns: str) -> str:
    return f"bidder long, named boolean, {columns}"

"""Joins of auctions with person records that keep their own state.

Each is a processor over the tagged union of both inputs. A call costs far more than a row, so its key is not a seller but
one of a fixed number of groups of them. Sellers can be dealt out to ``Shares``, as in the other joins: each share of a
seller then keeps the seller's records, and the shares fall into groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelstream.functions import GROUPS, group_of, interval_micros
from gavelstream.operators.joins import Shares

PERSON = ["name", "city", "state"]
SELLER = ["seller", "share"]
LISTED = [*SELLER, "us", "auction_id"]
KNOWN = [*SELLER, "us", *PERSON]
WAITING = [*SELLER, "auction_id", "us"]
RESULT = "name string, city string, state string, auction_id long"
# rows that a piece of a result or an entry of the state holds at most
BLOCK = 100_000


def _tagged(auctions: DataFrame, persons: DataFrame, shares: Shares | None, delay: str | None, groups: int) -> GroupedData:
    """Both inputs as one, by groups of sellers; rows without the parts a match needs are left out.

    Numbers are never null: pandas would make them floating point, in which large ids are not exact.
    """
    shares = (shares or Shares(1)).numbered(auctions)
    if delay is not None:
        auctions = auctions.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
        persons = persons.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    us = F.coalesce(F.unix_micros("ts"), F.lit(0).cast("long"))
    listed = auctions.where(F.col("seller").isNotNull() & F.col("id").isNotNull()).select(
        "seller", shares.of(F.col("id"), F.col("seller")).alias("share"), "ts", us.alias("us"),
        F.lit(True).alias("is_auction"), F.col("id").alias("auction_id"), *[F.lit(None).cast("string").alias(c) for c in PERSON])
    known = persons.where(F.col("id").isNotNull()).select(
        F.col("id").alias("seller"), shares.every(F.col("id")).alias("share"), "ts", us.alias("us"),
        F.lit(False).alias("is_auction"), F.lit(0).cast("long").alias("auction_id"), *PERSON)
    return listed.unionByName(known).withColumn("group", group_of(groups, *SELLER)).groupBy("group")


def _split(frames: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The auctions, and the person records."""
    rows = pd.concat(list(frames), ignore_index=True)
    listed = rows["is_auction"].to_numpy(bool)
    return rows.loc[listed, LISTED], _clean(rows.loc[~listed, KNOWN])


def _clean(people: pd.DataFrame) -> pd.DataFrame:
    texts = {c: people[c].astype(object).where(people[c].notna(), None) for c in PERSON}
    return people.assign(**texts)


def _arrays(columns: Sequence[str]) -> str:
    return ", ".join(f"{c} array<{'string' if c in PERSON else 'bigint'}>" for c in columns)


def _entries(rows: pd.DataFrame, columns: Sequence[str]) -> list[tuple]:
    """Rows for the state, many to an entry: an array for each column."""
    return [tuple(rows[c].iloc[at:at + BLOCK].tolist() for c in columns) for at in range(0, len(rows), BLOCK)]


def _rows(entries: list[tuple], columns: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.array([v for entry in entries for v in entry[place]], object if c in PERSON else np.int64)
                         for place, c in enumerate(columns)}, columns=list(columns))


def _described(people: pd.DataFrame, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({**{c: people[c].to_numpy(object) for c in PERSON}, "auction_id": ids})


def _newest_last(people: pd.DataFrame) -> pd.DataFrame:
    """In order of time; of several records at one instant the greatest is the last, any text after none."""
    return people.sort_values(["us", *PERSON], na_position="first", ignore_index=True)


def _pairs(auctions: pd.DataFrame, people: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Each auction with each record of its seller, a bounded number at a time."""
    if not len(auctions) or not len(people):
        return
    codes = pd.concat([auctions[SELLER], people[SELLER]]).groupby(SELLER, sort=False).ngroup().to_numpy()
    listed, known = codes[:len(auctions)], codes[len(auctions):]
    order = np.argsort(listed, kind="stable")
    ids = auctions["auction_id"].to_numpy(np.int64)[order]
    first, end = (np.searchsorted(listed[order], known, side) for side in ("left", "right"))
    upto = np.cumsum(end - first)
    for at in range(0, int(upto[-1]), BLOCK):
        pair = np.arange(at, min(at + BLOCK, int(upto[-1])))
        person = np.searchsorted(upto, pair, "right")
        yield _described(people.iloc[person], ids[end[person] - (upto[person] - pair)])


class AsOf(StatefulProcessor):
    """Auctions wait until the watermark has passed them; then they get their seller's record that held at their time.

    Waiting auctions are a map from chunks of time to the rows in them, records a list; both are cut down as the
    watermark goes on, records to those that may still hold.
    """

    def __init__(self, chunk_us: int):
        self.chunk_us = chunk_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk bigint", _arrays(LISTED))
        self.records = handle.getListState("records", _arrays(KNOWN))
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        listed, known = _split(rows)
        if len(known):
            self.records.appendList(_entries(known, KNOWN))
        if len(listed):
            there = {k[0] for k in self.waiting.keys()}
            columns = listed[LISTED].to_numpy(np.int64).T
            chunks = columns[2] - columns[2] % self.chunk_us
            order = np.argsort(chunks, kind="stable")
            found, at = np.unique(chunks[order], return_index=True)
            for chunk, new in zip(found.tolist(), np.split(columns[:, order], at[1:], axis=1), strict=True):
                if chunk in there:
                    new = np.concatenate([np.array(self.waiting.getValue((chunk,)), np.int64), new], axis=1)
                self.waiting.updateValue((chunk,), tuple(new.tolist()))
        # a timer for the first waiting auction, or for the records where none waits
        if len(listed) or self.due.get() is None:
            self._wake(int((listed if len(listed) else known)["us"].min()))
        yield from ()

    def _wake(self, us: int) -> None:
        ms, held = us // 1000 + 1, self.due.get()
        if held is not None:
            if held[0] <= ms:
                return
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        records = _newest_last(_rows(list(self.records.get()), KNOWN))
        chunks = sorted(k[0] for k in self.waiting.keys())
        first, gone, ready = None, [], []
        for chunk in chunks:
            if chunk > upto:
                first = chunk if first is None else first
                break
            held = np.array(self.waiting.getValue((chunk,)), np.int64)
            passed = held[2] <= upto
            ready.append(held[:, passed])
            if passed.all():
                gone.append(chunk)
            else:
                self.waiting.updateValue((chunk,), tuple(held[:, ~passed].tolist()))
                first = int(held[2, ~passed].min())
            if sum(r.shape[1] for r in ready) >= BLOCK:
                yield self._held(ready, records)
                ready = []
        if ready:
            yield self._held(ready, records)
        if gone == chunks:
            self.waiting.clear()
        else:
            for chunk in gone:
                self.waiting.removeKey((chunk,))
        # what comes in later is behind no record but the last of those passed
        behind = records["us"] <= upto
        later = records[~behind]
        kept = pd.concat([records[behind].drop_duplicates(SELLER, keep="last"), later.drop_duplicates([*SELLER, "us"], keep="last")])
        if len(kept) < len(records):
            self.records.put(_entries(kept, KNOWN))
        if first is not None or len(later):
            self._wake(first if first is not None else int(later["us"].iloc[0]))

    @staticmethod
    def _held(auctions: list[np.ndarray], records: pd.DataFrame) -> pd.DataFrame:
        """The auctions that have a record at their time, with it."""
        auctions = pd.DataFrame(np.concatenate(auctions, axis=1).T, columns=LISTED).sort_values("us")
        places = records[[*SELLER, "us"]].assign(place=np.arange(len(records)))
        place = pd.merge_asof(auctions, places, on="us", by=SELLER)["place"].to_numpy(float)
        found = ~np.isnan(place)
        return _described(records.iloc[place[found].astype(np.int64)], auctions["auction_id"].to_numpy(np.int64)[found])


def lookup_as_of(auctions: DataFrame, persons: DataFrame, delay: str = "0 seconds", chunk: str = "1 hour",
                 shares: Shares | None = None, groups: int = GROUPS) -> DataFrame:
    """Each auction with the newest record of its seller at or before the auction's time, whichever of both comes in first.

    An auction waits until the watermark, ``delay`` behind the slower input's newest row, has passed it, so the result is that of the
    batch form for any order of rows within the delay; rows behind the watermark are dropped. A person counts as first at
    equal times; auctions ahead of their seller's first record are dropped. State is what waits, and of the records those
    after the watermark and the one before it. Sellers are taken in ``groups``, to be kept for the life of a checkpoint.
    """
    rows = _tagged(auctions, persons, shares, delay, groups)
    return rows.transformWithStateInPandas(AsOf(interval_micros(chunk)), RESULT, "Append", "EventTime")


class Pending(StatefulProcessor):
    """Auctions wait in a set until their seller's record comes in, or until they have waited too long."""

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "seller bigint, share bigint, id bigint", "us bigint")
        self.records = handle.getListState("records", _arrays(KNOWN))
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        listed, known = _split(rows)
        held = _rows(list(self.records.get()), KNOWN)
        newest = _newest_last(pd.concat([held, known])).drop_duplicates(SELLER, keep="last") if len(known) else held
        if len(known):
            self.records.put(_entries(newest, KNOWN))
        waiting = self._waiting()
        every = pd.concat([waiting, listed]).drop_duplicates(WAITING[:3], ignore_index=True)
        found = every.merge(newest[SELLER], on=SELLER, how="left", indicator=True)["_merge"].to_numpy() == "both"
        yield from _pairs(every[found], newest)
        held = np.arange(len(every)) < len(waiting)
        self._let_go(every[found & held], len(waiting))
        for *row, us in every.loc[~found & ~held, WAITING].itertuples(index=False):
            self.pending.updateValue(tuple(map(int, row)), (int(us),))
        self._wake(every[~found])

    def _waiting(self) -> pd.DataFrame:
        held = [(*auction, us) for auction, (us,) in self.pending.iterator()]
        return pd.DataFrame(np.array(held, np.int64).reshape(-1, len(WAITING)), columns=WAITING)

    def _let_go(self, gone: pd.DataFrame, held: int) -> None:
        if held and len(gone) == held:
            self.pending.clear()
            return
        for row in gone[WAITING[:3]].itertuples(index=False):
            self.pending.removeKey(tuple(map(int, row)))

    def _wake(self, left: pd.DataFrame) -> None:
        """A timer for the first that will have waited too long."""
        ms, held = (int(left["us"].min()) + self.wait_us) // 1000 + 1 if len(left) else None, self.due.get()
        if held is not None and held[0] == ms:
            return
        if held is not None:
            self.handle.deleteTimer(held[0])
            self.due.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        upto = timerValues.getCurrentWatermarkInMs() * 1000 - self.wait_us
        waiting = self._waiting()
        late = waiting["us"] <= upto
        self._let_go(waiting[late], len(waiting))
        self._wake(waiting[~late])
        yield from ()


def pending_join(auctions: DataFrame, persons: DataFrame, wait: str, delay: str = "0 seconds", shares: Shares | None = None,
                 groups: int = GROUPS) -> DataFrame:
    """Auctions with their seller's newest record so far; those that come in first wait for it, each id once.

    When a record comes in, all that wait are described by it and leave the state; what the watermark has left ``wait`` behind
    is dropped. After that an auction comes out at once, again with each micro-batch in which it is announced. Sellers are
    taken in ``groups``, to be kept for the life of a checkpoint.
    """
    rows = _tagged(auctions, persons, shares, delay, groups)
    return rows.transformWithStateInPandas(Pending(interval_micros(wait)), RESULT, "Append", "EventTime")


class Forgetting(StatefulProcessor):
    """Both sides of a group of sellers in stores whose entries expire some time after they came in."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.listed = handle.getListState("listed", _arrays(LISTED), self.keep_ms)
        self.known = handle.getListState("known", _arrays(KNOWN), self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        listed, known = _split(rows)
        if len(listed):
            yield from _pairs(listed, _rows(list(self.known.get()), KNOWN))
        if len(known):
            yield from _pairs(pd.concat([_rows(list(self.listed.get()), LISTED), listed]), known)
        if len(listed):
            self.listed.appendList(_entries(listed, LISTED))
        if len(known):
            self.known.appendList(_entries(known, KNOWN))


def expiring_join(auctions: DataFrame, persons: DataFrame, keep: str, shares: Shares | None = None, groups: int = GROUPS) -> DataFrame:
    """Every auction with every record of its seller of which neither came in more than ``keep`` after the other.

    Time is that of the clock, and the state of both sides goes when it is over, whatever the rows' own times. Sellers are
    taken in ``groups``, to be kept for the life of a checkpoint.
    """
    rows = _tagged(auctions, persons, shares, None, groups)
    return rows.transformWithStateInPandas(Forgetting(interval_micros(keep) // 1000), RESULT, "Append", "ProcessingTime")

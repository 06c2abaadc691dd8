"""The latest-record lookup over streams."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelstream.operators.joins import Shares

PERSON = ("name", "city", "state")
RESULT = "name string, city string, state string, auction_id long"
Local = Row(*PERSON, "auction_id")
# auctions of one key that a task holds in memory; further ones wait in the state store, on disk
HELD_AUCTIONS = 200_000


class LatestRecord(StatefulProcessor):
    """Keeps a seller's last record and describes the seller's auctions by it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "us bigint, name string, city string, state string")
        self.waiting = handle.getListState("waiting", "us bigint, auction_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        people, auction_us, auction_ids, waiting = [], array("q"), array("q"), False
        for _, _, us, auction_id, is_auction, *person in rows:
            if is_auction:
                auction_us.append(us)
                auction_ids.append(auction_id)
                if len(auction_us) >= HELD_AUCTIONS:
                    self.waiting.appendList(list(zip(auction_us, auction_ids)))
                    auction_us, auction_ids, waiting = array("q"), array("q"), True
            else:
                people.append((us, person))
        if held := self.record.get():
            people.append((held[0], list(held[1:])))
        people.sort(key=lambda p: (p[0], [(text is not None, text or "") for text in p[1]]))
        if people and (not held or people[-1] != (held[0], list(held[1:]))):
            self.record.update((people[-1][0], *people[-1][1]))
        times = [us for us, _ in people]
        for us, auction_id in chain(self.waiting.get() if waiting else (), zip(auction_us, auction_ids)):
            if holder := bisect_right(times, us):
                yield Local(*people[holder - 1][1], auction_id)
        if waiting:
            self.waiting.clear()


def lookup_latest(auctions: DataFrame, persons: DataFrame, shares: Shares | None = None) -> DataFrame:
    """Each auction with its seller's newest record, of those that have arrived, at the auction's time.

    A person counts as first at equal times. Between micro-batches only the newest record by event time is
    kept: an older one that comes later does not replace it, and an auction older than what is kept and
    than its own micro-batch's records is dropped like one that has no record so far. Each share of a seller
    keeps the seller's record. Of a key's auctions in a micro-batch a bounded number is held in memory.
    """
    shares = (shares or Shares(1)).numbered(auctions)
    complete = F.col("seller").isNotNull() & F.col("id").isNotNull() & F.col("ts").isNotNull()
    listed = auctions.where(complete).select(
        F.col("seller").alias("id"), shares.of(F.col("id"), F.col("seller")).alias("share"),
        F.unix_micros("ts").alias("us"), F.col("id").alias("auction_id"),
        F.lit(True).alias("is_auction"), *[F.lit(None).cast("string").alias(c) for c in PERSON])
    known = persons.where(F.col("id").isNotNull() & F.col("ts").isNotNull()).select(
        "id", shares.every(F.col("id")).alias("share"), F.unix_micros("ts").alias("us"),
        F.lit(None).cast("long").alias("auction_id"), F.lit(False).alias("is_auction"), *PERSON)
    return (listed.unionByName(known)
            .groupBy("id", "share")
            .transformWithState(LatestRecord(), RESULT, "Append", "None"))

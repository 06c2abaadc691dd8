"""Joins of auctions with persons.

Batch joins leave hot sellers to AQE, which splits skewed partitions without repeating
anything. A stateful join pins a key to one task, so streams take ``Shares``: a hot
seller's auctions can be dealt out to several shares, and the seller's person records,
the narrow side, are repeated once per share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.functions import bucket_start, interval_micros


@dataclass(frozen=True)
class Shares:
    """How many shares a key is split into: those in ``hot``, or every key where that is None.

    Without a number there are as many shares as state partitions. Any key gives the same
    result in any number of shares, but a stream's state depends on it: keep the same
    shares for as long as its checkpoint is in use.
    """

    number: int | None = None
    hot: Sequence[int] | None = None

    def __post_init__(self) -> None:
        if self.number is not None and self.number < 1:
            raise ValueError("number: 1 or more")

    def numbered(self, df: DataFrame) -> Shares:
        """These shares with their number, if need be that of the session's partitions."""
        return self if self.number else Shares(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.hot)

    def of(self, row_id: Column, key: Column) -> Column:
        """The share a row belongs to."""
        dealt = F.pmod(F.xxhash64(row_id), F.lit(self.number)).cast("int")
        return dealt if self.hot is None else F.when(key.isin(*self.hot), dealt).otherwise(0)

    def every(self, key: Column) -> Column:
        """One row for each share of the key."""
        numbers = F.sequence(F.lit(0), F.lit(self.number - 1))
        if self.hot is not None:
            numbers = F.when(key.isin(*self.hot), numbers).otherwise(F.array(F.lit(0)))
        return F.explode(numbers)


def hot_keys(df: DataFrame, key: str, portion: float = 0.01) -> list[int]:
    """Keys that hold at least this portion of a table's rows, at most 1 / ``portion``.

    Run it over past data to give a stream's ``Shares`` their hot keys.
    """
    if not 0 < portion <= 1:
        raise ValueError("portion: over 0, at most 1")
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("num"))
    at_least = portion * df.where(F.col(key).isNotNull()).count()
    return sorted(row[0] for row in counts.where(F.col("num") >= at_least).select(key).collect())


def join_on_seller(auctions: DataFrame, persons: DataFrame, shares: Shares | None,
                   *more: Column) -> DataFrame:
    """``auctions`` has seller (and auction_id if in shares), ``persons`` has person_id."""
    on = F.col("seller") == F.col("person_id")
    if shares is not None:
        shares = shares.numbered(auctions)
        auctions = auctions.withColumn("auction_share", shares.of(F.col("auction_id"), F.col("seller")))
        persons = persons.withColumn("person_share", shares.every(F.col("person_id")))
        on = on & (F.col("auction_share") == F.col("person_share"))
    for condition in more:
        on = on & condition
    return auctions.join(persons, on, "inner")


def incremental_join(auctions: DataFrame, persons: DataFrame, within: str | None = None,
                     shares: Shares | None = None, once: bool = False) -> DataFrame:
    """Every auction with every record of its seller, over all history.

    A stream of it keeps both inputs for good. ``within`` bounds that: a pair must
    then lie at most so far apart in event time, and older state is let go by the
    watermarks that the inputs carry on ``ts``. Time is cut into buckets as wide as the
    reach, and a record stands in its own and the two next to it, so auctions only
    meet records that are near in time. With ``once`` an auction id and a record come out
    once, however often the auction was announced within the reach.
    """
    left = auctions.select("seller", F.col("id").alias("auction_id"), F.col("ts").alias("auction_ts"))
    right = persons.select(F.col("id").alias("person_id"), "name", "city", "state",
                           F.col("ts").alias("person_ts"))
    near = []
    if within is not None:
        width = interval_micros(within)
        reach = F.expr(f"INTERVAL '{width} microseconds'")
        own = bucket_start(F.unix_micros("person_ts"), width)
        left = left.withColumn("auction_bucket", bucket_start(F.unix_micros("auction_ts"), width))
        right = right.withColumn("person_bucket", F.explode(F.array(own - width, own, own + width)))
        near = [F.col("auction_bucket") == F.col("person_bucket")]
        if auctions.isStreaming:
            # in this form Spark reads off the condition when state can go; its sessions are in UTC
            near += [F.col("auction_ts") >= F.col("person_ts") - reach, F.col("auction_ts") <= F.col("person_ts") + reach]
        else:
            near.append(F.abs(F.unix_micros("auction_ts") - F.unix_micros("person_ts")) <= width)
    else:
        left, right = left.drop("auction_ts"), right.drop("person_ts")
    pairs = join_on_seller(left, right, shares, *near)
    if once:
        record = ["auction_id", "person_id", *(["person_ts"] if within else []), "name", "city", "state"]
        pairs = pairs.select(record)
        pairs = pairs.dropDuplicatesWithinWatermark() if pairs.isStreaming else pairs.distinct()
    return pairs.select("name", "city", "state", "auction_id")


def distinct_listings(auctions: DataFrame) -> DataFrame:
    """One row per seller and auction id, however often the auction was announced.

    The first announcement counts for event time. Announcements are merged inside
    each map task before the shuffle.
    """
    return auctions.groupBy("seller", "id").agg(F.min("ts").alias("ts"))


def lookup_latest(auctions: DataFrame, persons: DataFrame, chunk: str = "1 hour") -> DataFrame:
    """Each auction with the newest record of its seller at or before the auction's time.

    Auctions ahead of their seller's first record are dropped; at equal times the
    person counts as first. Only the records are put in order: each holds until the next
    one in its chunk of time, and the record that holds at the start of a chunk in which there are
    auctions is carried into it. Auctions are joined to the record of their chunk that
    holds at their time; they are never sorted by seller, and AQE splits a hot chunk.
    """
    width = interval_micros(chunk)
    us = F.unix_micros("ts")
    listed = (auctions.where(F.col("seller").isNotNull() & F.col("ts").isNotNull())
              .select(F.col("seller").alias("seller_id"), F.col("id").alias("auction_id"), us.alias("at"))
              .withColumn("at_chunk", bucket_start(F.col("at"), width)))
    # of several records at one instant the greatest holds
    known = (persons.where(F.col("id").isNotNull() & F.col("ts").isNotNull())
             .select("id", F.struct("name", "city", "state").alias("person"), us.alias("us"))
             .groupBy("id", "us").agg(F.max("person").alias("person"))
             .withColumn("chunk", bucket_start(F.col("us"), width)))

    ends = known.groupBy("id", "chunk").agg(F.max(F.struct("us", "person")).alias("newest"))
    marks = (listed.select(F.col("seller_id").alias("id"), F.col("at_chunk").alias("chunk")).distinct()
             .withColumn("newest", F.lit(None))
             .unionByName(ends.select("id", "chunk", F.col("newest.person").alias("newest"))))
    earlier_chunks = (Window.partitionBy("id").orderBy("chunk")
                      .rangeBetween(Window.unboundedPreceding, -1))
    # just ahead of the chunk, so that a record of its first instant comes after
    carried = (marks
               .withColumn("person", F.last("newest", ignorenulls=True).over(earlier_chunks))
               .where(F.col("newest").isNull() & F.col("person").isNotNull())
               .select("id", (F.col("chunk") - 1).alias("us"), "person", "chunk"))
    in_chunk = Window.partitionBy("id", "chunk").orderBy("us")
    holding = (carried.unionByName(known.select("id", "us", "person", "chunk"))
               .withColumn("next", F.coalesce(F.lead("us").over(in_chunk), F.col("chunk") + width)))
    held = ((F.col("seller_id") == F.col("id")) & (F.col("at_chunk") == F.col("chunk"))
            & (F.col("at") >= F.col("us")) & (F.col("at") < F.col("next")))
    return listed.join(holding, held).select("person.name", "person.city", "person.state", "auction_id")


def window_join(auctions: DataFrame, persons: DataFrame, size: str) -> DataFrame:
    """Auctions and their seller's records that fall into the same tumbling window."""
    width = interval_micros(size)
    left = auctions.select("seller", "reserve",
                           bucket_start(F.unix_micros("ts"), width).alias("auction_window"))
    right = persons.select(F.col("id").alias("person_id"), "name",
                           bucket_start(F.unix_micros("ts"), width).alias("person_window"))
    same_window = F.col("auction_window") == F.col("person_window")
    return join_on_seller(left, right, None, same_window).select("person_id", "name", "reserve")

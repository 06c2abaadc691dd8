"""User sessions over batch tables.

A bidder's bids within one pane as long as the gap always share a session, so they are
merged into one row before anything is shuffled by bidder. What reaches the task of a
hot bidder is at most one row per gap of elapsed time, whatever the number of bids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gavelstream.functions import bucket_start, interval_micros


# wider than the range of 64-bit auction ids
AUCTION_SPAN = "20000000000000000000"


def _span() -> Column:
    return F.lit(AUCTION_SPAN).cast("decimal(20,0)")


def _bid_order() -> Column:
    """Time and auction of a bid as one number that orders by both.

    Spark keeps a maximum of decimals in its hash aggregation, but sorts all rows for a
    maximum of structs, which took three times as long.
    """
    return F.col("us").cast("decimal(18,0)") * _span() + F.col("auction").cast("decimal(19,0)")


def _auction_of(bid_order: Column) -> Column:
    past = F.pmod(bid_order, _span())
    return F.when(past < _span() / 2, past).otherwise(past - _span()).cast("long")


def _by_pane() -> WindowSpec:
    return Window.partitionBy("bidder").orderBy("pane")


def _in_panes(bids: DataFrame, gap_us: int) -> DataFrame:
    return (bids.where(F.col("ts").isNotNull())
            .select("bidder", "auction", F.unix_micros("ts").alias("us"))
            .withColumn("pane", bucket_start(F.col("us"), gap_us)))


def _opens_session(gap_us: int) -> Column:
    """Whether a pane starts a session; bids exactly one gap apart stay together."""
    previous = F.lag("last_us").over(_by_pane())
    return previous.isNull() | (F.col("first_us") - previous > gap_us)


def _millis(us: Column) -> Column:
    return F.unix_millis(F.timestamp_micros(us))


def session_counts(bids: DataFrame, gap: str) -> DataFrame:
    """Bids per session of a bidder, with its bounds and the auction of its last bid.

    The last bid is the last that names an auction; of several at the same instant the highest
    auction id is reported.
    """
    gap_us = interval_micros(gap)
    return (_in_panes(bids, gap_us)
            .groupBy("bidder", "pane")
            .agg(F.count(F.lit(1)).alias("num"), F.min("us").alias("first_us"),
                 F.max("us").alias("last_us"), F.max(_bid_order()).alias("last_bid"))
            .withColumn("opens", _opens_session(gap_us))
            .withColumn("session", F.sum(F.col("opens").cast("long")).over(_by_pane()))
            .groupBy("bidder", "session")
            .agg(F.sum("num").alias("num"), F.min("first_us").alias("start_us"),
                 F.max("last_us").alias("last_us"), F.max("last_bid").alias("last_bid"))
            .select("bidder", "num", _millis(F.col("start_us")).alias("start_ms"),
                    _millis(F.col("last_us") + gap_us).alias("end_ms"),
                    _auction_of(F.col("last_bid")).alias("last_auction")))


def session_firings(bids: DataFrame, gap: str, max_events: int) -> DataFrame:
    """Running count at each ``max_events``-th bid of a session, and its total at the end.

    Rows are (bidder, num, end_ms_or_fire_ms, is_final). Panes are made once; bids are
    looked at again only in panes in which a count is due, and there bids of the same
    millisecond count as one row: a group never exceeds the milliseconds of one gap. A null
    bidder is one like any other.
    """
    if max_events < 1:
        raise ValueError("max_events: 1 or more")
    gap_us = interval_micros(gap)
    if gap_us % 1000:
        raise ValueError("the gap must be in whole milliseconds")
    paned = _in_panes(bids, gap_us)
    before = F.coalesce(
        F.sum("num").over(_by_pane().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    panes = (paned.groupBy("bidder", "pane")
             .agg(F.count(F.lit(1)).alias("num"), F.min("us").alias("first_us"),
                  F.max("us").alias("last_us"))
             .withColumn("opens", _opens_session(gap_us))
             .withColumn("before", before)
             .withColumn("session", F.sum(F.col("opens").cast("long")).over(_by_pane()))
             # bids of the same session ahead of this pane
             .withColumn("ahead", F.col("before") - F.max(F.when(F.col("opens"), F.col("before"))).over(_by_pane())))

    finals = (panes.groupBy("bidder", "session")
              .agg(F.sum("num").alias("num"), F.max("last_us").alias("last_us"))
              .select("bidder", "num", _millis(F.col("last_us") + gap_us).alias("end_ms_or_fire_ms"),
                      F.lit(True).alias("is_final")))

    due = (panes.where(F.col("ahead") % max_events + F.col("num") >= max_events)
           .select(F.col("bidder").alias("due_bidder"), F.col("pane").alias("due_pane"), "ahead"))
    in_due = F.col("bidder").eqNullSafe(F.col("due_bidder")) & (F.col("pane") == F.col("due_pane"))
    instants = (paned.select("bidder", "pane", _millis(F.col("us")).alias("ms")).join(due, in_due)
                .groupBy("bidder", "pane", "ms").agg(F.count(F.lit(1)).alias("num"), F.first("ahead").alias("ahead")))
    by_instant = Window.partitionBy("bidder", "pane").orderBy("ms")
    counted = (instants
               .withColumn("upto", F.col("ahead") + F.sum("num").over(by_instant))
               .withColumn("held", F.col("upto") - F.col("num"))
               .withColumn("first_due", F.col("held") - F.col("held") % max_events + max_events)
               .where(F.col("first_due") <= F.col("upto")))
    partials = counted.select(
        "bidder", F.explode(F.sequence("first_due", "upto", F.lit(max_events).cast("long"))).alias("num"),
        F.col("ms").alias("end_ms_or_fire_ms"), F.lit(False).alias("is_final"))
    return partials.unionByName(finals)

"""Sliding-window counts, their maximum and the hot items over bid streams.

Results come out once the watermark has passed the end of a window. Here a bid is
counted in its windows directly: with panes, a bid late for its pane but not for the
later windows around it would be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.functions import epoch_millis
from gavelstream.operators import windows
from gavelstream.operators.joins import Shares
from gavelstream.streaming.runner import PerBatch

RESULT = "auction long, num long, window_end_ms long"


def window_counts(bids: DataFrame, size: str, slide: str, delay: str = "0 seconds") -> DataFrame:
    return (bids.withWatermark("ts", delay)
            .groupBy(F.window("ts", size, slide).alias("window"), "auction")
            .agg(F.count(F.lit(1)).alias("num"))
            .select("auction", "num", epoch_millis(F.col("window.end")).alias("window_end_ms"), "window"))


def window_max(bids: DataFrame, size: str, slide: str, delay: str = "0 seconds") -> DataFrame:
    return (window_counts(bids, size, slide, delay).groupBy("window").agg(F.max("num").alias("max_num"))
            .select("max_num", epoch_millis(F.col("window.end")).alias("window_end_ms")))


def hot_items_stream(bids: DataFrame, peaks_of: DataFrame | None, size: str, slide: str, delay: str = "0 seconds") -> DataFrame:
    """The hot items as a stream that other operators can go on with: auction, num, window_end_ms, window.

    Counts, their maxima and the join of both are one plan; the watermark goes through it, and the state of a window goes once it is
    closed. The input is read and counted for either side. Auctions are dealt out to as many shares as there are state
    partitions and a window's maximum goes to each, so that the counts of a window don't meet in one task.
    """
    shares = Shares().numbered(bids)
    counts = window_counts(bids, size, slide, delay).withColumn("share", shares.of(F.col("auction"), F.col("auction")))
    # counted anew, for two uses of one watermark would count as one
    peaks = (window_counts(bids if peaks_of is None else peaks_of, size, slide, delay)
             .groupBy("window").agg(F.max("num").alias("max_num"))
             .select(F.col("window").alias("peak_window"), "max_num", shares.every(F.lit(None)).alias("peak_share")))
    reached = ((F.col("window") == F.col("peak_window")) & (F.col("share") == F.col("peak_share")) & (F.col("num") >= F.col("max_num")))
    return counts.join(peaks, reached).select("auction", "num", "window_end_ms", "window")


def hot_items(bids: DataFrame, peaks_of: DataFrame | None, size: str, slide: str, delay: str = "0 seconds") -> PerBatch:
    """All auctions of ``bids``, ties included, that reach the window's maximum, their own or that of ``peaks_of``.

    The only state is each input's counts. A window closes for all its auctions, and for both inputs, in the
    same micro-batch, so its maximum and those who reach it are found in that batch's finished rows. With two inputs
    a window closes when the slower one's watermark has passed it.
    """
    counts = window_counts(bids, size, slide, delay).drop("window").withColumn("of", F.lit(1))
    if peaks_of is not None:
        counts = counts.unionByName(
            window_counts(peaks_of, size, slide, delay).drop("window").withColumn("of", F.lit(2)))
    peaks = 1 if peaks_of is None else 2

    def finish(closed: DataFrame) -> DataFrame:
        return windows.at_window_max(closed.where("of = 1").drop("of"), windows.window_max(closed.where(F.col("of") == peaks)))

    return PerBatch(counts, finish, RESULT)

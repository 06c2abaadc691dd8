"""Sliding-window counts, their maximum, and the hot items, over batch tables.

Bids are first counted in panes, the widest slices that no window edge cuts, with partial
counts map-side: a hot auction costs one row per pane and task. A pane is not copied into its windows: it adds its
count at the first of them and takes it back after the last, and running sums per auction give runs of windows with
equal counts. Panes are brought together by stretches of window starts; one near the end of a stretch goes to two.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.functions import bucket_start, interval_micros

# stretches are this many windows long
STRETCH = 16


class Sliding:
    """Windows of ``size`` that start every ``slide``, and the stretches they are dealt out by."""

    def __init__(self, size: str, slide: str):
        self.size, self.slide = interval_micros(size), interval_micros(slide)
        if self.slide > self.size:
            raise ValueError("the slide must not be longer than the window")
        self.pane = gcd(self.size, self.slide)
        self.slots = STRETCH * -(-self.size // self.slide)
        self.stretch = self.slots * self.slide

    def panes(self, bids: DataFrame) -> DataFrame:
        """(auction, pane, num) with a row for each stretch of windows that the pane lies in."""
        first, last = self._starts()
        stretches = F.sequence(bucket_start(first, self.stretch), bucket_start(last, self.stretch), F.lit(self.stretch))
        return (bids.where(F.col("ts").isNotNull())
                .select("auction", bucket_start(F.unix_micros("ts"), self.pane).alias("pane"))
                .groupBy("auction", "pane").agg(F.count(F.lit(1)).alias("num"))
                .withColumn("stretch", F.explode(stretches)))

    def runs(self, panes: DataFrame, *more: str) -> DataFrame:
        """(more, stretch, auction, begin, end, num): an auction's windows with equal counts, by their places in the stretch.

        Two rows for each pane, however many windows cover it. ``panes`` are together by columns that
        are among ``more``, stretch and auction.
        """
        first, last = self._starts()
        opens = F.greatest(first, F.col("stretch"))
        closes = F.least(last + self.slide, F.col("stretch") + self.stretch)
        keys = [*more, "stretch", "auction"]
        changes = (panes.select(*keys, F.explode(F.array(
            F.struct(self._place(opens).alias("begin"), F.col("num").alias("change")),
            F.struct(self._place(closes).alias("begin"), (-F.col("num")).alias("change")))).alias("c"))
            .groupBy(*keys, "c.begin").agg(F.sum("c.change").alias("change")).where("change <> 0"))
        in_order = Window.partitionBy(*keys).orderBy("begin")
        return (changes.withColumn("num", F.sum("change").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("end", F.lead("begin").over(in_order))
                .where("num > 0").select(*keys, "begin", "end", "num"))

    def peaks(self, runs: DataFrame) -> DataFrame:
        """(stretch, place, peak): the largest count of each window, 0 for windows without bids in a stretch that has any.

        A run is taken apart into blocks of 1, 2, 4 ... places, aligned to their length, at most two of each length. Their
        maxima are what is shuffled; a stretch has fewer than two blocks to a place.
        """
        size = F.expr("shiftleft(1L, level)")
        block = F.explode(F.array(
            F.when((F.col("from") < F.col("upto")) & (F.col("from") % 2 == 1), F.col("from")),
            F.when((F.col("from") < F.col("upto")) & (F.col("upto") % 2 == 1), F.col("upto") - 1)))
        # the longest blocks that fit into the run
        longest = (F.length(F.bin(F.col("end") - F.col("begin"))) - 1).cast("int")
        blocks = (runs.select("stretch", "begin", "end", "num", F.explode(F.sequence(F.lit(0), longest)).alias("level"))
                  .select("stretch", "num", "level", F.expr("shiftright(begin + shiftleft(1L, level) - 1, level)").alias("from"),
                          F.expr("shiftright(end, level)").alias("upto"))
                  .select("stretch", "num", "level", block.alias("block")).where(F.col("block").isNotNull())
                  .groupBy("stretch", "level", "block").agg(F.max("num").alias("num"))
                  # from here on a stretch is in one place
                  .repartition("stretch"))
        begin = F.col("block") * size
        places = blocks.select("stretch", F.explode(F.sequence(begin, begin + size - 1)).alias("place"), "num")
        empty = blocks.select("stretch").distinct().select(
            "stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.slots - 1).cast("long"))).alias("place"),
            F.lit(0).cast("long").alias("num"))
        return places.unionByName(empty).groupBy("stretch", "place").agg(F.max("num").alias("peak"))

    def end_ms(self, place: Column) -> Column:
        """The end of the window at a place of its stretch."""
        return F.unix_millis(F.timestamp_micros(F.col("stretch") + place * self.slide + self.size))

    def _starts(self) -> tuple[Column, Column]:
        pane = F.col("pane")
        return -bucket_start(-(pane + self.pane - self.size), self.slide), bucket_start(pane, self.slide)

    def _place(self, start: Column) -> Column:
        return ((start - F.col("stretch")) / self.slide).cast("long")


def window_counts(bids: DataFrame, size: str, slide: str) -> DataFrame:
    """Bids per auction and sliding window, as (auction, num, window_end_ms)."""
    windows = Sliding(size, slide)
    return (windows.runs(windows.panes(bids).repartition("auction", "stretch"))
            .withColumn("place", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)))
            .select("auction", "num", windows.end_ms(F.col("place")).alias("window_end_ms")))


def window_max(counts: DataFrame) -> DataFrame:
    """Largest count of each window; partial maxima leave the map tasks, never the rows."""
    return counts.groupBy("window_end_ms").agg(F.max("num").alias("max_num"))


def window_peaks(bids: DataFrame, size: str, slide: str) -> DataFrame:
    """(max_num, window_end_ms) of ``bids``, from runs of equal counts."""
    windows = Sliding(size, slide)
    peaks = windows.peaks(windows.runs(windows.panes(bids).repartition("auction", "stretch"))).where("peak > 0")
    return peaks.select(F.col("peak").alias("max_num"), windows.end_ms(F.col("place")).alias("window_end_ms"))


def hot_items(bids: DataFrame, peaks_of: DataFrame, size: str, slide: str) -> DataFrame:
    """All auctions of ``bids``, ties included, that reach the maximum of ``peaks_of`` in a window.

    Auctions are dealt out to shares, and a share's panes of one stretch meet in one task, which makes runs of windows of
    them. The maxima of all windows of a stretch then go to every share as one row, and a run looks
    up whether it reaches any of those along it; only one that does is copied, into the windows where it does.
    """
    windows = Sliding(size, slide)
    shares = int(bids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame) -> DataFrame:
        share = F.pmod(F.xxhash64("auction"), F.lit(shares)).cast("int")
        # the join asks for keys that are not null; asked for both inputs, they read one shuffle
        panes = windows.panes(df).withColumn("share", share).where("share IS NOT NULL AND stretch IS NOT NULL")
        return windows.runs(panes.repartition(shares, "share", "stretch"), "share")

    in_order = F.sort_array(F.collect_list(F.struct("place", "peak")))["peak"]
    peaks = (windows.peaks(dealt(peaks_of)).groupBy("stretch").agg(in_order.alias("peaks"))
             .select(F.col("stretch").alias("peak_stretch"), "peaks",
                     F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("peak_share")))
    # the hint keeps the maxima from being broadcast to all tasks, which need one stretch's at a time
    met = dealt(bids).join(peaks.hint("merge"), (F.col("share") == F.col("peak_share"))
                           & (F.col("stretch") == F.col("peak_stretch")))
    along = F.slice("peaks", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    # a window in which the other input has no bids has no maximum to reach
    reached = F.filter(F.transform(along, lambda peak, i: F.when((peak > 0) & (peak <= F.col("num")), F.col("begin") + i)), F.isnotnull)
    return (met.where(F.array_min(along) <= F.col("num"))
            .select("auction", "num", "stretch", F.explode(reached).alias("place"))
            .select("auction", "num", windows.end_ms(F.col("place")).alias("window_end_ms")))


def at_window_max(counts: DataFrame, maxima: DataFrame) -> DataFrame:
    """All rows of finished ``counts``, ties included, that reach their window's maximum."""
    peaks = maxima.select(F.col("window_end_ms").alias("peak_end_ms"), "max_num")
    reached = (F.col("window_end_ms") == F.col("peak_end_ms")) & (F.col("num") >= F.col("max_num"))
    return counts.join(peaks.hint("merge"), reached).select("auction", "num", "window_end_ms")

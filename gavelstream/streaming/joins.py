"""The window join over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.operators.joins import Shares, join_on_seller


def window_join(auctions: DataFrame, persons: DataFrame, size: str,
                shares: Shares | None = None, delay: str = "0 seconds") -> DataFrame:
    """Auctions and their seller's records that fall into the same tumbling window.

    Both sides carry their window as a join key, by which Spark lets go of the state of
    windows the watermark has passed.
    """
    left = (auctions.withWatermark("ts", delay)
            .select("seller", "reserve", F.col("id").alias("auction_id"),
                    F.window("ts", size).alias("auction_window")))
    right = (persons.withWatermark("ts", delay)
             .select(F.col("id").alias("person_id"), "name",
                     F.window("ts", size).alias("person_window")))
    same_window = F.col("auction_window") == F.col("person_window")
    return join_on_seller(left, right, shares, same_window).select("person_id", "name", "reserve")

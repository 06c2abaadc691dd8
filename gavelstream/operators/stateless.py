"""Projections and filters. Row by row, so the same plan serves tables and streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.functions import divisible_by_any, epoch_millis, to_euro


def convert_bids(bids: DataFrame, rate: float) -> DataFrame:
    return bids.select("auction", to_euro(F.col("price"), rate).alias("price_eur"), "bidder",
                       epoch_millis(F.col("ts")).alias("epoch_ms"))


def bids_on_multiples(bids: DataFrame, divisors: Iterable[int]) -> DataFrame:
    """Price of bids whose auction id is a multiple of any divisor; id 0 is one of all."""
    return bids.where(divisible_by_any(F.col("auction"), divisors)).select("auction", "price")


def bids_on_listed(bids: DataFrame, auction_ids: Iterable[int]) -> DataFrame:
    """Price of bids on the listed auctions; the list reaches the Parquet scan."""
    return bids.where(F.col("auction").isin(*auction_ids)).select("auction", "price")


def in_category(auctions: DataFrame, category: int) -> DataFrame:
    return auctions.where(F.col("category") == category)


def in_states(persons: DataFrame, states: Iterable[str]) -> DataFrame:
    return persons.where(F.col("state").isin(*states))

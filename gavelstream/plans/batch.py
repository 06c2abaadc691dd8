"""The queries over tables. Inputs are the views of ``gavelstream.sources``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.operators import joins, sessions, stateless, user_aggregates, windows
from gavelstream.plans import defaults as d


def currency_conversion(bids: DataFrame, rate: float = d.EXCHANGE_RATE) -> DataFrame:
    """Query 1: bid prices in euro."""
    return stateless.convert_bids(bids, rate)


def selected_bids(bids: DataFrame, divisors: Iterable[int] = d.AUCTION_DIVISORS) -> DataFrame:
    """Query 2: bids on auctions whose id is a multiple of a divisor."""
    return stateless.bids_on_multiples(bids, divisors)


def listed_bids(bids: DataFrame, auction_ids: Iterable[int] = d.AUCTION_LIST) -> DataFrame:
    """Query 2 as documented: bids on the listed auctions."""
    return stateless.bids_on_listed(bids, auction_ids)


def local_items(auctions: DataFrame, persons: DataFrame, category: int = d.LOCAL_CATEGORY,
                states: Iterable[str] = d.LOCAL_STATES, within: str | None = None) -> DataFrame:
    """Query 3: who sells in the category and the states; either side may come first."""
    return joins.incremental_join(stateless.in_category(auctions, category),
                                  stateless.in_states(persons, states), within)


def local_items_distinct(auctions: DataFrame, persons: DataFrame,
                         category: int = d.LOCAL_CATEGORY,
                         states: Iterable[str] = d.LOCAL_STATES, within: str | None = None) -> DataFrame:
    """Query 3 with repeated announcements of an auction taken once."""
    listed, known = stateless.in_category(auctions, category), stateless.in_states(persons, states)
    if within is not None:
        return joins.incremental_join(listed, known, within, once=True)
    return joins.incremental_join(joins.distinct_listings(listed), known)


def local_items_latest(auctions: DataFrame, persons: DataFrame, category: int = d.LOCAL_CATEGORY,
                       states: Iterable[str] = d.LOCAL_STATES, chunk: str = "1 hour") -> DataFrame:
    """Query 3 as a lookup: the seller's newest record so far, none if there is none yet."""
    return joins.lookup_latest(stateless.in_category(auctions, category),
                               stateless.in_states(persons, states), chunk)


def bid_counts(bids: DataFrame, size: str = d.HOT_ITEMS_SIZE,
               slide: str = d.HOT_ITEMS_SLIDE) -> DataFrame:
    return windows.window_counts(bids, size, slide)


def max_bid_count(bids: DataFrame, size: str = d.HOT_ITEMS_SIZE,
                  slide: str = d.HOT_ITEMS_SLIDE) -> DataFrame:
    return windows.window_peaks(bids, size, slide)


def hot_items(bids: DataFrame, size: str = d.HOT_ITEMS_SIZE,
              slide: str = d.HOT_ITEMS_SLIDE) -> DataFrame:
    """Query 5: the auctions with the most bids of each window."""
    return windows.hot_items(bids, bids, size, slide)


def hot_items_of_two(bids_one: DataFrame, bids_two: DataFrame, size: str = d.HOT_ITEMS_SIZE,
                     slide: str = d.HOT_ITEMS_SLIDE) -> DataFrame:
    """Query 5 over two inputs: counts of the first against the maxima of the second."""
    return windows.hot_items(bids_one, bids_two, size, slide)


def new_users(auctions: DataFrame, persons: DataFrame, size: str = d.NEW_USERS_SIZE) -> DataFrame:
    """Query 8: people who signed up and listed an auction in the same window."""
    return joins.window_join(auctions, persons, size)


def user_sessions(bids: DataFrame, gap: str = d.SESSION_GAP) -> DataFrame:
    """Query 11: bids per session of a user."""
    return sessions.session_counts(bids, gap)


def user_sessions_by_aggregate(bids: DataFrame, gap: str = d.SESSION_GAP) -> DataFrame:
    """Query 11 with its count written as a user's aggregate; the columns of ``user_sessions``."""
    timed = bids.withColumn("us", F.unix_micros("ts"))
    found = user_aggregates.by_session(timed, ["bidder"], ["us", "auction"], user_aggregates.BidCount(), "num long, last_auction long", gap)
    return found.select("bidder", "num", "start_ms", "end_ms", "last_auction")


def session_firings(bids: DataFrame, gap: str = d.SESSION_GAP,
                    max_events: int = d.SESSION_MAX_EVENTS) -> DataFrame:
    """Query 11 with the running count every ``max_events`` bids."""
    return sessions.session_firings(bids, gap, max_events)

"""The queries over streams, in append mode.

Windowed results appear when the watermark, ``delay`` behind the largest event time so far, has
passed their end. Inputs should come from a session of ``gavelstream.session.streaming_session``.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

from gavelstream.functions import interval_micros
from gavelstream.operators import stateless
from gavelstream.operators.joins import Shares, incremental_join
from gavelstream.plans import defaults as d
from gavelstream.plans.batch import currency_conversion, listed_bids, selected_bids
from gavelstream.streaming import firings, joins, keyed, lookup, sessions, windows
from gavelstream.streaming.runner import PerBatch

__all__ = ["bid_counts", "currency_conversion", "hot_items", "hot_items_of_two", "hot_items_stream", "listed_bids",
           "local_items", "local_items_as_of", "local_items_distinct", "local_items_expiring", "local_items_latest", "local_items_pending", "max_bid_count", "new_users",
           "selected_bids", "session_firings", "session_firings_by_slots", "user_sessions"]


def local_items(auctions: DataFrame, persons: DataFrame, category: int = d.LOCAL_CATEGORY,
                states: Iterable[str] = d.LOCAL_STATES, within: str | None = None,
                shares: Shares | None = None, delay: str = d.DELAY) -> DataFrame:
    """Query 3; without ``within`` both inputs stay in state for good."""
    listed, known = stateless.in_category(auctions, category), stateless.in_states(persons, states)
    if within is not None:
        listed, known = listed.withWatermark("ts", delay), known.withWatermark("ts", delay)
    return incremental_join(listed, known, within, shares)


def local_items_distinct(auctions: DataFrame, persons: DataFrame,
                         category: int = d.LOCAL_CATEGORY,
                         states: Iterable[str] = d.LOCAL_STATES, within: str | None = None,
                         shares: Shares | None = None, delay: str = d.DELAY) -> DataFrame:
    """Query 3 with repeated announcements of an auction taken once.

    Without ``within`` every announced auction id stays in state for good. With it, a pair is known for as long as
    the auction may be announced again within the person's reach.
    """
    listed, known = stateless.in_category(auctions, category), stateless.in_states(persons, states)
    if within is None:
        return incremental_join(listed.dropDuplicates(["seller", "id"]), known, shares=shares)
    behind = f"{(interval_micros(within) + pd.Timedelta(delay).value // 1000) // 1000 + 1} milliseconds"
    return incremental_join(listed.withWatermark("ts", behind), known.withWatermark("ts", behind), within, shares, once=True)


def local_items_latest(auctions: DataFrame, persons: DataFrame, category: int = d.LOCAL_CATEGORY,
                       states: Iterable[str] = d.LOCAL_STATES,
                       shares: Shares | None = None) -> DataFrame:
    """Query 3 as a lookup of the seller's newest record."""
    return lookup.lookup_latest(stateless.in_category(auctions, category),
                                stateless.in_states(persons, states), shares)


def local_items_as_of(auctions: DataFrame, persons: DataFrame, category: int = d.LOCAL_CATEGORY,
                      states: Iterable[str] = d.LOCAL_STATES, delay: str = d.DELAY, chunk: str = "1 hour",
                      shares: Shares | None = None) -> DataFrame:
    """Query 3 as a lookup by event time: the rows of the batch form, however the inputs are cut into files."""
    return keyed.lookup_as_of(stateless.in_category(auctions, category), stateless.in_states(persons, states), delay, chunk, shares)


def local_items_pending(auctions: DataFrame, persons: DataFrame, wait: str, category: int = d.LOCAL_CATEGORY,
                        states: Iterable[str] = d.LOCAL_STATES, delay: str = d.DELAY, shares: Shares | None = None) -> DataFrame:
    """Query 3 with a set of auctions that wait for their seller, for ``wait`` at most, and leave it with the first record."""
    return keyed.pending_join(stateless.in_category(auctions, category), stateless.in_states(persons, states), wait, delay, shares)


def local_items_expiring(auctions: DataFrame, persons: DataFrame, keep: str, category: int = d.LOCAL_CATEGORY,
                         states: Iterable[str] = d.LOCAL_STATES, shares: Shares | None = None) -> DataFrame:
    """Query 3 with state that is forgotten ``keep`` after it came in, by the clock."""
    return keyed.expiring_join(stateless.in_category(auctions, category), stateless.in_states(persons, states), keep, shares)


def bid_counts(bids: DataFrame, size: str = d.HOT_ITEMS_SIZE,
               slide: str = d.HOT_ITEMS_SLIDE, delay: str = d.DELAY) -> DataFrame:
    return windows.window_counts(bids, size, slide, delay).drop("window")


def max_bid_count(bids: DataFrame, size: str = d.HOT_ITEMS_SIZE,
                  slide: str = d.HOT_ITEMS_SLIDE, delay: str = d.DELAY) -> DataFrame:
    return windows.window_max(bids, size, slide, delay)


def hot_items(bids: DataFrame, size: str = d.HOT_ITEMS_SIZE, slide: str = d.HOT_ITEMS_SLIDE,
              delay: str = d.DELAY) -> PerBatch:
    """Query 5, to be given to ``start`` or ``run_to_table``."""
    return windows.hot_items(bids, None, size, slide, delay)


def hot_items_of_two(bids_one: DataFrame, bids_two: DataFrame, size: str = d.HOT_ITEMS_SIZE,
                     slide: str = d.HOT_ITEMS_SLIDE, delay: str = d.DELAY) -> PerBatch:
    """Query 5 over two streams: counts of the first against the maxima of the second."""
    return windows.hot_items(bids_one, bids_two, size, slide, delay)


def hot_items_stream(bids_one: DataFrame, bids_two: DataFrame | None = None, size: str = d.HOT_ITEMS_SIZE,
                     slide: str = d.HOT_ITEMS_SLIDE, delay: str = d.DELAY) -> DataFrame:
    """Query 5 over one stream or two, as a stream that other operators can be joined to."""
    return windows.hot_items_stream(bids_one, bids_two, size, slide, delay)


def new_users(auctions: DataFrame, persons: DataFrame, size: str = d.NEW_USERS_SIZE,
              shares: Shares | None = None, delay: str = d.DELAY) -> DataFrame:
    """Query 8."""
    return joins.window_join(auctions, persons, size, shares, delay)


def user_sessions(bids: DataFrame, gap: str = d.SESSION_GAP, delay: str = d.DELAY) -> DataFrame:
    """Query 11."""
    return sessions.session_counts(bids, gap, delay)


def session_firings(bids: DataFrame, gap: str = d.SESSION_GAP,
                    max_events: int = d.SESSION_MAX_EVENTS, delay: str = d.DELAY) -> DataFrame:
    """Query 11 with the running count every ``max_events`` bids."""
    return sessions.session_firings(bids, gap, max_events, delay)


def session_firings_by_slots(bids: DataFrame, gap: str = d.SESSION_GAP, max_events: int = d.SESSION_MAX_EVENTS,
                             delay: str = d.DELAY, slot: str | None = None) -> DataFrame:
    """Query 11 with the running count every ``max_events`` bids in time order, a hot bidder's in all state partitions."""
    return firings.session_firings_by_slots(bids, gap, max_events, delay, slot)

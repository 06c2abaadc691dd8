"""Auction events derived from the star-schema tables (rules in FIXTURES.md).

Every rule is a select, a filter or an equi-join, so it holds for a stream too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.sources import views

# fixed values: customer state by c_nationkey % 5
STATE_BY_NATION = ("OR", "ID", "CA", "WA", "AZ")
BID_KEY_PATH = "$.k"


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100)


def bids_from_events(events: DataFrame) -> DataFrame:
    return views.bids(events, auction=F.get_json_object("props", BID_KEY_PATH),
                      bidder="user_id", price=_cents("value"))


def bids_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return views.bids(lineitem, auction="l_orderkey", bidder="l_suppkey",
                      price=_cents("l_extendedprice"), ts="l_shipdate")


def auctions_from_orders(orders: DataFrame) -> DataFrame:
    return views.auctions(orders, id="o_orderkey", seller="o_custkey",
                          category=F.lit(10) + F.col("o_orderkey") % 5,
                          reserve=_cents("o_totalprice"), ts="o_orderdate")


def persons_from_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Customers as persons; they carry no event time."""
    state = F.element_at(F.array(*map(F.lit, STATE_BY_NATION)),
                         (F.col("c_nationkey") % 5 + 1).cast("int"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return views.persons(placed, id="c_custkey", name="c_name", city="n_name", state=state,
                         ts=F.lit(None))


def auctions_from_events(events: DataFrame) -> DataFrame:
    return views.auctions(events.where(F.col("event_type") == "purchase"), id="event_id",
                          seller="user_id", category=F.lit(10) + F.col("event_id") % 5,
                          reserve=_cents("value"))


def announcements_from_events(events: DataFrame) -> DataFrame:
    """An announcement of auction k by the event's user, again with each event on it."""
    key = F.get_json_object("props", BID_KEY_PATH).cast("long")
    return views.auctions(events, id=key, seller="user_id", category=F.lit(10) + key % 5,
                          reserve=_cents("value"))


def persons_from_events(events: DataFrame, customers: DataFrame) -> DataFrame:
    """One person record for each sign-up, described by the customer of that id."""
    signups = events.where(F.col("event_type") == "signup").select("user_id", "ts")
    return views.persons(signups.join(customers.drop("ts"), F.col("user_id") == F.col("id")))

"""Small hand-made inputs with known results, over tables."""

import pandas as pd
import pytest
from conftest import auction_rows, bid_rows, millis, person_rows, rows

from gavelstream.plans import batch


def test_currency_is_32_bit_and_cut_toward_zero(table):
    prices = [100, 33_554_433, 123_456_789, -7]
    df = batch.currency_conversion(table(bid_rows(*[(1, 2, p, 0.0015) for p in prices])))
    assert [r.price_eur for r in df.collect()] == [82, 27_514_634, 101_234_568, -5]
    assert df.columns == ["auction", "price_eur", "bidder", "epoch_ms"]
    assert {r.epoch_ms for r in df.collect()} == {millis(0) + 1}


def test_currency_rate_is_a_parameter(table):
    assert batch.currency_conversion(table(bid_rows((1, 2, 10, 0))), rate=0.5).first().price_eur == 5


def test_multiples_and_list(table):
    bids = table(bid_rows(*[(a, 1, 9, 0) for a in (0, 1007, 1008, 2014, 2019)]))
    assert rows(batch.selected_bids(bids)) == [(0, 9), (1007, 9), (2014, 9), (2019, 9)]
    assert rows(batch.listed_bids(bids)) == [(1007, 9), (2019, 9)]
    assert rows(batch.selected_bids(bids, divisors=[504])) == [(0, 9), (1008, 9)]


ANN = (7, "Ann", "Salem", "OR")
NO_TIME = pd.Series([pd.NaT], dtype="datetime64[ns, UTC]")


def test_join_takes_auctions_ahead_of_their_person_but_lookup_does_not(table):
    auctions, persons = table(auction_rows((1, 7, 10, 5, 0))), table(person_rows((*ANN, 1)))
    assert rows(batch.local_items(auctions, persons)) == [("Ann", "Salem", "OR", 1)]
    assert rows(batch.local_items_latest(auctions, persons)) == []


def test_join_filters_category_and_state(table):
    auctions = table(auction_rows((1, 7, 10, 5, 0), (2, 7, 11, 5, 0), (3, 8, 10, 5, 0)))
    persons = table(person_rows((*ANN, 0), (8, "Bo", "Seattle", "WA", 0), (8, "Bo", "Salem", "or", 0)))
    assert rows(batch.local_items(auctions, persons)) == [("Ann", "Salem", "OR", 1)]
    assert rows(batch.local_items(auctions, persons, category=11)) == [("Ann", "Salem", "OR", 2)]
    assert rows(batch.local_items(auctions, persons, states=["WA"])) == [("Bo", "Seattle", "WA", 3)]


def test_join_within_bounds_the_distance(table):
    auctions = table(auction_rows((1, 7, 10, 5, 0), (2, 7, 10, 5, 30), (3, 7, 10, 5, 41)))
    persons = table(person_rows((*ANN, 20)))
    assert [r[3] for r in rows(batch.local_items(auctions, persons, within="20 seconds"))] == [1, 2]


def test_within_is_the_same_time_where_clocks_change(spark, table):
    march = 69 * 86_400  # 2024-03-10, New York's clocks go forward at 07:00 UTC
    auctions, persons = table(auction_rows((1, 7, 10, 5, march + 86_400 * 2), (2, 7, 10, 5, march + 86_400 * 2 + 1))), table(person_rows((*ANN, march)))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[3] for r in rows(batch.local_items(auctions, persons, within="2 days"))] == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_repeated_announcement_counts_once(table):
    auctions = table(auction_rows((1, 7, 10, 5, 0), (1, 7, 10, 6, 3), (2, 7, 10, 5, 0)))
    persons = table(person_rows((*ANN, 0)))
    assert len(rows(batch.local_items(auctions, persons))) == 3
    assert [r[3] for r in rows(batch.local_items_distinct(auctions, persons))] == [1, 2]


@pytest.mark.parametrize("chunk", ["1 second", "7 seconds", "1 day"])
def test_lookup_uses_the_record_of_the_moment(table, chunk):
    auctions = table(auction_rows(*[(i, 7, 10, 5, i) for i in range(0, 60, 5)]))
    persons = table(person_rows((*ANN, 10), (7, "Ann", "Boise", "ID", 25),
                                (7, "Ann", "Seattle", "WA", 40), (7, "Ann", "Napa", "CA", 50.5)))
    city = {a: "Salem" if a < 25 else "Boise" if a < 55 else "Napa" for a in range(10, 60, 5)}
    assert {r[3]: r[1] for r in rows(batch.local_items_latest(auctions, persons, chunk=chunk))} == city


def test_lookup_ignores_unknown_sellers_and_times(table):
    auctions, persons = auction_rows((1, 7, 10, 5, 0)), person_rows((*ANN, 0))
    no_time = auction_rows((2, 7, 10, 5, 0)).assign(ts=NO_TIME)
    assert rows(batch.local_items_latest(table(pd.concat([auctions, no_time])), table(persons))) == [
        ("Ann", "Salem", "OR", 1)]


def test_tied_auctions_are_all_hot(table):
    bids = table(bid_rows((1, 1, 1, 0), (2, 1, 1, 1), (1, 1, 1, 1.5), (2, 1, 1, 0), (3, 1, 1, 0)))
    hot = rows(batch.hot_items(bids, "2 seconds", "2 seconds"))
    assert hot == [(1, 2, millis(2)), (2, 2, millis(2))]
    assert rows(batch.max_bid_count(bids, "2 seconds", "2 seconds")) == [(2, millis(2))]
    assert rows(batch.hot_items_of_two(bids, bids, "2 seconds", "2 seconds")) == hot


def test_two_inputs_compare_counts_of_one_with_maxima_of_the_other(table):
    one = table(bid_rows((1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0)))
    two = table(bid_rows((5, 1, 1, 0)))
    assert rows(batch.hot_items_of_two(one, two, "2 seconds", "2 seconds")) == [
        (1, 2, millis(2)), (2, 1, millis(2))]


def test_bid_on_a_slide_edge_is_in_five_windows(table):
    counted = rows(batch.bid_counts(table(bid_rows((1, 1, 1, 4)))))
    assert counted == [(1, 1, millis(end)) for end in (6, 8, 10, 12, 14)]


@pytest.mark.parametrize("size, slide", [("10 seconds", "3 seconds"), ("5 seconds", "5 seconds"),
                                         ("7 seconds", "2 seconds"), ("90 seconds", "1 minute"),
                                         ("1 second", "250 milliseconds")])
def test_windows_follow_the_engine_s_own(spark, table, size, slide):
    from pyspark.sql import functions as F
    bids = table(bid_rows(*[(i % 3, 1, 1, i * 0.75 - 20) for i in range(80)]))
    own = (bids.groupBy(F.window("ts", size, slide), "auction").count()
           .select("auction", "count", F.unix_millis("window.end")))
    assert rows(batch.bid_counts(bids, size, slide)) == rows(own)


def test_windows_before_1970(table):
    from pyspark.sql import functions as F
    early = bid_rows((1, 1, 1, 0)).assign(ts=pd.Timestamp("1969-12-31 23:59:57.5", tz="UTC"))
    own = (table(early).groupBy(F.window("ts", "10 seconds", "2 seconds"), "auction").count()
           .select("auction", "count", F.unix_millis("window.end")))
    assert rows(batch.bid_counts(table(early))) == rows(own)
    assert rows(batch.user_sessions(table(early))) == [(1, 1, -2500, 7500, 1)]


def test_slide_longer_than_window_is_refused(table):
    with pytest.raises(ValueError):
        batch.bid_counts(table(bid_rows((1, 1, 1, 0))), "2 seconds", "10 seconds")


def test_new_users_need_the_same_window(table):
    auctions = table(auction_rows((1, 7, 10, 50, 9), (2, 7, 10, 60, 10)))
    assert rows(batch.new_users(auctions, table(person_rows((*ANN, 11))))) == [(7, "Ann", 60)]
    assert rows(batch.new_users(auctions, table(person_rows((*ANN, 21))))) == []


def test_new_users_give_every_pair(table):
    auctions = table(auction_rows((1, 7, 10, 50, 1), (2, 7, 10, 60, 2)))
    persons = table(person_rows((*ANN, 3), (7, "Anna", "Salem", "OR", 4)))
    assert rows(batch.new_users(auctions, persons)) == [
        (7, "Ann", 50), (7, "Ann", 60), (7, "Anna", 50), (7, "Anna", 60)]


def test_sessions_join_at_exactly_one_gap(table):
    touching = table(bid_rows((1, 5, 1, 0), (2, 5, 1, 10)))
    assert rows(batch.user_sessions(touching)) == [(5, 2, millis(0), millis(20), 2)]
    apart = table(bid_rows((1, 5, 1, 0), (2, 5, 1, 10.001)))
    assert rows(batch.user_sessions(apart)) == [
        (5, 1, millis(0), millis(10), 1), (5, 1, millis(10) + 1, millis(20) + 1, 2)]


def test_session_reports_highest_auction_of_its_last_instant(table):
    bids = table(bid_rows((9, 5, 1, 0), (4, 5, 1, 3), (6, 5, 1, 3), (5, 5, 1, 3)))
    assert rows(batch.user_sessions(bids)) == [(5, 4, millis(0), millis(13), 6)]


@pytest.mark.parametrize("auction", [0, -1, 5, 2**63 - 1, -2**63])
@pytest.mark.parametrize("second", [0, 0.000001, -2e9])
def test_session_keeps_any_auction_id_exact(table, auction, second):
    lower = max(auction - 1, -2**63)
    bids = table(bid_rows((auction, 5, 1, second), (lower, 5, 1, second), (2**63 - 1, 5, 1, second - 0.000001)))
    assert [r.last_auction for r in batch.user_sessions(bids).collect()] == [auction]


def test_session_of_ten_fires_at_five_and_ten(table):
    bids = table(bid_rows(*[(1, 5, 1, i) for i in range(10)]))
    assert rows(batch.session_firings(bids, max_events=5)) == [
        (5, 5, millis(4), False), (5, 10, millis(9), False), (5, 10, millis(19), True)]


def test_firings_count_anew_in_each_session(table):
    bids = table(bid_rows(*[(1, 5, 1, i) for i in range(4)], *[(1, 5, 1, 100 + i) for i in range(5)]))
    assert rows(batch.session_firings(bids, max_events=5)) == [
        (5, 4, millis(13), True), (5, 5, millis(104), False), (5, 5, millis(114), True)]


def test_many_firings_in_one_instant(table):
    bids = table(bid_rows(*[(a, 5, 1, 2) for a in range(11)]))
    assert rows(batch.session_firings(bids, max_events=3)) == [
        (5, 3, millis(2), False), (5, 6, millis(2), False), (5, 9, millis(2), False),
        (5, 11, millis(12), True)]


def test_filter_on_session_end_does_not_cut_sessions(table):
    bids = table(bid_rows((1, 5, 1, 0), (2, 5, 1, 6)))
    sessions = batch.user_sessions(bids)
    assert rows(sessions.where(f"end_ms <= {millis(10)}")) == []
    assert rows(sessions.where(f"end_ms <= {millis(16)}")) == [(5, 2, millis(0), millis(16), 2)]
    assert rows(sessions.where(f"start_ms >= {millis(1)}")) == []


def test_bids_without_time_are_in_no_window(table):
    bids = table(pd.concat([bid_rows((1, 5, 1, 0)), bid_rows((1, 5, 1, 0)).assign(ts=NO_TIME)]))
    assert {r[1] for r in rows(batch.bid_counts(bids))} == {1}
    assert rows(batch.user_sessions(bids)) == [(5, 1, millis(0), millis(10), 1)]

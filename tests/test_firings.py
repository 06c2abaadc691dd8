"""Session firings counted in slots, against the batch form, for any cut of the input."""

import random

import pytest
from conftest import at, bid_rows, millis, rows

from gavelstream import schemas
from gavelstream.plans import batch, continuous
from gavelstream.streaming.runner import run_discarding, run_to_table

END = bid_rows((-1, -1, 0, 100_000))


def fired(df, name="f"):
    return [r for r in rows(run_to_table(df, name)) if r[0] != -1]


def hot_bids(seed, number=400, span=60.0):
    """A third of the bids by bidder 1, some of them at one instant."""
    rng = random.Random(seed)
    times = sorted(round(rng.uniform(0, span), rng.choice([0, 1, 3, 6])) for _ in range(number))
    return [(i, 1 if rng.random() < 0.33 else rng.randrange(2, 12), 1, t) for i, t in enumerate(times)]


@pytest.mark.parametrize("slot", [None, "2 seconds", "1 millisecond", "700 milliseconds"])
def test_equals_batch_for_any_cut_into_files(stream, table, slot):
    bids = hot_bids(3)
    expected = rows(batch.session_firings(table(bid_rows(*bids)), "2 seconds", 3))
    assert len(expected) > 100
    cuts = [[bids], [bids[:130], bids[130:150], bids[150:]]]
    for parts in cuts if slot is None else cuts[1:]:
        frames = [bid_rows(*random.Random(1).sample(p, len(p))) for p in parts]
        assert fired(continuous.session_firings_by_slots(stream(*frames, END), "2 seconds", 3, slot=slot)) == expected


def test_bids_out_of_order_within_the_delay_count_in_time_order(stream, table):
    bids = hot_bids(5, 200)
    mixed = random.Random(2).sample(bids, len(bids))
    expected = rows(batch.session_firings(table(bid_rows(*bids)), "2 seconds", 4))
    frames = [bid_rows(*mixed[:70]), bid_rows(*mixed[70:140]), bid_rows(*mixed[140:])]
    assert fired(continuous.session_firings_by_slots(stream(*frames, END), "2 seconds", 4, delay="2 minutes")) == expected


@pytest.mark.parametrize("gap", [1.999, 2, 2.001])
def test_bids_one_gap_apart_stay_together(stream, table, gap):
    bids = bid_rows((1, 5, 1, 0.3), (1, 5, 1, 0.3 + gap), (1, 5, 1, 0.3 + 2 * gap), (1, 6, 1, 0))
    parts = [bids[:1], bids[1:2], bids[2:]]
    expected = rows(batch.session_firings(table(bids), "2 seconds", 2))
    assert len([r for r in expected if r[0] == 5]) == (4 - 2 if gap <= 2 else 3)
    assert fired(continuous.session_firings_by_slots(stream(*parts, END), "2 seconds", 2, delay="10 seconds")) == expected
    # the watermark stands in the slot that holds the end of the reach
    beside = [bids[:1], bid_rows((1, 9, 1, 0.3 + gap)), bids[1:2], bids[2:], END]
    assert [r for r in fired(continuous.session_firings_by_slots(stream(*beside), "2 seconds", 2)) if r[0] == 5] == [
        r for r in expected if r[0] == 5]


def test_late_bids_are_dropped_on_both_sides(stream):
    frames = [bid_rows((1, 5, 1, 0)), bid_rows((1, 5, 1, 100)), bid_rows((1, 5, 1, 101)), bid_rows((1, 5, 1, 3), (1, 5, 1, 101.5))]
    got = fired(continuous.session_firings_by_slots(stream(*frames, END), "10 seconds", 2))
    assert got == [(5, 1, millis(10), True), (5, 2, millis(101), False), (5, 3, millis(111.5), True)]
    progress = run_discarding(continuous.session_firings_by_slots(stream(*frames, END), "10 seconds", 2), "dropped")
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 2


def test_null_bidders_and_large_ids(spark, stream):
    big = 2**62 + 1
    frame = bid_rows(*[(1, big if i % 2 else 0, 1, i) for i in range(12)]).astype({"bidder": "Int64"})
    frame.loc[4, "bidder"] = frame.loc[6, "bidder"] = None
    given = [(1, None if i in (4, 6) else big if i % 2 else 0, 1, at(i).to_pydatetime()) for i in range(12)]
    held = batch.session_firings(spark.createDataFrame(given, schemas.BID), "10 seconds", 2).collect()
    live = run_to_table(continuous.session_firings_by_slots(stream(frame, END), "10 seconds", 2), "null").collect()
    assert sorted(map(str, held)) == sorted(str(r) for r in live if r.bidder != -1)
    assert {r.bidder for r in held} == {None, 0, big}


def test_state_is_gone_once_sessions_are_over(stream):
    progress = run_discarding(continuous.session_firings_by_slots(stream(bid_rows(*hot_bids(7)), END), "2 seconds", 3), "gone")
    # the last bid's own counts
    assert sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"]) <= 4


def test_a_hot_bidder_is_dealt_out_to_all_state_partitions(streams, stream, tmp_path):
    parts = int(streams.conf.get("spark.sql.shuffle.partitions"))
    one = bid_rows(*[(1, 1, 1, i / 1000) for i in range(20_000)])
    got = fired(continuous.session_firings_by_slots(stream(one, END), "10 seconds", 1_000))
    assert [r[1] for r in got] == [*range(1_000, 20_001, 1_000), 20_000]
    # with a long delay everything waits in the counts by millisecond and by slot
    checkpoint = str(tmp_path / "checkpoint")
    run_to_table(continuous.session_firings_by_slots(stream(one), "10 seconds", 1_000, delay="1 hour", slot="250 milliseconds"), "held",
                 checkpoint=checkpoint)
    held = {}
    for number in range(4):
        try:
            state = streams.read.format("statestore").option("path", checkpoint).option("operatorId", number).load()
        except Exception as error:  # the processors' states have no store of that name
            assert "STDS" in str(error) or "state" in str(error).lower()
            continue
        found = [r["count"] for r in state.groupBy("partition_id").count().collect()]
        held[sum(found)] = found
    for rows_held in (20_000, 80):
        assert len(held[rows_held]) == parts and max(held[rows_held]) <= rows_held / 2


@pytest.mark.parametrize("options", [{"max_events": 0}, {"gap": "1500 microseconds"}, {"gap": "1 second", "slot": "2 seconds"},
                                     {"slot": "0 seconds"}])
def test_parameters(stream, options):
    with pytest.raises(ValueError):
        continuous.session_firings_by_slots(stream(END), **options)


def test_no_bids(stream):
    assert fired(continuous.session_firings_by_slots(stream(bid_rows(), END), "10 seconds", 2)) == []

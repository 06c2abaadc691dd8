"""Stream joins that keep their own state: results against batch, and what they let go of."""

import random
import time

import pytest
from conftest import at, auction_rows, bid_rows, millis, person_rows, rows
from pyspark.sql import functions as F

from gavelstream.operators.joins import Shares
from gavelstream.plans import batch, continuous
from gavelstream.streaming.runner import run_discarding, run_to_table

ANN = (7, "Ann", "Salem", "OR")
FAR = 100_000  # rows at this second let the watermark pass everything before it
END = auction_rows((-1, -1, 10, 0, FAR)), person_rows((-2, "End", "Salem", "OR", FAR))


def held(progress):
    return sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"])


def disordered(rng, listed, split, reach):
    """Rows (time last) in files, none of them more than ``reach`` behind what came before."""
    order = sorted(listed, key=lambda row: row[-1] + rng.uniform(0, reach))
    cuts = sorted(rng.sample(range(len(order) + 1), split - 1))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True) if b > a]


@pytest.mark.parametrize("seed, split", [(1, 1), (2, 3), (3, 5)])
def test_as_of_is_the_batch_lookup_for_any_files(stream, table, seed, split):
    rng = random.Random(7)
    listed = [(2**62 + i, rng.choice([7, 7, 8, 9]), 10, 5, rng.randrange(400) / 4) for i in range(80)]
    known = [(rng.choice([7, 8]), f"n{i % 5}", "Napa", rng.choice(["OR", "CA"]), rng.randrange(400) / 4) for i in range(25)]
    expected = rows(batch.local_items_latest(table(auction_rows(*listed)), table(person_rows(*known))))
    assert len(expected) > 30
    files = random.Random(seed)
    auctions = [auction_rows(*f) for f in disordered(files, listed, split, 20)]
    persons = [person_rows(*f) for f in disordered(files, known, split, 20)]
    df = continuous.local_items_as_of(stream(*auctions, END[0]), stream(*persons, END[1]), delay="1 minute", chunk="10 seconds",
                                      shares=None if seed == 1 else Shares(3, hot=[7]))
    assert [r for r in rows(run_to_table(df, "as-of")) if r[3] != -1] == expected


def test_record_in_a_later_file_still_counts_and_late_ones_do_not(stream):
    auctions = stream(auction_rows((1, 7, 10, 5, 10)), auction_rows((2, 7, 10, 5, 100)), auction_rows((3, 8, 10, 5, 101)), END[0])
    persons = stream(person_rows((8, "Bo", "Napa", "CA", 20)), person_rows((*ANN, 5)), person_rows((7, "Ann", "Napa", "CA", 103)),
                     person_rows((7, "Ann", "Reno", "CA", 1), (8, "Bo", "Boise", "ID", 102)), END[1])
    got = rows(run_to_table(continuous.local_items_as_of(auctions, persons, delay="30 seconds"), "later"))
    assert {(r[1], r[3]) for r in got if r[3] > 0} == {("Napa", 3), ("Salem", 1), ("Salem", 2)}


def test_what_the_watermark_passed_leaves_the_state(stream):
    auctions = [auction_rows(*[(10 * i + j, 7, 10, 5, i * 100 + j) for j in range(10)]) for i in range(4)]
    persons = [person_rows(*[(*ANN[:2], f"c{i}{j}", "OR", i * 100 + j) for j in range(10)]) for i in range(4)]
    progress = run_discarding(continuous.local_items_as_of(stream(*auctions, END[0]), stream(*persons, END[1])), "state")
    # Ann's last record, and the rows at the end that the watermark has not passed
    assert held(progress) <= 2 + 2 * 4
    got = rows(run_to_table(continuous.local_items_as_of(stream(*auctions, END[0]), stream(*persons, END[1])), "rows"))
    assert [(r[1], r[3]) for r in got if r[3] >= 0] == sorted((f"c{i}{j}", 10 * i + j) for i in range(4) for j in range(10))


def test_pending_auctions_leave_with_the_first_record(stream):
    auctions = stream(auction_rows(*[(i, 7, 10, 5, i % 3) for i in range(20)]), auction_rows((3, 7, 10, 5, 3), (20, 7, 10, 5, 3)),
                      auction_rows((21, 7, 10, 5, 4)))
    persons = stream(person_rows((9, "Al", "Napa", "CA", 0)), person_rows((9, "Al", "Napa", "CA", 3)), person_rows((*ANN, 4)))
    df = continuous.local_items_pending(auctions, persons, wait="1 hour")
    assert [r[3] for r in rows(run_to_table(df, "pending"))] == list(range(22))
    progress = [p for p in run_discarding(continuous.local_items_pending(auctions, persons, wait="1 hour"), "held") if p["numInputRows"]]
    sizes = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]
    assert sizes[1] > 20 and sizes[2] < 10


def test_pending_auctions_are_dropped_by_the_timer(stream):
    auctions = stream(auction_rows((1, 7, 10, 5, 0), (2, 8, 10, 5, 0)), auction_rows((3, 9, 10, 5, 50)), auction_rows((4, 9, 10, 5, 51)),
                      auction_rows((5, 9, 10, 5, 52)))
    persons = stream(person_rows((8, "Bo", "Napa", "CA", 1)), person_rows((6, "Cy", "Napa", "CA", 50)), person_rows((6, "Cy", "Napa", "CA", 51)),
                     person_rows((*ANN, 52)))
    got = rows(run_to_table(continuous.local_items_pending(auctions, persons, wait="10 seconds"), "dropped"))
    assert [r[3] for r in got] == [2]
    got = rows(run_to_table(continuous.local_items_pending(auctions, persons, wait="1 hour"), "kept"))
    assert [r[3] for r in got] == [1, 2]


@pytest.mark.parametrize("keep, ids", [("1 day", [1, 2, 3]), ("1 second", [2])])
def test_expiring_state_is_gone_after_its_time(stream, monkeypatch, keep, ids):
    from gavelstream.streaming import keyed
    auctions = stream(auction_rows((1, 7, 10, 5, 0)), auction_rows((2, 7, 10, 5, 0), (3, 9, 10, 5, 0)), auction_rows((4, 5, 10, 5, 0)))
    persons = stream(person_rows((8, "Bo", "Napa", "CA", 0)), person_rows((*ANN, 0)), person_rows((9, "Al", "Napa", "CA", 0)))
    if keep == "1 second":
        real = keyed._split

        def slow(frames):
            time.sleep(1.5)
            return real(frames)
        monkeypatch.setattr(keyed, "_split", slow)
    df = continuous.local_items_expiring(auctions, persons, keep=keep)
    assert sorted(r[3] for r in rows(run_to_table(df, "forget", empty_batches=False))) == ids


def test_hot_items_stream_can_be_joined_on(stream, table):
    rng = random.Random(3)
    parts = [bid_rows(*[(rng.randrange(5), 1, 1, s + rng.randrange(160) / 4) for _ in range(60)]) for s in (0, 40, 80)]
    end = bid_rows((-1, -1, 0, FAR))
    everything = table(parts[0]).union(table(parts[1])).union(table(parts[2]))
    hot = continuous.hot_items_stream(stream(*parts, end), delay="1 minute")
    assert hot.isStreaming
    expected = rows(batch.hot_items(everything))
    assert [r[:3] for r in rows(run_to_table(hot, "hot").select("auction", "num", "window_end_ms")) if r[0] != -1] == expected
    # another stream on the window, and a count of ties after it
    totals = (stream(*parts, end).withWatermark("ts", "1 minute").groupBy(F.window("ts", "10 seconds", "2 seconds").alias("w"))
              .agg(F.count("*").alias("bids")))
    again = continuous.hot_items_stream(stream(*parts, end), delay="1 minute")
    joined = run_to_table(again.join(totals, F.col("window") == F.col("w")).select("auction", "num", "window_end_ms", "bids"), "on")
    plain = dict((r[1], r[0]) for r in rows(batch.bid_counts(everything).groupBy("window_end_ms").agg(F.sum("num").alias("n")).select("n", "window_end_ms")))
    assert [r for r in rows(joined) if r[0] != -1] == [(*r, plain[r[2]]) for r in expected]


def test_hot_items_stream_of_two_inputs(stream, table):
    one, two = bid_rows((1, 1, 1, 1), (2, 1, 1, 1), (2, 1, 1, 2)), bid_rows((9, 1, 1, 1))
    end = bid_rows((-1, -1, 0, FAR))
    got = rows(run_to_table(continuous.hot_items_stream(stream(one, end), stream(two, end)).drop("window"), "two"))
    assert [r for r in got if r[0] != -1] == rows(batch.hot_items_of_two(table(one), table(two)))
    assert millis(0) == at(0).value // 1_000_000

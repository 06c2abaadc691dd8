"""Aggregates written by the user, against built-in ones."""

import random

import pytest
from conftest import at, bid_rows, rows
from pyspark.sql import functions as F

from gavelstream import schemas
from gavelstream.operators import user_aggregates as u
from gavelstream.plans import batch


def spread():
    """Defined here, so that it travels by value."""
    class Spread(u.Aggregate):
        """Prices as a sorted list: a state that is changed in place."""

        def create(self):
            return []

        def add(self, state, row):
            state.append(row[0])
            return state

        def merge(self, state, other):
            state.extend(other)
            return state

        def result(self, state):
            return len(state), max(state) - min(state)
    return Spread()


@pytest.fixture(scope="module")
def bids(spark):
    rng = random.Random(4)
    given = [(rng.choice([None, *range(20)]), 1 if rng.random() < 0.35 else rng.choice([None, *range(9)]), rng.randrange(999),
              at(rng.randrange(2400) / 4).to_pydatetime()) for _ in range(3000)]
    return spark.createDataFrame(given, schemas.BID).repartition(6)


@pytest.mark.parametrize("held", [20_000, 3])
def test_keys(bids, monkeypatch, held):
    monkeypatch.setattr(u, "HELD_STATES", held)
    got = u.by_key(bids, ["bidder"], ["price"], spread(), "num long, spread long")
    plain = bids.groupBy("bidder").agg(F.count("*"), F.max("price") - F.min("price"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert got.schema.simpleString() == "struct<bidder:bigint,num:bigint,spread:bigint>"


@pytest.mark.parametrize("size, slide", [(10, 2), (7, 3), (5, 5), (60, 1)])
def test_windows(bids, size, slide):
    got = u.by_window(bids, ["bidder", "auction"], ["price"], spread(), "num long, spread long", f"{size} seconds", f"{slide} seconds")
    plain = (bids.groupBy("bidder", "auction", F.window("ts", f"{size} seconds", f"{slide} seconds").alias("w"))
             .agg(F.count("*").alias("n"), (F.max("price") - F.min("price")).alias("s"))
             .select("bidder", "auction", F.unix_millis("w.end"), "n", "s"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_sessions_are_those_of_the_built_in_count(bids):
    for gap in ("1 second", "10 seconds", "250 milliseconds"):
        got = batch.user_sessions_by_aggregate(bids, gap)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, batch.user_sessions(bids, gap).collect()), key=repr)


def test_a_hot_key_s_rows_stay_where_they_are(spark, bids):
    """Half a million rows of one key: no more states are shuffled than there are slices and tasks."""
    hot = spark.range(0, 500_000, 1, 5).select(F.lit(1).cast("long").alias("auction"), F.lit(1).cast("long").alias("bidder"), F.col("id").alias("price"),
                                               F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 100).alias("ts"))
    got = batch.user_sessions_by_aggregate(hot, "10 seconds")
    assert [r[1] for r in rows(got)] == [500_000]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    found = []

    def walk(node):
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = {"AdaptiveSparkPlan": "executedPlan"}.get(node.nodeName(), "plan" if node.nodeName().endswith("QueryStage") else None)
        if inner:
            walk(getattr(node, inner)())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(got._jdf.queryExecution().executedPlan())
    assert found and found[0] <= 5 * 6


def test_empty_and_without_keys(spark, bids):
    none = bids.limit(0)
    assert u.by_key(none, ["bidder"], ["price"], spread(), "num long, spread long").count() == 0
    assert u.by_window(none, [], ["price"], spread(), "num long, spread long", "4 seconds", "2 seconds").count() == 0
    assert [tuple(r) for r in u.by_key(bids, [], ["price"], spread(), "num long, spread long").collect()] == [
        (3000, bids.agg(F.max("price") - F.min("price")).first()[0])]
    with pytest.raises(ValueError):
        u.by_window(bids, [], [], spread(), "num long", "2 seconds", "4 seconds")
    assert bid_rows().empty

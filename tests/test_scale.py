"""Plans keep their shape where one key holds a third of the rows."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gavelstream import schemas
from gavelstream.operators.joins import hot_keys
from gavelstream.plans import batch
from gavelstream.sources import views

ROWS = 30_000


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of the bids and auctions belong to user 1, over ten minutes."""
    base = spark.range(0, ROWS, 1, 6).withColumn(
        "user", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 700)).withColumn(
        "ts", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 20_000))
    bids = views.bids(base, auction=F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") % 90),
                      bidder="user", price="id")
    auctions = views.auctions(base, seller="user", category=F.lit(10) + F.col("id") % 3 % 2, reserve="id")
    persons = views.persons(base.where("id % 7 = 0"), id="user", name=F.concat(F.lit("n"), "id"),
                            city=F.lit("Salem"), state=F.element_at(
                                F.array(F.lit("OR"), F.lit("WA"), F.lit("CA")), (F.col("id") % 3 + 1).cast("int")))
    folder = tmp_path_factory.mktemp("skewed")
    for name, df in (("bids", bids), ("auctions", auctions), ("persons", persons),
                     ("people", persons.dropDuplicates(["id"]))):
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("bids", "auctions", "persons", "people")}


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def largest_group(df, *keys):
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_third_of_the_rows_is_one_key(skewed):
    assert largest_group(skewed["bids"], "bidder") > ROWS / 3
    assert largest_group(skewed["bids"], "auction") > ROWS / 3


def test_hot_keys_are_found(skewed):
    assert hot_keys(skewed["bids"], "bidder", 0.3) == [1]
    assert hot_keys(skewed["bids"], "auction", 0.3) == [5]
    assert hot_keys(skewed["bids"].limit(0), "auction") == []


def test_counts_combine_before_the_shuffle_and_copy_after_it(skewed):
    plan = final_plan(batch.bid_counts(skewed["bids"]))
    assert plan.count("Exchange hashpartitioning") == 2
    into_windows, rest = plan.split("Exchange hashpartitioning(auction", 1)
    assert "explode(sequence(begin" in into_windows and "REPARTITION_BY_COL" in rest
    assert "partial_count" in rest.split("Exchange hashpartitioning(auction", 1)[1]


def rows_of_exchanges(df):
    """Rows that each shuffle or broadcast of the final plan wrote, by what it deals by."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if "Exchange" in name and "Reused" not in name:
            metrics = node.metrics()
            for key in ("shuffleRecordsWritten", "numOutputRows"):
                if metrics.contains(key):
                    found.append((node.simpleString(200), metrics.apply(key).value()))
                    break
        inner = {"AdaptiveSparkPlan": "executedPlan", "ReusedExchange": None}.get(name, "plan" if name.endswith("QueryStage") else "")
        if inner is None:
            return
        if inner:
            return walk(getattr(node, inner)())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_hot_items_neither_shuffle_nor_broadcast_window_copies(spark, skewed, threshold):
    size, slide = "60 seconds", "1 second"
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        counts = batch.bid_counts(skewed["bids"], size, slide)
        copies, windows = counts.count(), counts.select("window_end_ms").distinct().count()
        found = rows_of_exchanges(batch.hot_items(skewed["bids"], size, slide))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found and copies > 10 * shares * windows
    panes = skewed["bids"].select("auction", F.date_trunc("second", "ts")).distinct().count()
    assert all(n <= max(3 * panes, 4 * shares * windows) for _, n in found), found
    assert not any("Broadcast" in what for what, _ in found)


def rows_added_up(df):
    """Rows that the plan's sums, maxima and window functions take in."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0

    def walk(node):
        nonlocal total
        name, children = node.nodeName(), node.children()
        if name in ("HashAggregate", "Sort", "Generate") and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        inner = {"AdaptiveSparkPlan": "executedPlan", "ReusedExchange": None}.get(name, "plan" if name.endswith("QueryStage") else "")
        if inner:
            walk(getattr(node, inner)())
        elif inner is not None:
            for i in range(children.size()):
                walk(children.apply(i))

    walk(plan)
    return total


def test_work_does_not_grow_with_the_windows_over_a_bid(skewed):
    """Sixteen times the windows over each bid: what is added up grows with the places of the stretches alone."""
    # a bid of each auction now and then, so that nothing is merged into one run
    sparse = skewed["bids"].where("price % 97 = 0")
    found = {size: rows_added_up(batch.max_bid_count(sparse, size, "1 second")) for size in ("15 seconds", "240 seconds")}
    copies = {size: batch.bid_counts(sparse, size, "1 second").agg(F.sum("num")).first()[0] for size in found}
    assert copies["240 seconds"] == 16 * copies["15 seconds"]
    assert found["240 seconds"] < 3 * found["15 seconds"] and found["240 seconds"] < copies["240 seconds"]


def test_hot_items_with_many_ties(skewed):
    """Every auction has its window's maximum: all are the result, none is shuffled after copying."""
    once = skewed["bids"].select("bidder", "price", "ts", F.monotonically_increasing_id().alias("auction"))
    assert batch.hot_items(once, "4 seconds", "2 seconds").count() == 2 * once.count()


def test_sessions_shuffle_panes_not_bids(skewed):
    plan = final_plan(batch.user_sessions(skewed["bids"]).drop("last_auction"))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_count" in plan and "SortAggregate" not in plan


def test_sessions_of_a_hot_bidder(skewed):
    from pyspark.sql import Window
    gap = 150_000  # microseconds; user 1 bids every 60 ms, most others every 14 s
    by_time = Window.partitionBy("bidder").orderBy("us")
    plain = (skewed["bids"].select("bidder", F.unix_micros("ts").alias("us"))
             .withColumn("opens", (F.col("us") - F.lag("us", 1, -gap * 10).over(by_time) > gap).cast("int"))
             .withColumn("session", F.sum("opens").over(by_time))
             .withColumn("place", F.row_number().over(Window.partitionBy("bidder", "session").orderBy("us"))))
    partials = plain.where("place % 500 = 0").select("bidder", F.col("place").cast("long"), F.expr("us div 1000"), F.lit(False))
    finals = plain.groupBy("bidder", "session").agg(F.count("*").alias("n"), F.max("us").alias("us")).select(
        "bidder", "n", F.expr(f"(us + {gap}) div 1000"), F.lit(True))
    assert rows(batch.session_firings(skewed["bids"], "150 milliseconds", 500)) == rows(partials.union(finals))
    assert partials.count() == 20


def test_firings_count_by_millisecond_only_in_panes_with_a_count_due(skewed):
    df = batch.session_firings(skewed["bids"], "150 milliseconds", 500)
    by_ms = [n for what, n in rows_of_exchanges(df) if "ms#" in what.split("ENSURE")[0]]
    assert by_ms and max(by_ms) < ROWS / 50


def test_within_only_meets_records_near_in_time(spark, skewed):
    """Pairs that the join compares stay near the pairs that come out, with a hot seller on both sides."""
    df = batch.local_items(skewed["auctions"], skewed["persons"], within="10 seconds", states=["OR", "CA", "WA"])
    pairs = df.count()
    bucket = F.floor(F.unix_micros("ts") / 10_000_000)
    left = skewed["auctions"].where("category = 10").groupBy("seller", bucket.alias("b")).agg(F.count("*").alias("n"))
    right = (skewed["persons"].withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
             .groupBy("id", "b").agg(F.count("*").alias("m")))
    compared = left.join(right, (left.seller == right.id) & (left.b == right.b)).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert pairs <= compared <= 2 * pairs
    assert "bucket" in final_plan(df)


def test_lookup_of_a_hot_seller_equals_the_plain_scan(skewed):
    from pyspark.sql import Window
    a = skewed["auctions"].where("category = 10").select(F.col("seller").alias("id"), "ts", F.lit(1).alias("turn"),
                                                         F.col("id").alias("auction_id"), F.lit(None).alias("p"))
    p = skewed["persons"].where("state in ('OR', 'CA')").select(
        "id", "ts", F.lit(0), F.lit(None), F.struct("name", "city", "state"))
    scan = Window.partitionBy("id").orderBy("ts", "turn").rowsBetween(Window.unboundedPreceding, 0)
    plain = (a.union(p).withColumn("p", F.last("p", True).over(scan)).where("turn = 1 and p is not null")
             .select("p.name", "p.city", "p.state", "auction_id"))
    chunked = batch.local_items_latest(skewed["auctions"], skewed["persons"], chunk="20 seconds")
    assert rows(chunked) == rows(plain) and plain.count() > ROWS / 10
    plan = final_plan(chunked)
    assert not re.search(r"Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("name, inputs", [
    ("local_items", ("auctions", "people")), ("local_items_distinct", ("auctions", "people")),
    ("new_users", ("auctions", "people")), ("hot_items", ("bids",)), ("session_firings", ("bids",))])
def test_no_cross_joins_and_no_gather(skewed, name, inputs):
    plan = final_plan(getattr(batch, name)(*[skewed[i] for i in inputs]))
    assert not re.search(r"Cartesian|NestedLoop|SinglePartition|BatchEvalPython|MapInPandas", plan)


def test_filters_and_columns_reach_the_scan(skewed):
    plan = final_plan(batch.listed_bids(skewed["bids"]))
    assert "PushedFilters: [In(auction" in plan and "ReadSchema: struct<auction:bigint,price:bigint>" in plan
    plan = final_plan(batch.local_items(skewed["auctions"], skewed["people"]))
    assert "EqualTo(category,10)" in plan and "In(state, [CA,ID,OR])" in plan
    assert "ReadSchema: struct<id:bigint,seller:bigint,category:bigint>" in plan
    plan = final_plan(batch.bid_counts(skewed["bids"]))
    assert "ReadSchema: struct<auction:bigint,ts:timestamp>" in plan
    plan = final_plan(batch.user_sessions(skewed["bids"]).select("bidder", "num"))
    assert "ReadSchema: struct<bidder:bigint,ts:timestamp>" in plan


@pytest.mark.parametrize("name, options", [("local_items", {}), ("new_users", {"size": "1 day"})])
def test_hot_seller_is_split_by_the_join(spark, name, options, skewed):
    """With thresholds brought down to this data, AQE splits the hot seller's partition."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB"}
    before = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        plan = final_plan(getattr(batch, name)(skewed["auctions"], skewed["people"], **options))
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_schemas_have_only_the_fields_in_use(skewed):
    assert skewed["bids"].dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.BID]
    assert skewed["auctions"].columns == schemas.AUCTION.names
    with pytest.raises(ValueError):
        views.bids(skewed["bids"], colour="price")

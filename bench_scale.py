"""Times queries over many bids made by Spark from the ``events`` table, and prints one JSON line.

``python bench_scale.py [bids] [query ...]``: by default 20 000 000 bids, 100 000 a second of event time, a
third of them by one bidder. Batch queries write to a discarding sink with 16 shuffle partitions; streams
take four files of bids one micro-batch each, with 8 state partitions.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from gavelstream.plans import batch, continuous
from gavelstream.session import build_session, streaming_session
from gavelstream.sources import read_stream
from gavelstream.streaming.runner import run_discarding

PER_SECOND, FILES = 100_000, 4
BATCH = {"currency_conversion": {}, "bid_counts": {}, "max_bid_count": {}, "hot_items": {}, "user_sessions": {}, "session_firings": {}}
STREAMS = tuple(BATCH)


def make_bids(spark, sf_dir: str, number: int, path: str) -> None:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.count()
    auction = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    ids = spark.range(0, number, 1, 64).withColumn("event_id", F.col("id") % rows)
    numbered = events.withColumn("event_id", F.col("event_id") % rows).dropDuplicates(["event_id"])
    bids = ids.join(F.broadcast(numbered), "event_id").select(
        auction.alias("auction"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("user_id")).cast("long").alias("bidder"),
        F.round(F.col("value") * 100).cast("long").alias("price"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * (1_000_000 // PER_SECOND)).alias("ts"), "id")
    for part in range(FILES):
        low, high = number * part // FILES, number * (part + 1) // FILES
        bids.where(f"id >= {low} AND id < {high}").drop("id").coalesce(1).write.mode("append").parquet(path)


def main() -> None:
    number = int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000
    chosen = sys.argv[2:] or [*BATCH, *(f"stream_{n}" for n in STREAMS)]
    folder = os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-scale-")
    spark = build_session("bench-scale", f"local[{os.environ.get('BENCH_CPUS', '8')}]", {
        "spark.sql.shuffle.partitions": "16", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.checkpoint.dir": f"{folder}/scratch", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    make_bids(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), number, f"{folder}/bids")
    live = streaming_session(spark)
    live.conf.set("spark.sql.shuffle.partitions", "8")
    took = {}
    for name in chosen:
        started = time.perf_counter()
        if name.startswith("stream_"):
            bids = read_stream(live, f"{folder}/bids", max_files_per_trigger=1)
            run_discarding(getattr(continuous, name.removeprefix("stream_"))(bids), name)
        else:
            bids = spark.read.parquet(f"{folder}/bids")
            getattr(batch, name)(bids).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 1)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "seconds by query", "bids": number, "queries": took}))


if __name__ == "__main__":
    main()

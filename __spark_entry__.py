"""Registered queries and, for each, the SQL that must give the same rows.

Event times in the tables are far apart, so one second of a query's default window
becomes one hour here, and sessions report every 5 bids (see FIXTURES.md).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gavelstream.plans import batch, continuous
from gavelstream.session import streaming_session
from gavelstream.sources import read_stream, read_table, warehouse
from gavelstream.streaming.runner import run_to_table

try:
    import corpus_pipeline
    from gavelstream.llm import queries as llm
except ImportError as missing:
    # the training-data operators are optional as a whole: absent, or without a library that they need
    if missing.name not in ("corpus_pipeline", "gavelstream.llm"):
        warnings.warn(f"the training-data operators are left out: {missing}", stacklevel=2)
    llm = None

Query = Callable[[SparkSession, str], DataFrame]
Reader = Callable[[str], DataFrame]

SIZE, SLIDE, GAP, MAX_EVENTS = "10 hours", "2 hours", "10 hours", 5
SLOT = "75 minutes"
CHUNK, WITHIN = "1 day", "2 days"
# streams whose state goes by the clock
_BY_THE_CLOCK = {"stream_q3_local_items_expiring"}


def entry(spark: SparkSession) -> DataFrame:
    """Hot items over the smallest tables."""
    return queries()["q5_hot_items"](spark, "/root/testdata/sf0.001")


def _event_bids(table: Reader) -> DataFrame:
    return warehouse.bids_from_events(table("events"))


def _line_bids(table: Reader) -> DataFrame:
    return warehouse.bids_from_lineitem(table("lineitem"))


def _order_auctions(table: Reader) -> DataFrame:
    return warehouse.auctions_from_orders(table("orders"))


def _announcements(table: Reader) -> DataFrame:
    return warehouse.announcements_from_events(table("events"))


def _event_auctions(table: Reader) -> DataFrame:
    return warehouse.auctions_from_events(table("events"))


def _batch(build: Callable[[Reader], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(lambda name: read_table(spark, f"{sf_dir}/{name}.parquet"))
    return run


def _stream(name: str, build: Callable[[Reader, Reader], DataFrame]) -> Query:
    """``build`` gets a reader of streams and one of tables; the sink is read back."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = streaming_session(spark)
        return run_to_table(build(lambda t: read_stream(session, f"{sf_dir}/{t}.parquet"),
                                  lambda t: read_table(session, f"{sf_dir}/{t}.parquet")), name,
                            empty_batches=name not in _BY_THE_CLOCK)
    return run


def _customers(table: Reader, nations: Reader | None = None) -> DataFrame:
    return warehouse.persons_from_customers(table("customer"), (nations or table)("nation"))


def _signups(table: Reader, static: Reader | None = None) -> DataFrame:
    return warehouse.persons_from_events(table("events"), _customers(static or table))


def queries() -> dict[str, Query]:
    single = {
        "q1_currency": lambda t: batch.currency_conversion(_line_bids(t)),
        "q2_filter_mod": lambda t: batch.selected_bids(_line_bids(t)),
        "q2_filter_in": lambda t: batch.listed_bids(_line_bids(t)),
        "q3_local_items": lambda t: batch.local_items(_order_auctions(t), _customers(t)),
        "q3_local_items_dedup": lambda t: batch.local_items_distinct(_announcements(t), _customers(t)),
        "q3_local_items_dedup_within": lambda t: batch.local_items_distinct(_announcements(t), _signups(t), within=WITHIN),
        "q3_local_items_within": lambda t: batch.local_items(_event_auctions(t), _signups(t), within=WITHIN),
        "q3_lookup_latest": lambda t: batch.local_items_latest(_event_auctions(t), _signups(t), chunk=CHUNK),
        "q5_window_counts": lambda t: batch.bid_counts(_event_bids(t), SIZE, SLIDE),
        "q5_window_max": lambda t: batch.max_bid_count(_event_bids(t), SIZE, SLIDE),
        "q5_hot_items": lambda t: batch.hot_items(_event_bids(t), SIZE, SLIDE),
        "q5_hot_items_join": lambda t: batch.hot_items_of_two(_event_bids(t), _event_bids(t), SIZE, SLIDE),
        "q5_hot_items_last_hour": lambda t: batch.hot_items(_event_bids(t), "60 minutes", "1 minute"),
        "q8_new_users": lambda t: batch.new_users(_event_auctions(t), _signups(t), SIZE),
        "q8_new_users_half_day": lambda t: batch.new_users(_event_auctions(t), _signups(t), "12 hours"),
        "q11_sessions": lambda t: batch.user_sessions(_event_bids(t), GAP),
        "q11_sessions_by_aggregate": lambda t: batch.user_sessions_by_aggregate(_event_bids(t), GAP),
        "q11_session_firings": lambda t: batch.session_firings(_event_bids(t), GAP, MAX_EVENTS),
    }
    streamed = {
        "stream_q1_currency": lambda s, t: continuous.currency_conversion(_line_bids(s)),
        "stream_q2_filter_mod": lambda s, t: continuous.selected_bids(_line_bids(s)),
        "stream_q2_filter_in": lambda s, t: continuous.listed_bids(_line_bids(s)),
        "stream_q3_local_items": lambda s, t: continuous.local_items(_order_auctions(s), _customers(s, t)),
        "stream_q3_local_items_dedup": lambda s, t: continuous.local_items_distinct(
            _announcements(s), _customers(s, t)),
        "stream_q3_local_items_within": lambda s, t: continuous.local_items(
            _event_auctions(s), _signups(s, t), within=WITHIN),
        "stream_q3_lookup_latest": lambda s, t: continuous.local_items_latest(_event_auctions(s), _signups(s, t)),
        "stream_q3_lookup_as_of": lambda s, t: continuous.local_items_as_of(
            _event_auctions(s), _signups(s, t), chunk=CHUNK),
        "stream_q3_pending": lambda s, t: continuous.local_items_pending(_announcements(s), _signups(s, t), wait=WITHIN),
        "stream_q3_local_items_expiring": lambda s, t: continuous.local_items_expiring(
            _order_auctions(s), _customers(s, t), keep="1 day"),
        "stream_q5_window_counts": lambda s, t: continuous.bid_counts(_event_bids(s), SIZE, SLIDE),
        "stream_q5_window_max": lambda s, t: continuous.max_bid_count(_event_bids(s), SIZE, SLIDE),
        "stream_q5_hot_items": lambda s, t: continuous.hot_items(_event_bids(s), SIZE, SLIDE),
        "stream_q5_hot_items_join": lambda s, t: continuous.hot_items_of_two(_event_bids(s), _event_bids(s), SIZE, SLIDE),
        "stream_q5_hot_items_stream": lambda s, t: continuous.hot_items_stream(
            _event_bids(s), size=SIZE, slide=SLIDE).drop("window"),
        "stream_q8_new_users_half_day": lambda s, t: continuous.new_users(_event_auctions(s), _signups(s, t), "12 hours"),
        "stream_q3_local_items_dedup_within": lambda s, t: continuous.local_items_distinct(
            _announcements(s), _signups(s, t), within=WITHIN),
        "stream_q8_new_users": lambda s, t: continuous.new_users(_event_auctions(s), _signups(s, t), SIZE),
        "stream_q11_sessions": lambda s, t: continuous.user_sessions(_event_bids(s), GAP),
        "stream_q11_session_firings": lambda s, t: continuous.session_firings(_event_bids(s), GAP, MAX_EVENTS),
        "stream_q11_session_firings_by_slots": lambda s, t: continuous.session_firings_by_slots(
            _event_bids(s), GAP, MAX_EVENTS, slot=SLOT),
    }
    found = {**{name: _batch(build) for name, build in single.items()},
             **{name: _stream(name, build) for name, build in streamed.items()}}
    return found if llm is None else {**found, **llm.queries(), "pipeline": corpus_pipeline.run}


_BID_E = """
bid AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS auction, user_id AS bidder,
         CAST(round(value * 100) AS BIGINT) AS price, ts
  FROM events)"""

_BID_L = """
bid AS (
  SELECT l_orderkey AS auction, l_suppkey AS bidder,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS ts
  FROM lineitem)"""

_AUCTION_O = """
auction AS (
  SELECT o_orderkey AS id, o_custkey AS seller, 10 + o_orderkey % 5 AS category,
         CAST(round(o_totalprice * 100) AS BIGINT) AS reserve, o_orderdate AS ts
  FROM orders)"""

_AUCTION_E = """
auction AS (
  SELECT event_id AS id, user_id AS seller, 10 + event_id % 5 AS category,
         CAST(round(value * 100) AS BIGINT) AS reserve, ts
  FROM events WHERE event_type = 'purchase')"""

_CUSTOMER = """
placed AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS city,
         CASE c_nationkey % 5 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA'
                              WHEN 3 THEN 'WA' ELSE 'AZ' END AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

_PERSON_E = _CUSTOMER + """,
person AS (
  SELECT id, name, city, state, ts
  FROM events JOIN placed ON user_id = id WHERE event_type = 'signup')"""



def _counts(size: str, slide: str, steps: int) -> str:
    return _BID_E + f""",
counts AS (
  SELECT auction, count(*) AS num, epoch_us(start + INTERVAL {size}) // 1000 AS window_end_ms
  FROM (SELECT auction, time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01') - INTERVAL {slide} * back AS start
        FROM bid, range({steps}) AS step(back))
  GROUP BY auction, start)"""


_COUNTS = _counts("10 HOUR", "2 HOUR", 5)

# a stream's watermark: the newest event time cut to milliseconds (epoch_ms would round)
_WATERMARK_MS = "(SELECT epoch_us(max(ts)) // 1000 FROM bid)"
_COUNTS_CLOSED = _COUNTS + f""",
closed AS (SELECT * FROM counts WHERE window_end_ms <= {_WATERMARK_MS})"""

_SESSION_BIDS = _BID_E + """,
marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY bidder ORDER BY ts) <= INTERVAL 10 HOUR
                 THEN 0 ELSE 1 END AS opens
  FROM bid),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY bidder ORDER BY ts) AS session FROM marked),
sessions AS (
  SELECT bidder, session, count(*) AS num, epoch_us(min(ts)) // 1000 AS start_ms,
         epoch_us(max(ts) + INTERVAL 10 HOUR) // 1000 AS end_ms,
         epoch_us(max(ts) + INTERVAL 10 HOUR) AS end_us, max_by(auction, ts) AS last_auction
  FROM numbered GROUP BY bidder, session),
partials AS (
  SELECT bidder, CAST(place AS BIGINT) AS num, epoch_us(ts) // 1000 AS end_ms_or_fire_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY bidder, session ORDER BY ts, auction, price) AS place
        FROM numbered)
  WHERE place % 5 = 0)"""

_CLOSED_SESSION = f"WHERE end_us <= {_WATERMARK_MS} * 1000"

_Q1 = f"""WITH {_BID_L}
SELECT auction, CAST(trunc(CAST(0.82 AS FLOAT) * CAST(price AS FLOAT)) AS BIGINT) AS price_eur,
       bidder, epoch_us(ts) // 1000 AS epoch_ms FROM bid"""

_Q2_MOD = f"""WITH {_BID_L}
SELECT auction, price FROM bid
WHERE auction % 1007 = 0 OR auction % 1020 = 0 OR auction % 2001 = 0
   OR auction % 2019 = 0 OR auction % 2087 = 0"""

_Q2_IN = f"""WITH {_BID_L}
SELECT auction, price FROM bid WHERE auction IN (1007, 1020, 2001, 2019, 2087)"""

_Q3 = f"""WITH {_AUCTION_O}, {_CUSTOMER}
SELECT name, city, state, a.id AS auction_id FROM auction a JOIN placed p ON a.seller = p.id
WHERE category = 10 AND state IN ('OR', 'ID', 'CA')"""

_Q3_DEDUP = f"""WITH {_BID_E}, {_CUSTOMER}
SELECT name, city, state, a.auction AS auction_id
FROM (SELECT DISTINCT bidder, auction FROM bid WHERE 10 + auction % 5 = 10) a
JOIN placed p ON a.bidder = p.id WHERE state IN ('OR', 'ID', 'CA')"""

_Q3_LATEST = f"""WITH {_AUCTION_E}, {_PERSON_E}
SELECT name, city, state, a.id AS auction_id
FROM (SELECT * FROM auction WHERE category = 10) a
ASOF JOIN (SELECT * FROM person WHERE state IN ('OR', 'ID', 'CA')) p
  ON a.seller = p.id AND a.ts >= p.ts"""

# what the slower input's watermark has passed
_Q3_AS_OF = f"""WITH {_AUCTION_E}, {_PERSON_E},
listed AS (SELECT * FROM auction WHERE category = 10),
known AS (SELECT * FROM person WHERE state IN ('OR', 'ID', 'CA'))
SELECT name, city, state, a.id AS auction_id FROM listed a ASOF JOIN known p ON a.seller = p.id AND a.ts >= p.ts
WHERE epoch_us(a.ts) <= 1000 * least((SELECT epoch_us(max(ts)) // 1000 FROM listed), (SELECT epoch_us(max(ts)) // 1000 FROM known))"""

_Q3_PENDING = f"""WITH {_BID_E.strip()}, {_PERSON_E.strip()}
SELECT name, city, state, a.auction AS auction_id
FROM (SELECT DISTINCT bidder, auction FROM bid WHERE 10 + auction % 5 = 10) a
JOIN (SELECT id, unnest(max_by({{'name': name, 'city': city, 'state': state}}, ts)) FROM person WHERE state IN ('OR', 'ID', 'CA') GROUP BY id) p
  ON a.bidder = p.id"""

_MAX = "SELECT max(num) AS max_num, window_end_ms FROM {counts} GROUP BY window_end_ms"
_HOT = """SELECT auction, num, window_end_ms
FROM (SELECT *, rank() OVER (PARTITION BY window_end_ms ORDER BY num DESC) AS place FROM {counts})
WHERE place = 1"""
_HOT_JOIN = """SELECT c.auction, c.num, c.window_end_ms
FROM counts c JOIN (SELECT max(num) AS max_num, window_end_ms FROM counts GROUP BY window_end_ms) m
  ON c.window_end_ms = m.window_end_ms AND c.num >= m.max_num"""

_Q3_WITHIN = f"""WITH {_AUCTION_E}, {_PERSON_E}
SELECT name, city, state, a.id AS auction_id FROM auction a JOIN person p ON a.seller = p.id
 AND a.ts BETWEEN p.ts - INTERVAL 2 DAY AND p.ts + INTERVAL 2 DAY
WHERE category = 10 AND state IN ('OR', 'ID', 'CA')"""

_Q3_DEDUP_WITHIN = f"""WITH {_BID_E.strip()}, {_PERSON_E.strip()}
SELECT name, city, state, auction_id FROM (
  SELECT DISTINCT name, city, state, a.auction AS auction_id, p.id, p.ts FROM bid a JOIN person p ON a.bidder = p.id
   AND a.ts BETWEEN p.ts - INTERVAL 2 DAY AND p.ts + INTERVAL 2 DAY
  WHERE 10 + a.auction % 5 = 10 AND state IN ('OR', 'ID', 'CA'))"""

_Q8 = f"""WITH {_AUCTION_E}, {_PERSON_E}
SELECT p.id AS person_id, name, reserve FROM auction a JOIN person p
  ON a.seller = p.id
 AND time_bucket(INTERVAL {{size}}, a.ts, TIMESTAMP '1970-01-01')
   = time_bucket(INTERVAL {{size}}, p.ts, TIMESTAMP '1970-01-01')"""

_SESSIONS = "SELECT bidder, num, start_ms, end_ms, last_auction FROM sessions"
_FIRINGS = """SELECT bidder, num, end_ms_or_fire_ms, false AS is_final FROM partials
UNION ALL SELECT bidder, num, end_ms, true FROM sessions"""

# a slot that the watermark has passed, 75 minutes; a session ends with the slot that its gap reaches into
_FIRINGS_BY_SLOTS = f"""SELECT bidder, num, end_ms_or_fire_ms, false AS is_final FROM partials
WHERE (end_ms_or_fire_ms // 4500000 + 1) * 4500000 <= {_WATERMARK_MS}
UNION ALL SELECT bidder, num, end_ms, true FROM sessions WHERE (end_us // 4500000000 + 1) * 4500000000 <= {_WATERMARK_MS} * 1000"""


def oracle_sql() -> dict[str, str]:
    found = {
        "q1_currency": _Q1,
        "q2_filter_mod": _Q2_MOD,
        "q2_filter_in": _Q2_IN,
        "q3_local_items": _Q3,
        "q3_local_items_dedup": _Q3_DEDUP,
        "q3_local_items_dedup_within": _Q3_DEDUP_WITHIN,
        "q3_local_items_within": _Q3_WITHIN,
        "q3_lookup_latest": _Q3_LATEST,
        "q5_window_counts": f"WITH {_COUNTS} SELECT auction, num, window_end_ms FROM counts",
        "q5_window_max": f"WITH {_COUNTS} {_MAX.format(counts='counts')}",
        "q5_hot_items": f"WITH {_COUNTS} {_HOT.format(counts='counts')}",
        "q5_hot_items_join": f"WITH {_COUNTS} {_HOT_JOIN}",
        "q5_hot_items_last_hour": f"WITH {_counts('60 MINUTE', '1 MINUTE', 60)} {_HOT.format(counts='counts')}",
        "q8_new_users": _Q8.format(size="10 HOUR"),
        "q8_new_users_half_day": _Q8.format(size="12 HOUR"),
        "q11_sessions": f"WITH {_SESSION_BIDS} {_SESSIONS}",
        "q11_sessions_by_aggregate": f"WITH {_SESSION_BIDS} {_SESSIONS}",
        "q11_session_firings": f"WITH {_SESSION_BIDS} {_FIRINGS}",
        "stream_q1_currency": _Q1,
        "stream_q2_filter_mod": _Q2_MOD,
        "stream_q2_filter_in": _Q2_IN,
        "stream_q3_local_items": _Q3,
        "stream_q3_local_items_dedup": _Q3_DEDUP,
        "stream_q3_local_items_within": _Q3_WITHIN,
        "stream_q3_lookup_latest": _Q3_LATEST,
        "stream_q3_lookup_as_of": _Q3_AS_OF,
        "stream_q3_pending": _Q3_PENDING,
        "stream_q3_local_items_expiring": _Q3,
        "stream_q5_window_counts": f"WITH {_COUNTS_CLOSED} SELECT auction, num, window_end_ms FROM closed",
        "stream_q5_window_max": f"WITH {_COUNTS_CLOSED} {_MAX.format(counts='closed')}",
        "stream_q5_hot_items": f"WITH {_COUNTS_CLOSED} {_HOT.format(counts='closed')}",
        "stream_q5_hot_items_stream": f"WITH {_COUNTS_CLOSED} {_HOT.format(counts='closed')}",
        "stream_q5_hot_items_join": f"WITH {_COUNTS_CLOSED} {_HOT.format(counts='closed')}",
        "stream_q3_local_items_dedup_within": _Q3_DEDUP_WITHIN,
        "stream_q8_new_users_half_day": _Q8.format(size="12 HOUR"),
        "stream_q8_new_users": _Q8.format(size="10 HOUR"),
        "stream_q11_sessions": f"WITH {_SESSION_BIDS} {_SESSIONS} {_CLOSED_SESSION}",
        "stream_q11_session_firings": f"WITH {_SESSION_BIDS} {_FIRINGS} {_CLOSED_SESSION}",
        "stream_q11_session_firings_by_slots": f"WITH {_SESSION_BIDS} {_FIRINGS_BY_SLOTS}",
    }
    return found if llm is None else {**found, **llm.oracle_sql()}

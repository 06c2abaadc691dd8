"""Every registered query gives the rows and types of its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as registry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
DUCK_TYPES = {T.LongType(): "BIGINT", T.StringType(): "VARCHAR", T.BooleanType(): "BOOLEAN"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


#: Those of the optional operators have their own tests.
EXTRA = set(registry.llm.queries()) | {"pipeline"} if registry.llm else set()
NAMES = sorted(set(registry.queries()) - EXTRA)


def test_every_query_has_an_oracle():
    assert set(NAMES) == registry.oracle_sql().keys() - EXTRA


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() == 2018


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    result = registry.queries()[name](spark, str(DATA))
    columns = sorted(result.columns)
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})")
    assert [str(c[1]) for c in cursor.description] == [
        DUCK_TYPES[result.schema[c].dataType] for c in columns]
    expected = sorted(cursor.fetchall())
    assert sorted(map(tuple, result.select(*columns).collect())) == expected
    assert expected


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream_")] + ["stream_q5_window_counts", "stream_q8_new_users"])
def test_session_zone_changes_nothing(spark, duck, name, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        result = registry.queries()[name](spark, str(DATA))
        columns = sorted(result.columns)
        got = sorted(map(tuple, result.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


# row counts of FIXTURES.md
@pytest.mark.parametrize("name, count", [
    ("q2_filter_mod", 9), ("q2_filter_in", 7), ("q3_local_items", 192), ("q3_lookup_latest", 27),
    ("q8_new_users", 31), ("q5_window_counts", 4634), ("q5_hot_items", 2018),
    ("q5_window_max", 364), ("q11_sessions", 402), ("q11_session_firings", 402 + 52),
])
def test_known_row_counts(spark, name, count):
    assert registry.queries()[name](spark, str(DATA)).count() == count

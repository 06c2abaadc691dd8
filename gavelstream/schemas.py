"""Schemas of the three event types. Money is in whole units (cents)."""

from pyspark.sql import types as T

BID = T.StructType([
    T.StructField("auction", T.LongType()),
    T.StructField("bidder", T.LongType()),
    T.StructField("price", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])

AUCTION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("seller", T.LongType()),
    T.StructField("category", T.LongType()),
    T.StructField("reserve", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])

PERSON = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

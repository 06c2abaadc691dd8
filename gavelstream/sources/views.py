"""Views that bring a user's table or stream into an event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

from gavelstream import schemas


def _in_utc(column: Column) -> Column:
    """A zone-less time as the instant at which UTC clocks show it, whatever the session's zone.

    A cast would take it for the session's local time.
    """
    column = column.cast("timestamp_ntz")
    return F.make_timestamp(F.year(column), F.month(column), F.day(column), F.hour(column), F.minute(column),
                            F.extract(F.lit("SECOND"), column), F.lit("UTC"))


def _view(df: DataFrame, schema: StructType, columns: dict[str, str | Column]) -> DataFrame:
    unknown = set(columns) - set(schema.names)
    if unknown:
        raise ValueError(f"not in the schema: {sorted(unknown)}")
    picked = []
    for field in schema:
        source = columns.get(field.name, field.name)
        column = F.col(source) if isinstance(source, str) else source
        zoneless = (isinstance(field.dataType, TimestampType)
                    and isinstance(df.select(column).schema[0].dataType, (DateType, TimestampNTZType)))
        picked.append((_in_utc(column) if zoneless else column).cast(field.dataType).alias(field.name))
    return df.select(*picked)


def bids(df: DataFrame, **columns: str | Column) -> DataFrame:
    """``bids(lineitem, auction="l_orderkey", ...)``; unnamed fields keep their name."""
    return _view(df, schemas.BID, columns)


def auctions(df: DataFrame, **columns: str | Column) -> DataFrame:
    return _view(df, schemas.AUCTION, columns)


def persons(df: DataFrame, **columns: str | Column) -> DataFrame:
    return _view(df, schemas.PERSON, columns)

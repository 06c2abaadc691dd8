"""Scalar expressions over bids."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


# keys of a stateful processor are taken in groups: enough of them for the state partitions of a large cluster, and few
# enough for a call each; a number that is the same whatever the session, as state depends on it
GROUPS = 1024


def to_euro(price: Column, rate: float) -> Column:
    """Dollar price to euro in 32-bit float arithmetic, cut toward zero.

    Both factors are cast: float times bigint would be computed in double and give
    81 instead of 82 for a price of 100.
    """
    return (F.lit(rate).cast("float") * price.cast("float")).cast("long")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def divisible_by_any(value: Column, divisors: Iterable[int]) -> Column:
    divisors = list(divisors)
    if not divisors or 0 in divisors:
        raise ValueError("divisors: one or more, none of them 0")
    return reduce(or_, [value % F.lit(d) == 0 for d in divisors])


def group_of(groups: int, *keys: str) -> Column:
    """The group that a key falls into."""
    if groups < 1:
        raise ValueError("groups: 1 or more")
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")

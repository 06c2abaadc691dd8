"""Event time as whole microseconds.

Batch operators group by 64-bit numbers rather than window structs: the keys stay
fixed-width, and one pass over a bid yields one key instead of one per window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_micros(interval: str) -> int:
    """'10 seconds' -> 10000000."""
    micros = pd.Timedelta(interval).value // 1000
    if micros <= 0:
        raise ValueError(f"interval must be positive: {interval!r}")
    return micros


def bucket_start(micros: Column, width: int) -> Column:
    """Start of the bucket of ``width`` microseconds, aligned to 1970-01-01 UTC."""
    return micros - F.pmod(micros, F.lit(width))

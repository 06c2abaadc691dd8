"""Column expressions."""

from gavelstream.functions.columns import GROUPS, divisible_by_any, epoch_millis, group_of, to_euro
from gavelstream.functions.timebase import bucket_start, interval_micros

__all__ = ["GROUPS", "bucket_start", "divisible_by_any", "epoch_millis", "group_of", "interval_micros", "to_euro"]

"""Bid, auction and person inputs, as tables or as streams."""

from gavelstream.sources.readers import read_stream, read_table
from gavelstream.sources.views import auctions, bids, persons

__all__ = ["auctions", "bids", "persons", "read_stream", "read_table"]

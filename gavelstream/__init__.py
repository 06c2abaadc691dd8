"""Auction-stream analytics as Spark DataFrame operators.

``plans.batch`` and ``plans.continuous`` hold the ready-made queries; the
operators they are made of live in ``operators`` (batch tables) and
``streaming`` (Structured Streaming inputs).
"""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job: executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

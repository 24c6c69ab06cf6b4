"""Spark operators that turn landed, time-stamped facts into audited indicators.

Everything is a pure function from DataFrames (plus parameters) to DataFrames:
no operator collects, loops over rows on the driver or starts a job while it is
being built.
"""

__version__ = "0.1.0"

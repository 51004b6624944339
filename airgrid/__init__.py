"""Hourly environmental-sensor analytics on Spark DataFrames.

The public API is a set of functions that take and return DataFrames (so they chain with
``DataFrame.transform``) plus a few functions that build Column expressions.
"""

__version__ = "0.1.0"

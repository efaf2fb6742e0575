"""Typed, review-gated relationship graphs as Spark tables.

Every operator takes DataFrames and returns a DataFrame.  See README.md for the list.
"""

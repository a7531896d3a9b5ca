"""Time-series analytics expressed as plain Spark plans.

Points are rows of metric, string tags, a nanosecond timestamp and typed
fields.  Everything below builds DataFrames; nothing here executes rows itself.
"""

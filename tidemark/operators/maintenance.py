"""Retention, compaction, consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.live import live_view


def retain(points: DataFrame, now_ns: int, period_ns: int) -> DataFrame:
    """Points at or after now - period; period 0 keeps all."""
    return points.filter(F.col("ts_ns") >= now_ns - period_ns) if period_ns else points


def compact(mutations: DataFrame, series_tombs: DataFrame | None = None, range_tombs: DataFrame | None = None, *, now_ns: int = 0, period_ns: int = 0) -> DataFrame:
    """What is left of a whole log once versions are merged, tombstones applied and expired points dropped.

    It must see the complete log: a delete that is dropped before the versions it hides would bring them back.
    """
    return retain(live_view(mutations, series_tombs, range_tombs), now_ns, period_ns)


def laid_out(points: DataFrame, partitions: int) -> DataFrame:
    """Range partitions by (series_key, ts_ns), sorted, so that row groups have narrow bounds."""
    return points.repartitionByRange(partitions, "series_key", "ts_ns").sortWithinPartitions("series_key", "ts_ns")


def verify(points: DataFrame) -> DataFrame:
    """Violations by rule: duplicate point keys, null keys, negative times.  All zero for a sound table."""
    by_key = points.groupBy("series_key", "ts_ns").agg(F.count("*").alias("n"))
    return by_key.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long").alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("series_key").isNull() | F.col("ts_ns").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col("ts_ns") < 0, F.col("n"))), F.lit(0)).cast("long").alias("negative_times"),
    )

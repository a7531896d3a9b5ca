"""Watchers over points: outliers by rule, series cardinality, new series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import PointView


def outliers(view: PointView, rules: list[tuple[str, str, float, float]]) -> DataFrame:
    """A row for each numeric field outside [min, max] of its rule (metric, field, min, max); other types are never outliers."""
    hits = F.array(*[
        F.when((F.col("metric") == m) & ((view.number(f) < lo) | (view.number(f) > hi)), F.struct(F.lit(f).alias("field"), view.number(f).alias("value")))
        for m, f, lo, hi in rules
    ])
    named = sorted({m for m, *_ in rules})
    df = view.df.withColumn("series_key", view.key()).filter(F.col("metric").isin(named))
    return df.withColumn("_hit", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select("metric", "series_key", "ts_ns", "_hit.field", "_hit.value")


def cardinality(view: PointView) -> DataFrame:
    keys = ["metric", *view.tag_columns.values()] if view.tag_columns is not None else ["metric", "series_key"]
    return view.df.groupBy("metric").agg(F.count_distinct(F.struct(*keys)).alias("n_series"))


def new_series(view: PointView, known: DataFrame) -> DataFrame:
    """Series keys of the view that known (a table of series_key) lacks."""
    return view.df.select(view.key().alias("series_key")).distinct().join(known.select("series_key"), "series_key", "left_anti")

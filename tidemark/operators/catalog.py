"""Discovery: metrics, tag keys, tag values, series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import PointView
from tidemark.operators.select import select


def show_metrics(view: PointView) -> DataFrame:
    return view.df.select("metric").distinct()


def show_tag_keys(view: PointView, metric: str = "") -> DataFrame:
    df = select(view, metric).df
    if view.tag_columns is None:
        return df.select(F.explode(F.map_keys("tags")).alias("tag_key")).distinct()
    used = df.agg(*[F.count(c).alias(k) for k, c in view.tag_columns.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("tag_key"), F.col(k).alias("n")) for k in view.tag_columns])
    return used.select(F.inline(pairs)).filter("n > 0").select("tag_key")


def show_tag_values(view: PointView, key: str, metric: str = "") -> DataFrame:
    df = select(view, metric).df
    value = F.try_element_at("tags", F.lit(key)) if view.tag_columns is None else view.tag(key)
    return df.select(value.alias("tag_value")).filter(F.col("tag_value").isNotNull()).distinct()


def series_by_tags(view: PointView, metric: str = "", tags: dict[str, str] | None = None) -> DataFrame:
    """Sorted keys of the series with this metric (empty: any) and all these tags."""
    found = select(view, metric, tags)
    if view.tag_columns is not None:  # distinct on the columns first, so that keys are built once a series
        found = found.with_df(found.df.select("metric", *view.tag_columns.values()).distinct())
    return found.df.select(found.key().alias("series_key")).distinct().orderBy("series_key")

"""Whole-range aggregates and epoch-aligned tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.aggregates import AggSpec, column, empty_value, unique
from tidemark.model import PointView, ValidationError

#: Windows that one task looks over, or fills, at a time.
STRIDE = 10_000


def whole_range(view: PointView, specs: list[AggSpec], start: int, end: int, *, series: DataFrame | None = None, null_undefined: bool = False, approximate: bool = False) -> DataFrame:
    """One row over all points given; with series (the matching series at any time), no row when that is empty."""
    specs = unique(specs)
    row = view.df.agg(*[column(view, s, skip_nonfinite=True, null_undefined=null_undefined, approximate=approximate) for s in specs])
    row = row.select(F.lit(start).cast("long").alias("window_start"), F.lit(end).cast("long").alias("window_end"), *[F.col(f"`{s.name}`") for s in specs])
    if series is not None:
        row = row.join(F.broadcast(series.select(F.lit(True).alias("_any")).limit(1)), how="cross").drop("_any")
    return row


def bucket(ts: Column, interval: int) -> Column:
    return ts - F.pmod(ts, F.lit(interval).cast("long"))


def series_columns(view: PointView) -> list[str]:
    return ["metric", "series_key"] + list(view.tag_columns.values()) if view.tag_columns is not None else ["metric", "series_key"]


def downsample(view: PointView, specs: list[AggSpec], start: int, end: int, interval: int, *, fill: str | None = None, null_undefined: bool = False, approximate: bool = False) -> DataFrame:
    """A row for each series and window with points.

    Windows are [w, w + interval) with w a multiple of interval, and w < end: a point
    at an aligned end belongs to no window.  fill: None; "any" adds one row for
    each window that no series has points in, after the first that has, under
    the series of the last point before it; "per_series" fills each series from
    its own first window on.
    """
    if interval <= 0:
        raise ValidationError("a window needs a positive interval")
    specs = unique(specs)
    taken = {*series_columns(view), "tags", "window_start", "window_end", "_last"} & {s.name for s in specs}
    if taken:
        raise ValidationError(f"output names that windows have themselves: {sorted(taken)}")
    df = view.df.withColumn("series_key", view.key()).withColumn("window_start", bucket(F.col("ts_ns"), interval)).filter(F.col("window_start") < end)
    typed = view.with_df(df)
    if view.tag_columns is not None:
        keys = ["metric", *view.tag_columns.values()]  # the plain columns are the series, without building its key for every row
        tags: list[Column] = []
    else:
        keys, tags = ["metric", "series_key"], [F.any_value("tags").alias("tags")]
    aggregates = [column(typed, s, skip_nonfinite=False, null_undefined=null_undefined, approximate=approximate) for s in specs]
    out = df.groupBy(*keys, "window_start").agg(*tags, *aggregates, F.max("ts_ns").alias("_last"))
    if view.tag_columns is not None:
        out = out.withColumn("series_key", view.with_df(out).key())
    who = [*series_columns(view), *(["tags"] if tags else [])]
    if fill:
        last_window = (end - 1) // interval * interval
        if fill == "any":
            by_window = out.groupBy("window_start").agg(F.max_by(F.struct(*who), F.struct("_last", "series_key")).alias("_who"))
            # the next window: inside a stride of windows, or else the first of the next stride that has one
            by_window = by_window.withColumn("_stride", F.floor((F.col("window_start") - start) / (interval * STRIDE)))
            strides = by_window.groupBy("_stride").agg(F.min("window_start").alias("_first"))  # a row for STRIDE windows at most
            strides = strides.select("_stride", F.lead("_first").over(Window.orderBy("_stride")).alias("_next"))
            next_w = F.lead("window_start").over(Window.partitionBy("_stride").orderBy("window_start"))
            gap_end = F.coalesce("_in", "_next", F.lit(last_window + interval).cast("long"))
            gaps = by_window.withColumn("_in", next_w).join(strides, "_stride").withColumn("_end", gap_end).filter(F.col("_end") > F.col("window_start") + interval)
        elif fill == "per_series":
            by_series = out.select(F.struct(*who).alias("_who"), "window_start", "series_key")
            next_w = F.lead("window_start").over(Window.partitionBy("series_key").orderBy("window_start"))
            gap_end = F.coalesce(next_w, F.lit(last_window + interval).cast("long"))
            gaps = by_series.withColumn("_end", gap_end).filter(F.col("_end") > F.col("window_start") + interval)
        else:
            raise ValidationError(f"unknown fill mode {fill!r}")
        # a long gap is cut into strides, which are dealt out before their windows are made
        step = F.lit(interval * STRIDE).cast("long")
        cut = gaps.select("_who", "_end", F.explode(F.sequence(F.col("window_start") + interval, F.col("_end") - interval, step)).alias("_from"))
        if (last_window - start) // interval > 100 * STRIDE:
            cut = cut.repartition("_from")
        to = F.least(F.col("_end") - interval, F.col("_from") + interval * (STRIDE - 1))
        holes = cut.select("_who", F.explode(F.sequence(F.col("_from"), to, F.lit(interval).cast("long"))).alias("window_start"))
        empty = holes.select("_who.*", "window_start", *[empty_value(s, null_undefined) for s in specs])
        out = out.drop("_last").unionByName(empty)
    return out.select(*who, "window_start", (F.col("window_start") + interval).alias("window_end"), *[F.col(f"`{s.name}`") for s in specs])

"""Selection: metric, tags, time range, point lookup, order, limit and paging."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import PointView, ValidationError, series_key


def time_bounds(view: PointView, start: int | None, end: int | None) -> list[Column]:
    """Both ends inclusive.  A raw time column gets its own bounds too: only those reach the Parquet reader."""
    out = []
    for ns, is_start in ((start, True), (end, False)):
        if ns is None:
            continue
        out.append(F.col("ts_ns") >= ns if is_start else F.col("ts_ns") <= ns)
        if view.time_column and abs(ns) < 2**62:
            micros = -(-ns // 1000) if is_start else ns // 1000
            at = F.timestamp_micros(F.lit(micros))
            if isinstance(view.df.schema[view.time_column].dataType, T.TimestampNTZType):
                at = at.cast("timestamp_ntz")
            out.append(F.col(view.time_column) >= at if is_start else F.col(view.time_column) <= at)
    return out


def select(view: PointView, metric: str = "", tags: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> PointView:
    """All of: the metric (empty: any), every tag pair, the closed time range.  Unknown tags select nothing."""
    conditions = time_bounds(view, start, end)
    if metric:
        conditions.append(F.col("metric") == metric)
    for k, v in (tags or {}).items():
        have = F.try_element_at("tags", F.lit(k)) if view.tag_columns is None else view.tag(k)
        conditions.append(have == v)
    df = view.df
    for c in conditions:
        df = df.filter(c)
    return view.with_df(df)


def point_get(view: PointView, metric: str, tags: dict[str, str], ts_ns: int) -> DataFrame:
    """The point of exactly this series at exactly this time; no row if there is none."""
    found = select(view, metric, tags, ts_ns, ts_ns)
    return found.df.filter(found.key() == series_key(metric, tags))


def encode_cursor(ts_ns: int, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([ts_ns, key]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[int, str]:
    try:
        ts, key = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return int(ts), str(key)
    except Exception as e:
        raise ValidationError(f"invalid cursor {cursor!r}") from e


def page(df: DataFrame, *, descending: bool = False, limit: int = 0, after: str | None = None, time: str = "ts_ns", key: str = "series_key") -> DataFrame:
    """Rows by (time, key), both in the same direction; after seeks past a cursor; limit 0 keeps all."""
    if after:
        ts, k = decode_cursor(after)
        beyond = (F.col(time) < ts) | ((F.col(time) == ts) & (F.col(key) < k)) if descending else (F.col(time) > ts) | ((F.col(time) == ts) & (F.col(key) > k))
        edge = F.col(time) <= ts if descending else F.col(time) >= ts
        df = df.filter(edge).filter(beyond)
    df = df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in (time, key)])
    return df.limit(limit) if limit else df

"""The query object and the planner: pure functions from a query and a view to a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import AggSpec, check
from tidemark.model import PointView, ValidationError, duration_ns
from tidemark.operators.select import encode_cursor, page, select
from tidemark.operators.window import downsample, whole_range

Clock = Callable[[], int]


@dataclass(frozen=True)
class Query:
    metric: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    start: int = 0
    end: int = 0  # 0: now
    aggregations: tuple[AggSpec, ...] = ()
    interval: str | None = None  # a duration: windows of that length
    relative: str | None = None  # a duration: the last so much time
    fill: str | None = None
    descending: bool = False
    limit: int = 0
    after: str | None = None
    null_undefined: bool = False
    approximate: bool = False


def validate(q: Query) -> Query:
    for s in q.aggregations:
        check(s)
    if q.interval is not None:
        if duration_ns(q.interval) <= 0:
            raise ValidationError("a window needs a positive interval")
        if not q.aggregations:
            raise ValidationError("windows need at least one aggregate")
    if q.limit < 0:
        raise ValidationError("negative limit")
    return q


def resolve(q: Query, view: PointView, clock: Clock = time.time_ns) -> Query:
    """With literal bounds.  Relative ranges end at the newest matching point, or at the clock for windows
    and when that point lies in the future; an invalid relative duration leaves the range as given."""
    if q.relative is not None:
        try:
            length = duration_ns(q.relative)
        except ValidationError:
            length = None
        if length is not None:
            end = clock()
            if q.interval is None:
                newest = select(view, q.metric, q.tags).df.agg(F.max("ts_ns")).first()[0]  # one number
                end = newest if newest is not None and newest <= end else end
            return replace(q, start=end - length, end=end, relative=None)
    return replace(q, end=q.end or clock(), relative=None)


def plan(q: Query, view: PointView, clock: Clock = time.time_ns) -> DataFrame:
    """Filter, then raw points, one aggregate row, or windows; ordered, seeked, limited."""
    q = resolve(validate(q), view, clock)
    found = select(view, q.metric, q.tags, q.start, q.end)
    if q.aggregations and q.interval is None:
        series = select(view, q.metric, q.tags).df
        return whole_range(found, list(q.aggregations), q.start, q.end, series=series, null_undefined=q.null_undefined, approximate=q.approximate)
    if q.aggregations:
        out = downsample(found, list(q.aggregations), q.start, q.end, duration_ns(q.interval), fill=q.fill, null_undefined=q.null_undefined, approximate=q.approximate)
        return page(out, descending=q.descending, limit=q.limit, after=q.after, time="window_start")
    return page(found.df.withColumn("series_key", found.key()), descending=q.descending, limit=q.limit, after=q.after)


def next_cursor(q: Query, rows: list) -> str | None:
    """A cursor past the last row, if the page is full."""
    if not q.limit or len(rows) != q.limit or (q.aggregations and q.interval is None):
        return None
    return encode_cursor(rows[-1]["window_start" if q.aggregations else "ts_ns"], rows[-1]["series_key"])


def cache_key(q: Query) -> str:
    """Equal for queries of equal results apart from paging: tags are sorted, limit and cursor left out."""
    tags = ",".join(f"{k!r}={v!r}" for k, v in sorted(q.tags.items()))
    specs = ",".join(f"{s.function}({s.field!r})as{s.name!r}" for s in q.aggregations)
    forms = [str(q.fill), "desc" if q.descending else "asc", "null" if q.null_undefined else "nan", "approximate" if q.approximate else "exact"]
    return "|".join([repr(q.metric), tags, str(q.start), str(q.end), str(q.relative), str(q.interval), specs, *forms])

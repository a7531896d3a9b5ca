"""The aggregate functions, as Columns over one numeric and one presence column.

Undefined results are NaN, or NULL with null_undefined.  Non-finite inputs:
skip_nonfinite=True (whole-range aggregates) leaves NaN and infinities out of
all numeric functions; False (windows) lets them through, except that min and
max never pick NaN.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import PointView, ValidationError

FUNCTIONS = ("count", "sum", "avg", "min", "max", "first", "last", "frac", "stddev")
_PERCENTILE = re.compile(r"[pP](\d+(?:\.\d+)?)$")


@dataclass(frozen=True)
class AggSpec:
    function: str
    field: str = "*"
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}_{self.field}"


def percentile_of(function: str) -> float | None:
    m = _PERCENTILE.match(function)
    return float(m[1]) if m and float(m[1]) <= 100 else None


def check(spec: AggSpec) -> AggSpec:
    if spec.function not in FUNCTIONS and percentile_of(spec.function) is None:
        raise ValidationError(f"unknown aggregate function {spec.function!r}")
    if spec.field == "*" and spec.function != "count":
        raise ValidationError(f"{spec.function}(*) is undefined; only count takes *")
    return spec


def _defined(value: Column, null_undefined: bool) -> Column:
    return value if null_undefined else F.coalesce(value, F.lit(float("nan")))


def column(view: PointView, spec: AggSpec, *, skip_nonfinite: bool, null_undefined: bool = False, approximate: bool = False) -> Column:
    """The aggregate Column of one spec.

    Percentiles interpolate between neighbours and are exact, from a table of a group's distinct values; approximate: by a sketch
    of bounded size at any group size, within one in 10,000 of the rank and without interpolation.
    """
    check(spec)
    if spec.function == "count":
        hit = F.lit(1) if spec.field == "*" else F.when(view.present(spec.field), 1)
        return F.count(hit).cast("double").alias(spec.name)
    num = view.number(spec.field)
    infinite = (num == float("inf")) | (num == float("-inf"))
    if skip_nonfinite:
        num = F.when(~F.isnan(num) & ~infinite, num)
    # within a window of one series the time alone tells the order
    order = F.when(num.isNotNull(), F.struct("ts_ns", view.key()) if skip_nonfinite else F.col("ts_ns"))
    if spec.function == "sum":
        return F.coalesce(F.sum(num), F.lit(0.0)).alias(spec.name)
    if spec.function == "avg":
        out = F.avg(num)
    elif spec.function in ("min", "max"):
        comparable = F.when(~F.isnan(num), num)
        best, none = (F.min(comparable), float("inf")) if spec.function == "min" else (F.max(comparable), float("-inf"))
        out = F.coalesce(best, F.when(F.count(num) > 0, F.lit(none)))
    elif spec.function == "first":
        out = F.min_by(num, order)
    elif spec.function == "last":
        out = F.max_by(num, order)
    elif spec.function == "stddev":
        out = F.when(F.count(num) > 1, F.stddev_samp(num))
    elif spec.function == "frac":
        first, last = F.min_by(num, order), F.max_by(num, order)
        at_zero = F.when(last == 0, 0.0).when(last > 0, float("inf")).otherwise(float("-inf"))
        out = F.when(F.count(num) > 1, F.when(first == 0, at_zero).otherwise((last - first) / F.nullif(first, F.lit(0.0))))
    else:
        p = percentile_of(spec.function) / 100
        out = F.percentile_approx(num, p, 10_000) if approximate else F.percentile(num, p)
    return _defined(out, null_undefined).alias(spec.name)


def empty_value(spec: AggSpec, null_undefined: bool = False) -> Column:
    """What a window without points holds."""
    if spec.function in ("count", "sum"):
        return F.lit(0.0).alias(spec.name)
    return F.lit(None if null_undefined else float("nan")).cast("double").alias(spec.name)


def unique(specs: list[AggSpec]) -> list[AggSpec]:
    """Of specs with one output name the last wins."""
    return list({s.name: s for s in specs}.values())

"""Data model: schemas, series identity, name rules, typed values, durations."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType([
    T.StructField("t", T.ByteType()), T.StructField("f", T.DoubleType()), T.StructField("i", T.LongType()),
    T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()),
])
#: Type codes of a stored value.
NIL, FLOAT, INT, STRING, BOOL = range(5)

MUTATION = T.StructType([
    T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("metric", T.StringType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False), T.StructField("series_key", T.StringType(), False),
    T.StructField("ts_ns", T.LongType(), False), T.StructField("fields", T.MapType(T.StringType(), VALUE), False),
])
SERIES_TOMB = T.StructType([T.StructField("series_key", T.StringType(), False), T.StructField("seq", T.LongType(), False)])
RANGE_TOMB = T.StructType([
    T.StructField("series_key", T.StringType(), False), T.StructField("min_ts", T.LongType(), False),
    T.StructField("max_ts", T.LongType(), False), T.StructField("seq", T.LongType(), False),
])


class ValidationError(ValueError):
    """A point, name or query that the engine refuses."""


def _name_ok(name: str) -> bool:
    def letter(c: str) -> bool:
        return c in "_:" or unicodedata.category(c)[0] in "LM"

    return bool(name) and letter(name[0]) and all(letter(c) or c == "." or unicodedata.category(c)[0] == "N" for c in name[1:])


def check_metric(name: str) -> str:
    if not isinstance(name, str) or not _name_ok(name):
        raise ValidationError(f"invalid metric name {name!r}")
    return name


def check_tag(name: str, internal: bool = False) -> str:
    """A leading double underscore is kept for internal labels."""
    if not isinstance(name, str) or not _name_ok(name) or (name.startswith("__") and not internal):
        raise ValidationError(f"invalid tag name {name!r}")
    return name


def typed_value(value) -> tuple:
    """The VALUE struct of a Python value; bool is tested before int, of which it is a subclass."""
    if value is None:
        return (NIL, None, None, None, None)
    if isinstance(value, bool):
        return (BOOL, None, None, None, value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValidationError(f"integer out of range: {value}")
        return (INT, None, value, None, None)
    if isinstance(value, float):
        return (FLOAT, value, None, None, None)
    if isinstance(value, str):
        return (STRING, None, None, value, None)
    raise ValidationError(f"unsupported field type {type(value).__name__}")


def series_key(metric: str, tags: dict[str, str]) -> str:
    """metric NUL k1=v1 SOH k2=v2, tags sorted by name; without tags, the bare metric."""
    pairs = "\x01".join(f"{k}={v}" for k, v in sorted(tags.items()))
    return f"{metric}\x00{pairs}" if pairs else metric


def series_key_of_map(metric: Column, tags: Column) -> Column:
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\x01")
    return F.when(F.size(tags) > 0, F.concat(metric, F.lit("\x00"), pairs)).otherwise(metric)


def series_key_of_columns(metric: Column, tags: dict[str, Column]) -> Column:
    """The same key from one column a tag; a null column means that the series lacks the tag."""
    pairs = F.concat_ws("\x01", *[F.concat(F.lit(f"{k}="), tags[k]) for k in sorted(tags)])
    return F.when(pairs != "", F.concat(metric, F.lit("\x00"), pairs)).otherwise(metric) if tags else metric


#: Nanoseconds of each duration unit.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def duration_ns(text: str) -> int:
    """Nanoseconds of texts such as 1h30m, 1.5h or 500ms; days and weeks are no units."""
    body, sign = (text[1:], -1 if text[0] == "-" else 1) if text[:1] in ("-", "+") else (text, 1)
    if body == "0":
        return 0
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValidationError(f"invalid duration {text!r}")
    total = 0
    for number, unit in parts:
        whole, _, rest = number.partition(".")
        total += int(whole or 0) * UNITS[unit] + (int(rest) * UNITS[unit] // 10 ** len(rest) if rest else 0)
    return sign * total


@dataclass(frozen=True)
class PointView:
    """A DataFrame of points and how to read tags and fields from it.

    Typed form: tag_columns and field_columns name plain columns, which Parquet
    prunes and filters.  Generic form: both None; tags and fields are maps.
    time_column, when set, is a TIMESTAMP(_NTZ) column that bounds are pushed to.
    """

    df: DataFrame
    tag_columns: dict[str, str] | None = None
    field_columns: dict[str, str] | None = None
    time_column: str | None = None
    extra: tuple[str, ...] = field(default=())

    @property
    def generic(self) -> bool:
        return self.field_columns is None

    def with_df(self, df: DataFrame) -> PointView:
        return PointView(df, self.tag_columns, self.field_columns, self.time_column, self.extra)

    def tag(self, name: str) -> Column:
        if self.tag_columns is None:
            return F.element_at("tags", F.lit(name)) if name else F.lit(None).cast("string")
        return F.col(self.tag_columns[name]) if name in self.tag_columns else F.lit(None).cast("string")

    def present(self, name: str) -> Column:
        """True where the point has a non-null value of the field, of any type."""
        if self.generic:
            v = F.try_element_at("fields", F.lit(name))
            return v.isNotNull() & (v["t"] != NIL)
        return F.col(self.field_columns[name]).isNotNull() if name in self.field_columns else F.lit(False)

    def number(self, name: str) -> Column:
        """The field as a double; null unless it is a float or an integer."""
        if self.generic:
            v = F.try_element_at("fields", F.lit(name))
            return F.when(v["t"] == FLOAT, v["f"]).when(v["t"] == INT, v["i"].cast("double"))
        if name not in self.field_columns:
            return F.lit(None).cast("double")
        kind = self.df.schema[self.field_columns[name]].dataType
        numeric = isinstance(kind, T.NumericType)
        return F.col(self.field_columns[name]).cast("double") if numeric else F.lit(None).cast("double")

    def key(self) -> Column:
        if "series_key" in self.df.columns:
            return F.col("series_key")
        if self.tag_columns is None:
            return series_key_of_map(F.col("metric"), F.col("tags"))
        return series_key_of_columns(F.col("metric"), {k: F.col(c) for k, c in self.tag_columns.items()})

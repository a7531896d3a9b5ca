"""The live view of a mutation log: newest version first, tombstones after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import PointView
from tidemark.operators.select import select

#: Tombstone tables up to this size are broadcast; larger ones are joined by key.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> bool:
    """By the optimiser's size estimate, which is an upper bound for scans and literal tables."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def newest(mutations: DataFrame, keys: tuple[str, ...] = ("series_key", "ts_ns")) -> DataFrame:
    """One row a point key: that of the highest seq; equal seqs fall to the larger op, then to the larger hash of the rest, whatever the order of the input.

    A partial and a final aggregate, so that overwritten versions vanish before the shuffle.
    """
    payload = [c for c in mutations.columns if c not in keys and c != "seq"]
    plain = [F.array_sort(F.map_entries(c)) if t.startswith("map<") else F.col(c) for c, t in mutations.dtypes if c in payload and c != "op"]
    order = F.struct("seq", *(["op"] if "op" in payload else []), F.xxhash64(*plain) if plain else F.lit(0))
    best = mutations.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by(F.struct(*payload), order).alias("_p"))
    return best.select(*keys, "seq", "_p.*").select(*mutations.columns)


def hide(points: DataFrame, series_tombs: DataFrame | None = None, range_tombs: DataFrame | None = None) -> DataFrame:
    """Without the points that a tombstone of their series, at or after their seq, covers; seq 0 is always covered."""

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small(df) else df

    if series_tombs is not None:
        s = side(series_tombs.groupBy(F.col("series_key").alias("_k")).agg(F.max("seq").alias("_s")))
        points = points.join(s, (F.col("series_key") == F.col("_k")) & (F.col("seq") <= F.col("_s")), "left_anti")
    if range_tombs is not None:
        r = side(range_tombs.select(F.col("series_key").alias("_k"), F.col("min_ts").alias("_lo"), F.col("max_ts").alias("_hi"), F.col("seq").alias("_s")))
        points = points.join(r, (F.col("series_key") == F.col("_k")) & (F.col("seq") <= F.col("_s")) & F.col("ts_ns").between(F.col("_lo"), F.col("_hi")), "left_anti")
    return points


def live_view(mutations: DataFrame, series_tombs: DataFrame | None = None, range_tombs: DataFrame | None = None) -> DataFrame:
    """Newest version of each point, without deleted ones.  Order matters: an older put must not outlive its delete."""
    return hide(newest(mutations).filter(F.col("op") == "E"), series_tombs, range_tombs)


def live_points(mutations: DataFrame, series_tombs: DataFrame | None = None, range_tombs: DataFrame | None = None, *, metric: str = "", tags: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> PointView:
    """The live view of some series and times.

    Metric, tags and time are the same in all versions of a point, so they are filtered before versions are merged:
    they reach the scan, and only the asked series are shuffled.  None of them may be a field.
    """
    asked = select(PointView(mutations), metric, tags, start, end).df
    return PointView(live_view(asked, series_tombs, range_tombs))

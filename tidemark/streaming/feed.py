"""Live feeds of the mutation log and ordered replication of it.

A feed is at-least-once and carries every kind of mutation.  Replication applies
batches in seq order and refuses gaps; a batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class ReplicationGap(RuntimeError):
    """A batch starts beyond the next seq, or has holes."""


def _matches(value: Column, pattern: str) -> Column:
    """Equality, or with a trailing * a prefix."""
    return value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern


def subscription(metric: str = "", tags: dict[str, str] | None = None) -> Column:
    """The filter of a subscriber; empty metric: any."""
    out = _matches(F.col("metric"), metric) if metric else F.lit(True)
    for k, v in (tags or {}).items():
        out = out & F.coalesce(_matches(F.try_element_at("tags", F.lit(k)), v), F.lit(False))
    return out


def tail(spark: SparkSession, path: str, schema: StructType, from_seq: int = 0) -> DataFrame:
    """A stream of the log's rows of seq >= from_seq."""
    return spark.readStream.schema(schema).parquet(path).filter(F.col("seq") >= from_seq)


def tail_all(spark: SparkSession, root: str, folders: dict[str, str], schemas: dict[str, StructType], from_seq: int = 0) -> DataFrame:
    """A stream of every change of a store: PUT, DELETE, DELETE_SERIES, DELETE_RANGE as update_type, with series_key, metric, tags, time or range, fields.

    Deletes of series and ranges name their series by its key; metric and tags are read from it.
    """
    log = tail(spark, f"{root}/{folders['mutations']}", schemas["mutations"], from_seq)
    kind = F.when(F.col("op") == "E", "PUT").otherwise("DELETE").alias("update_type")
    nothing = F.lit(None).cast("long")
    out = log.select(kind, "seq", "metric", "tags", "series_key", F.col("ts_ns").alias("min_ts"), F.col("ts_ns").alias("max_ts"), "fields")
    parts = F.split("series_key", "\x00")
    pairs = F.when(F.size(parts) > 1, F.transform(F.split(parts[1], "\x01"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"))))
    tags = F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))
    for table, update, lo, hi in (("series_tombs", "DELETE_SERIES", nothing, nothing), ("range_tombs", "DELETE_RANGE", F.col("min_ts"), F.col("max_ts"))):
        tombs = tail(spark, f"{root}/{folders[table]}", schemas[table], from_seq)
        gone = tombs.select(F.lit(update).alias("update_type"), "seq", parts[0].alias("metric"), tags.alias("tags"), "series_key", lo.alias("min_ts"), hi.alias("max_ts"), F.lit(None).cast(schemas["mutations"]["fields"].dataType).alias("fields"))
        out = out.unionByName(gone)
    return out


def subscribe(log: DataFrame, metric: str = "", tags: dict[str, str] | None = None) -> DataFrame:
    kind = F.when(F.col("op") == "E", "PUT").when(F.col("op") == "D", "DELETE").otherwise(F.col("op"))
    return log.filter(subscription(metric, tags)).withColumn("update_type", kind)


def live_windows(log: DataFrame, value: Column, interval: str, lateness: str) -> DataFrame:
    """A continuous count, sum, min and max by metric and window; later points than the lateness are left out."""
    at = F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long"))
    windows = log.withColumn("event_time", at).withColumn("_v", value).withWatermark("event_time", lateness).groupBy("metric", F.window("event_time", interval))
    return windows.agg(F.count("_v").alias("count"), F.sum("_v").alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def replicate(log: DataFrame, checkpoint: str, applied: Callable[[], int], append: Callable[[DataFrame], None], *, available_now: bool = True, held: str | None = None) -> StreamingQuery:
    """Appends the log to a follower.  applied(): the follower's last seq, asked once; append(df): adds rows to it.

    A batch that begins beyond the next seq, or has holes, is an error; with held, a folder, it waits there until what is missing has
    come, and is applied in order with it.
    """
    last: list[int] = []

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        done = last[0] if last else applied()
        waiting = _waiting(spark, held, df.schema) if held else None
        fresh = (df if waiting is None else df.unionByName(waiting)).filter(F.col("seq") > done).dropDuplicates(["seq"]).persist()
        try:
            lo, hi, n = fresh.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
            if not n:
                return
            if lo != done + 1 or hi - lo + 1 != n:
                if not held:
                    raise ReplicationGap(f"expected seq {done + 1}, got {lo} to {hi} in {n} rows")
                df.write.mode("overwrite").parquet(f"{held}/{batch_id:012d}")  # the same rows if the batch comes again
                return
            append(fresh)
            last[:] = [hi]
            if waiting is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(held)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        finally:
            fresh.unpersist()

    writer = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _waiting(spark: SparkSession, held: str, schema: StructType) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(held)
    return spark.read.schema(schema).parquet(f"{held}/*") if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def bootstrap(leader, follower, name: str | None = None) -> int:
    """Fills an empty follower store from a snapshot of the leader (default: the newest); returns the seq from which to tail the leader's log."""
    known = {s["name"]: s for s in leader.snapshots()}
    if not known:
        raise ValueError("the leader has no snapshot")
    name = name or list(known)[-1]
    for p in leader.chain(name):
        for table in p["folders"]:
            follower.append(table, leader.read(table, {table: [f"snapshots/{p['name']}/{table}"]}))
    return known[name]["seq"] + 1


def progress(leader, follower) -> dict:
    """How far a follower store is behind its leader: rows of the log that it lacks, and the time between their newest points."""
    top = leader.max_seq()
    done = follower.max_seq()
    newest = lambda store: store.read("mutations").agg(F.max("ts_ns")).first()[0] or 0
    return {"leader_seq": top, "follower_seq": done, "behind": max(0, top - done), "lag_ns": lag_ns(newest(leader), newest(follower))}


def lag_ns(now_ns: int, last_applied_ns: int) -> int:
    return max(0, now_ns - last_applied_ns)

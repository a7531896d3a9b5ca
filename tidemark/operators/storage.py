"""What a store's files say: sizes, unreadable files, which of them to compact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class StoredFile:
    path: str
    bytes: int


def readable(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """path, rows, min_ts, max_ts of each file that can be decoded; a file without rows has none."""
    table = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*files)
    at = [F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts")] if "ts_ns" in schema.names else []
    whole = F.xxhash64(*[F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in schema.fields])  # so that all columns are decoded
    return table.select(F.col("_metadata.file_path").alias("path"), whole.alias("_h"), *schema.names).groupBy("path").agg(F.count("_h").alias("rows"), *at)


def violations(mutations: DataFrame) -> DataFrame:
    """Of stored mutations, one row: repeated_seqs, bad_keys (series_key is not that of metric and tags), null_keys, negative_times, unknown_ops."""
    from tidemark.model import series_key_of_map

    again = mutations.groupBy("seq", "series_key", "ts_ns").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("series_key") != series_key_of_map(F.col("metric"), F.col("tags")), 1)).alias("bad"), F.count(F.when(~F.col("op").isin("E", "D"), 1)).alias("odd"),
        F.first("metric").alias("metric"), F.first("tags").alias("tags"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return again.agg(
        total(F.col("n") - 1).alias("repeated_seqs"), total("bad").alias("bad_keys"), total(F.when(F.col("series_key").isNull() | F.col("ts_ns").isNull(), F.col("n"))).alias("null_keys"),
        total(F.when(F.col("ts_ns") < 0, F.col("n"))).alias("negative_times"), total("odd").alias("unknown_ops"),
    )


def compaction_due(files: list[StoredFile], *, most_files: int = 16, small_bytes: int = 16 << 20) -> bool:
    """Whether there are so many small files that a merge pays."""
    return sum(f.bytes < small_bytes for f in files) > most_files


def compaction_score(folder: list[StoredFile], tombs: int, *, target_bytes: int = 128 << 20) -> float:
    """How much a folder gains from being rewritten: files beyond those that its bytes need, and tombstones."""
    needed = max(1, -(-sum(f.bytes for f in folder) // target_bytes))
    return len(folder) - needed + tombs


#: Points that one task of a compaction sorts: versions of maps are large in memory, however well their files compress.
POINTS = 1 << 20


def partitions_for(files: list[StoredFile], target_bytes: int = 128 << 20, points: int = 0) -> int:
    """Files of about target_bytes for the bytes that there are, and of POINTS at most for that many points."""
    return max(1, -(-sum(f.bytes for f in files) // target_bytes), -(-points // POINTS))

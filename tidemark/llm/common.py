"""What the operators share: stored intermediate tables, byte folding, batch slices."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as all word definitions here take it: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Rows that Python code takes at a time; bounds its memory for long texts.
SLICE = 256


#: Bits of a `Sieve`, and bits of one of its rows: 2048 rows of 4 kB at most, whatever the input.
SIEVE_BITS, SIEVE_ROW = 1 << 26, 1 << 15


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which executors and driver share.

    Where that is unset, a temporary folder is used if the master is local (one machine, as in tests); a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark"
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame written to the shared folder and read again: computed once, and safe from lost executors.

    The folder goes with `discard`, or when the driver's file system closes.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `stored` whose last reader has been written."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


class Sieve:
    """A bitmap of hashed keys, of a fixed size: rows whose key is in the table always pass, others pass at the rate at which bits are set.

    It spares rows a shuffle that the join behind it would drop anyway; where it is full, all rows pass and the join alone decides.
    """

    def __init__(self, keys: DataFrame, *columns: str | Column):
        bit = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))
        row, at = F.floor(bit / SIEVE_ROW).cast("int"), F.pmod(bit, F.lit(SIEVE_ROW))
        bits = keys.select(row.alias("_row"), at.alias("_at")).groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits"))
        self.bits = stored(bits, "sieve")  # at most SIEVE_BITS / SIEVE_ROW rows

    def mark(self, df: DataFrame, name: str, *columns: str | Column) -> DataFrame:
        """df with a boolean column: whether the key may be in the table."""
        bit = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))
        of, at = f"{name}_row", F.pmod(bit, F.lit(SIEVE_ROW))
        side = self.bits.select(F.col("_row").alias(of), F.col("_bits").alias(f"{name}_bits"))
        byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
        joined = df.join(F.broadcast(side), F.floor(bit / SIEVE_ROW).cast("int") == F.col(of), "left")
        return joined.withColumn(name, is_set).drop(of, f"{name}_bits")

    def passed(self, df: DataFrame, *columns: str | Column) -> DataFrame:
        return self.mark(df, "_passed", *columns).filter("_passed").drop("_passed")


def rows_without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id (null too) is not in ids (one column); only rows that a sieve names meet ids in a join, the others pass by."""
    tag = uuid.uuid4().hex[:8]  # of column names that no table has
    may, own = f"may_{tag}", [named(c) for c in docs.columns]
    ids = stored(ids.toDF(f"id_{tag}").distinct(), "ids")
    marked = Sieve(ids, f"id_{tag}").mark(docs, may, named(id_col))
    rest = marked.filter(F.col(may)).join(ids, named(id_col).eqNullSafe(F.col(f"id_{tag}")), "left_anti")
    return marked.filter(~F.col(may)).select(*own).unionAll(rest.select(*own))


def named(column: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


class Kept(dict):
    """Values by a key of text or bytes, computed by `compute` where missing; starts anew at `room` bytes of keys and values.

    Keys of more than `longest` bytes or characters are computed each time: what is that long seldom comes again.
    """

    def __init__(self, compute: Callable, room: int = 48 << 20, longest: int = 128, known: dict | None = None):
        super().__init__(known or {})
        self.compute, self.room, self.longest, self.known, self.used = compute, room, longest, known or {}, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            # an entry of the table, the two objects, and what is in them
            self.used += 200 + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.used > self.room:
                self.clear()
                self.update(self.known)
                self.used = 0
            self[key] = value
        return value


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def utf8(text: str = "text") -> Column:
    """The text's bytes, empty for null."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], n: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)

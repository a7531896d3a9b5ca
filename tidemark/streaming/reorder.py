"""Numbered rows of a stream put back in order: a keyed, stateful operator.

Each key waits for the next number.  Rows come out as soon as all before them have; later ones are held; rows below the next
number are left out.  If a number is missing longer than the timeout, the key goes on at the smallest it holds.

Rows travel in packs, as Arrow bytes, made where the input is read.  What a key holds lies in the state store in pieces of a block
of numbers each, so that a task has a buffer of rows and one block in memory, however much is held, and a micro-batch
writes what came with it, not what was there.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Numbers of a block, rows of a pack, and rows or bytes that a task gathers before it sorts and cuts them.
BLOCK, PACK, GATHER, GATHER_BYTES = 4096, 2048, 1 << 18, 32 << 20
#: The state store that keeps maps outside of the heap, as keyed maps need it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Sent whole: the process that asks the keeper for its state's columns runs beside the driver and may not have this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def advance(expected: int, held: dict[int, str], came: list[tuple[int, str]], skip: bool = False) -> tuple[list[tuple[int, str]], int, dict[int, str]]:
    """(rows that come out, the next number, what is held).  Of rows with one number the last that came before its turn stays; skip: a missing number is given up."""
    held = held | {n: row for n, row in came if n >= expected}
    if skip and held and expected not in held:
        expected = min(held)
    out = []
    while expected in held:
        out.append((expected, held.pop(expected)))
        expected += 1
    return out, expected, held


def _bytes_of(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _rows_of(body: bytes) -> pa.Table:
    with pa.ipc.open_stream(body) as source:
        return source.read_all()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of key, number and row: key and body, each a pack of one key, by number."""

    def packs(gathered: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(gathered).combine_chunks()
        code = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((rows["number"].to_numpy(), code))
        rows, code = rows.take(pa.array(order)), code[order]
        size = max(1, min(PACK, (256 << 10) * rows.num_rows // max(1, rows.nbytes)))
        ends = [*(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        cuts = [(at, min(at + size, end)) for begin, end in zip([0, *ends], ends) for at in range(begin, end, size)]
        body = [_bytes_of(rows.select(["number", "row"]).slice(a, b - a)) for a, b in cuts]
        keys = rows["key"].combine_chunks().take(pa.array([a for a, _ in cuts]))
        return pa.RecordBatch.from_arrays([keys, pa.array(body, pa.binary())], ["key", "body"])

    gathered, n, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            gathered, n, size = [*gathered, batch], n + batch.num_rows, size + batch.nbytes
        if n >= GATHER or size >= GATHER_BYTES:
            yield packs(gathered)
            gathered, n, size = [], 0, 0
    if gathered:
        yield packs(gathered)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0):
            for rows in _rows_of(body.as_py()).select(["row"]).to_batches():
                yield pa.RecordBatch.from_arrays(rows.column(0).flatten(), [f.name for f in rows.schema.field(0).type])


class _Keeper(StatefulProcessor):
    """Of a key: the next number, the count of its micro-batches, since when it waits, and how many pieces each block has."""

    def __init__(self, first: int, timeout_ms: int | None):
        self.first, self.timeout_ms = first, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "expected long, batch long, since long, pieces string")
        self.held = handle.getMapState("held", "block long, piece long", "body binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected, batch, since, pieces = self._read()
        gathered, n, size = [], 0, 0
        for part in rows:
            for body in part["body"]:
                pack = _rows_of(body)
                gathered, n, size = [*gathered, pack], n + pack.num_rows, size + pack.nbytes
                if n >= GATHER or size >= GATHER_BYTES:
                    self._hold(gathered, expected, batch, pieces)
                    gathered, n, size = [], 0, 0
        if gathered:
            self._hold(gathered, expected, batch, pieces)
        yield from self._release(expected, batch + 1, since, pieces, timerValues.getCurrentProcessingTimeInMs(), skip=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, batch, since, pieces = self._read()
        now = timerValues.getCurrentProcessingTimeInMs()
        yield from self._release(expected, batch, since, pieces, now, skip=bool(pieces) and now >= since + self.timeout_ms)

    def _read(self) -> tuple[int, int, int, dict[int, int]]:
        expected, batch, since, pieces = self.progress.get() if self.progress.exists() else (self.first, 0, 0, "{}")
        return expected, batch, since, {int(b): n for b, n in json.loads(pieces).items()}

    def _hold(self, packs: list[pa.Table], expected: int, batch: int, pieces: dict[int, int]) -> None:
        rows = pa.concat_tables(packs).combine_chunks()
        number = rows["number"].to_numpy()
        order = np.argsort(number, kind="stable")
        order = order[number[order] >= expected]
        number, rows = number[order], rows.take(pa.array(order))
        rows = rows.append_column("batch", pa.array(np.full(len(order), batch, dtype="int64")))
        ends = [*(np.flatnonzero(np.diff(number // BLOCK)) + 1).tolist(), len(number)] if len(number) else []
        for a, b in zip([0, *ends], ends):
            self._put(int(number[a]) // BLOCK, rows.slice(a, b - a), pieces)

    def _put(self, block: int, rows: pa.Table, pieces: dict[int, int]) -> None:
        piece = pieces.get(block, 0)
        self.held.updateValue((block, piece), (_bytes_of(rows),))
        pieces[block] = piece + 1

    def _take(self, block: int, pieces: dict[int, int]) -> pa.Table:
        """The block's rows, in the order in which they count as having come: in a batch arrival has none, so of equal numbers the larger row is the later one."""
        rows = pa.concat_tables([_rows_of(bytes(self.held.getValue((block, i))[0])) for i in range(pieces[block])]).combine_chunks()
        number, batch = rows["number"].to_numpy(), rows["batch"].to_numpy()
        order = np.lexsort((batch, number))
        same = (np.diff(number[order]) == 0) & (np.diff(batch[order]) == 0)
        if same.any():
            again = set(order[:-1][same].tolist()) | set(order[1:][same].tolist())
            order = np.array(sorted(order.tolist(), key=lambda i: (number[i], batch[i], str(rows["row"][i].as_py()) if i in again else "")))
        return rows.take(pa.array(order))

    def _drop(self, block: int, pieces: dict[int, int]) -> None:
        for i in range(pieces.pop(block)):
            self.held.removeKey((block, i))

    def _release(self, expected: int, batch: int, since: int, pieces: dict[int, int], now: int, skip: bool) -> Iterator[pd.DataFrame]:
        waited_for = expected
        while pieces:
            block = min(pieces) if skip else expected // BLOCK
            if block not in pieces:
                break
            rows = self._take(block, pieces)
            out, following, kept = advance(expected, {}, list(zip(rows["number"].to_pylist(), range(rows.num_rows))), skip)
            skip = False
            if out or pieces[block] > 1:
                self._drop(block, pieces)
                if kept:
                    self._put(block, rows.take(pa.array(sorted(kept.values()))), pieces)
            ready = rows.take(pa.array([i for _, i in out], pa.int64())).select(["row"])
            for at in range(0, len(out), PACK):
                yield pd.DataFrame({"body": [_bytes_of(ready.slice(at, PACK))]})
            expected = following
            if kept or not out:
                break
        since = 0 if not pieces else now if not since or expected != waited_for else since  # when it began to wait for this number
        self.progress.update((expected, batch, since, json.dumps(pieces)))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if pieces:
                self.handle.registerTimer(max(now + 1, since + self.timeout_ms))


def reorder(stream: DataFrame, key: str, number: str, *, first: int, timeout_ms: int | None) -> DataFrame:
    """The rows of each key by consecutive numbers from first on.  What a key holds is bounded by what comes in during the timeout.

    The order of a key's rows is that of their numbers, over all micro-batches.  Without a timeout a missing number is awaited for
    ever; with one, Spark looks for timeouts in batch after batch, so that availableNow never ends.  The session's state store
    is set to RocksDB: what is held may be larger than the executors' memory.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind, schema = stream.schema[key].dataType, stream.schema
    rows = stream.filter(F.col(number).isNotNull()).select(F.col(key).alias("key"), F.col(number).cast("long").alias("number"), F.struct("*").alias("row"))
    packs = rows.mapInArrow(_packed, T.StructType([T.StructField("key", kind), T.StructField("body", T.BinaryType())]))
    out = packs.groupBy("key").transformWithStateInPandas(_Keeper(first, timeout_ms), "body binary", "Append", "None" if timeout_ms is None else "ProcessingTime")
    return out.mapInArrow(_unpacked, T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))

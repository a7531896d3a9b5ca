"""Rows on their way to the driver: columns of many rows as compressed Arrow bytes, so that an answer of any length costs few bytes a row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["body"])


def packed(df: DataFrame) -> DataFrame:
    """The rows in their order, a pack for each Arrow batch of a partition."""
    return df.mapInArrow(_packed, "body binary")


def rows_of(body: bytes) -> Iterator[dict]:
    """The rows of a pack as plain Python: stored values by their type, NaN and infinities as None, as JSON has neither."""
    with pa.ipc.open_stream(body) as source:
        for batch in source:
            columns = [_plain(c) for c in batch.columns]
            for values in zip(*columns):
                yield dict(zip(batch.schema.names, values))


def _plain(column: pa.Array) -> list:
    if pa.types.is_map(column.type):
        keys, items, ends = _plain(column.keys), _plain(column.items), column.offsets.to_pylist()
        return [dict(zip(keys[a:b], items[a:b])) if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist())]
    if pa.types.is_struct(column.type) and column.type.get_field_index("t") >= 0:  # a stored value
        parts = column.flatten()
        kinds = [parts[column.type.get_field_index(c)].to_pylist() for c in "fisb"]
        return [next((v for v in values if v is not None), None) for values in zip(*kinds)]
    if pa.types.is_floating(column.type):
        return [v if v is None or math.isfinite(v) else None for v in column.to_pylist()]
    return column.to_pylist()

"""Requests in binary frames, as captured from clients: decoded to points and query texts, and encoded.

A frame is a byte for its command, the length of payload and checksum, the payload, and the CRC-32C of all before it;
numbers are big-endian.  Where the next frame begins is known by the length of the one before only, so a capture is decoded from its
beginning, and what follows a frame that is cut short, or whose checksum differs, is given up with the reason.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import BOOL, FLOAT, INT, NIL, STRING, VALUE

# The commands of the frames that clients send.
PUSH, PUSHS, QUERY = 0x01, 0x02, 0x10
#: A decoded request; a PUSHS has a row for each of its points, numbered by item.
REQUEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("item", T.LongType()), T.StructField("command", T.IntegerType()),
    T.StructField("metric", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("ts_ns", T.LongType()),
    T.StructField("fields", T.MapType(T.StringType(), VALUE)), T.StructField("text", T.StringType()), T.StructField("error", T.StringType()),
])
#: Frames and rows of a batch that Python code makes at a time, and bytes of frames.
ROWS, BYTES = 4096, 8 << 20
#: Frames from which on their checksums are made side by side, a byte of each at a time.
TOGETHER = 64


def _crc_table() -> list[int]:
    """The remainders of all bytes by the Castagnoli polynomial, reflected."""
    out = []
    for r in range(256):
        for _ in range(8):
            r = r >> 1 ^ (0x82F63B78 if r & 1 else 0)
        out.append(r)
    return out


_CRC = _crc_table()
_CRC_ARRAY = np.array(_CRC, dtype=np.uint32)


def crc32c(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = r >> 8 ^ _CRC[(r ^ b) & 255]
    return r ^ 0xFFFFFFFF


def crc32c_all(parts: list[bytes]) -> list[int]:
    """The checksum of each part."""
    length = np.array([len(p) for p in parts], dtype=np.int64)
    order, out, done = np.argsort(length, kind="stable"), [0] * len(parts), 0
    while done < len(parts):
        # by length, so many that they fill a table of BYTES, or nearly as long ones
        longest = length[order[min(done + ROWS, len(parts)) - 1]]
        take = order[done : done + max(TOGETHER, min(ROWS, BYTES // max(1, int(longest))))]
        done += len(take)
        at, width = length[take], int(length[take[-1]])
        if len(take) < TOGETHER or width > 4 * int(at.sum()) // len(take) + 1024:
            for i in take.tolist():
                out[i] = crc32c(parts[i])
            continue
        table = np.zeros((len(take), width), dtype=np.uint8)
        table[np.arange(width) < at[:, None]] = np.frombuffer(b"".join([parts[i] for i in take.tolist()]), dtype=np.uint8)
        table, r = np.ascontiguousarray(table.T), np.full(len(take), 0xFFFFFFFF, dtype=np.uint32)
        for column, begin in enumerate(np.searchsorted(at, np.arange(width), side="right").tolist()):  # the parts that are longer
            left = r[begin:]
            r[begin:] = left >> 8 ^ _CRC_ARRAY[(left ^ table[column, begin:]) & 255]
        for i, crc in zip(take.tolist(), (r ^ 0xFFFFFFFF).tolist()):
            out[i] = crc
    return out


def _head(command: int, payload: bytes) -> bytes:
    return struct.pack(">BI", command, len(payload) + 4) + payload


def frame(command: int, payload: bytes) -> bytes:
    head = _head(command, payload)
    return head + struct.pack(">I", crc32c(head))


class Malformed(ValueError):
    """Bytes that are no frame, or no payload of their command."""


_U16, _U32, _I64, _F64, _START = (struct.Struct(f">{kind}") for kind in ("H", "I", "q", "d", "BI"))


def _string(data: bytes, at: int, length: struct.Struct = _U16) -> tuple[str, int]:
    begin = at + length.size
    end = begin + length.unpack_from(data, at)[0]
    if end > len(data):
        raise Malformed("cut short")
    return data[begin:end].decode("utf-8", "replace"), end


def _value(data: bytes, at: int) -> tuple[tuple, int]:
    if at >= len(data):
        raise Malformed("cut short")
    kind, at = data[at], at + 1
    if kind == FLOAT:
        return (kind, _F64.unpack_from(data, at)[0], None, None, None), at + 8
    if kind == INT:
        return (kind, None, _I64.unpack_from(data, at)[0], None, None), at + 8
    if kind == STRING:
        text, at = _string(data, at, _U32)
        return (kind, None, None, text, None), at
    if kind == BOOL:
        if at >= len(data):
            raise Malformed("cut short")
        return (kind, None, None, None, data[at] == 1), at + 1
    if kind != NIL:
        raise Malformed(f"unknown type of value {kind}")
    return (kind, None, None, None, None), at


def _point(data: bytes, at: int) -> tuple[tuple, int]:
    """(metric, tags, time, fields as tuples of VALUE) and where the next point begins."""
    metric, at = _string(data, at)
    tags, fields = {}, {}
    (n,), at = _U16.unpack_from(data, at), at + 2
    for _ in range(n):
        key, at = _string(data, at)
        tags[key], at = _string(data, at)
    (ts,), at = _I64.unpack_from(data, at), at + 8
    end = at + 4 + _U32.unpack_from(data, at)[0]
    if end > len(data):
        raise Malformed("cut short")
    body = data[at + 4 : end]
    if body:
        inner = 2
        for _ in range(_U16.unpack_from(body, 0)[0]):
            key, inner = _string(body, inner)
            fields[key], inner = _value(body, inner)
    return (metric, tags, ts, fields), end


def _request(command: int, payload: bytes) -> tuple[list[tuple], str | None, str | None]:
    """(points, text, error) of a sound frame; of a request that breaks off nothing is taken."""
    try:
        if command == QUERY:
            return [], _string(payload, 0)[0], None
        points, at = [], 0
        if command == PUSH:
            points.append(_point(payload, 0)[0])
        elif command == PUSHS:
            (n,), at = _U32.unpack_from(payload, 0), 4
            for _ in range(n):
                point, at = _point(payload, at)
                points.append(point)
        return points, None, None
    except Malformed as e:
        return [], None, str(e)
    except struct.error:
        return [], None, "cut short"


def _frames(data: bytes) -> Iterator[tuple[int | None, bytes, int, str | None]]:
    """(command, the bytes that the checksum is of, the checksum, error) of each frame; an error is the last."""
    at = 0
    while at < len(data):
        if at + 5 > len(data):
            yield None, b"", 0, "cut short"
            return
        command, length = _START.unpack_from(data, at)
        end = at + 5 + length
        if length < 4 or end > len(data):
            yield command, b"", 0, "no room for a checksum" if length < 4 else "cut short"
            return
        yield command, data[at : end - 4], _U32.unpack_from(data, end - 4)[0], None
        at = end


def _read(captures: Iterator[tuple[str | None, bytes]]) -> Iterator[tuple]:
    """(path, frame, item, command, point, text, error) in their order; checksums are made for many frames at a time."""
    waiting: list[tuple] = []
    size, broken = 0, -1  # broken: the capture of which a checksum differed

    def checked() -> Iterator[tuple]:
        nonlocal broken
        sums = iter(crc32c_all([head for *_, head, _, error in waiting if not error]))
        for capture, path, n, command, head, crc, error in waiting:
            differs = not error and next(sums) != crc
            if capture == broken:
                continue
            if error or differs:
                broken = capture if differs else broken
                yield path, n, 0, command, None, None, error or "checksum differs"
                continue
            points, text, error = _request(command, head[5:])
            if not points:
                # a PUSHS of no points has no row
                if command != PUSHS or error:
                    yield path, n, 0, command, None, text, error
                continue
            for i, point in enumerate(points):
                yield path, n, i, command, point, None, None

    for capture, (path, data) in enumerate(captures):
        for n, (command, head, crc, error) in enumerate(_frames(data)):
            if capture == broken:
                break
            waiting.append((capture, path, n, command, head, crc, error))
            size += len(head)
            if len(waiting) == ROWS or size >= BYTES:
                yield from checked()
                waiting, size = [], 0
    yield from checked()


def requests(data: bytes) -> Iterator[dict]:
    """A dict for each point or text in the frames, in their order; frames of other commands give their command alone."""
    for _, n, item, command, point, text, error in _read(iter([(None, data)])):
        row = {"frame": n, "item": item, "command": command}
        if point:
            metric, tags, ts, fields = point
            row |= {"metric": metric, "tags": list(tags.items()), "ts_ns": ts, "fields": [(k, dict(zip(VALUE.names, v))) for k, v in fields.items()]}
        yield row | ({"text": text} if text is not None else {}) | ({"error": error} if error else {})


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The rows as a batch of REQUEST, column by column."""
    path, n, item, command, points, text, error = zip(*rows)

    def maps(name: str, of: int, values) -> pa.Array:
        kind, ends, keys, items = schema.field(name).type, [0], [], []
        for p in points:
            if p:
                keys += p[of]
                items += p[of].values()
            ends.append(len(keys))
        ends = [None if not p else at for p, at in zip(points, ends)] + ends[-1:]
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, kind.key_type), values(items, kind.item_type), type=kind)

    def stored(items: list[tuple], kind: pa.StructType) -> pa.Array:
        parts = zip(*items) if items else [[]] * kind.num_fields
        return pa.StructArray.from_arrays([pa.array(part, kind.field(i).type) for i, part in enumerate(parts)], fields=list(kind))

    columns = {
        "path": path, "frame": n, "item": item, "command": command, "metric": [p and p[0] for p in points], "tags": maps("tags", 1, pa.array),
        "ts_ns": [p and p[2] for p in points], "fields": maps("fields", 3, stored), "text": text, "error": error,
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, rows = to_arrow_schema(REQUEST), []
    # a capture at a time
    captures = ((path.as_py(), content.as_py() or b"") for batch in batches for path, content in zip(batch.column(0), batch.column(1)))
    for row in _read(captures):
        rows.append(row)
        if len(rows) == ROWS:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def decode(captures: DataFrame) -> DataFrame:
    """The requests (REQUEST) of rows of path and content, such as spark.read.format("binaryFile") gives them."""
    return captures.select("path", "content").mapInArrow(_decode, REQUEST)


def points(decoded: DataFrame, now_ns: int) -> DataFrame:
    """Of decoded requests the points, for Engine.ingest with order=["path", "frame", "item"]; time 0 is now."""
    pushed = decoded.filter(F.col("command").isin(PUSH, PUSHS) & F.col("error").isNull())
    at = F.when(F.col("ts_ns") == 0, F.lit(now_ns)).otherwise(F.col("ts_ns"))
    return pushed.select("path", "frame", "item", "metric", "tags", at.alias("ts_ns"), "fields")


def _big(value: Column, size: int) -> Column:
    """The last bytes of a number, big-endian."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(17 - 2 * size), F.lit(2 * size)))


def encode(points_of: DataFrame) -> DataFrame:
    """content: a PUSH frame for each row of metric, tags, ts_ns, fields; beside the row's own columns."""
    blank = F.lit(b"").cast("binary")

    def string(c: Column, size: int = 2) -> Column:
        return F.concat(_big(F.octet_length(c), size), c.cast("binary"))

    def joined(parts: Column) -> Column:
        return F.concat(_big(F.size(parts), 2), F.aggregate(parts, blank, lambda a, p: F.concat(a, p)))

    def field(e: Column) -> Column:
        v = e["value"]
        body = F.when(v["t"] == INT, _big(v["i"], 8)).when(v["t"] == STRING, string(v["s"], 4)).when(v["t"] == BOOL, F.when(v["b"], F.lit(b"\x01").cast("binary")).otherwise(F.lit(b"\x00").cast("binary")))
        # a double's bytes: only Python has them
        return F.struct(e["key"].alias("key"), v["t"].alias("t"), v["f"].alias("f"), body.alias("body"))

    tags = joined(F.transform(F.map_entries("tags"), lambda e: F.concat(string(e["key"]), string(e["value"]))))
    head = F.concat(string(F.col("metric")), tags, _big(F.col("ts_ns"), 8))
    rows = points_of.withColumn("_head", head).withColumn("_fields", F.transform(F.map_entries("fields"), field))
    kind = T.StructType([*points_of.schema.fields, T.StructField("content", T.BinaryType())])
    return rows.mapInArrow(_encoder(len(points_of.columns)), kind)


def _encoded(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The first columns, and a frame made of the two behind them."""
    fields = batch.column(width + 1)
    part = dict(zip(("key", "t", "f", "body"), (c.to_pylist() for c in fields.values.flatten())))
    packed = [
        _U16.pack(len(name)) + name + bytes([t]) + (_F64.pack(f) if t == FLOAT else body or b"")
        for name, t, f, body in zip([k.encode() for k in part["key"]], part["t"], part["f"], part["body"])
    ]
    heads, ends = [], fields.offsets.to_pylist()
    for head, a, b in zip(batch.column(width).to_pylist(), ends, ends[1:]):
        inner = _U16.pack(b - a) + b"".join(packed[a:b])
        heads.append(_head(PUSH, head + _U32.pack(len(inner)) + inner))
    frames = [head + _U32.pack(crc) for head, crc in zip(heads, crc32c_all(heads))]
    return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(frames, pa.binary())], [*batch.schema.names[:width], "content"])


def _encoder(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _encoded(batch, width)

    return run

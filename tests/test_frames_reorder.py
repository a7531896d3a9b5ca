"""Binary frames and their bad forms; numbered rows put back in order."""

import struct
import time

from tidemark.engine import Engine
from tidemark.model import typed_value
from tidemark.sources import frames
from tidemark.streaming import reorder


def string(s, kind="H"):
    return struct.pack(f">{kind}", len(s.encode())) + s.encode()


def point(metric, tags, ts, body):
    return string(metric) + struct.pack(">H", len(tags)) + b"".join(string(k) + string(v) for k, v in tags.items()) + struct.pack(">qI", ts, len(body)) + body


ONE = point("cpu", {"host": "a"}, 5, struct.pack(">H", 3) + string("v") + b"\x01" + struct.pack(">d", 2.5) + string("n") + b"\x00" + string("s") + b"\x03" + string("é", "I"))
TWO = point("cpu", {}, 0, struct.pack(">H", 2) + string("i") + b"\x02" + struct.pack(">q", -7) + string("b") + b"\x04\x01")


def test_checksum():
    assert frames.crc32c(b"123456789") == 0xE3069283 and frames.crc32c(b"") == 0


def test_requests():
    push, pushs = frames.frame(frames.PUSH, ONE), frames.frame(frames.PUSHS, struct.pack(">I", 2) + ONE + TWO)
    query, other = frames.frame(frames.QUERY, string("SHOW METRICS")), frames.frame(0x20, b"")
    got = list(frames.requests(push + pushs + query + other))
    assert [(r["frame"], r["item"], r["command"]) for r in got] == [(0, 0, 1), (1, 0, 1 + 1), (1, 1, 2), (2, 0, 16), (3, 0, 32)]
    assert dict(got[0]["tags"]) == {"host": "a"} and {k: v["t"] for k, v in got[0]["fields"]} == {"v": 1, "n": 0, "s": 3} and dict(got[0]["fields"])["s"]["s"] == "é"
    assert got[2]["tags"] == [] and dict(got[2]["fields"])["i"]["i"] == -7 and dict(got[2]["fields"])["b"]["b"] is True
    assert got[3]["text"] == "SHOW METRICS"


def test_bad_frames():
    push = frames.frame(frames.PUSH, ONE)
    errors = lambda data: [r.get("error") for r in frames.requests(data)]
    assert errors(b"") == []
    assert errors(push + push[:-1]) == [None, "cut short"] and errors(push[:3]) == ["cut short"]
    assert errors(push[:-1] + bytes([push[-1] ^ 1]) + push) == ["checksum differs"]
    assert errors(struct.pack(">BI", 1, 3) + b"abc") == ["no room for a checksum"]
    # a sound frame with a bad payload is refused whole, and the next one is read
    assert errors(frames.frame(frames.PUSHS, struct.pack(">I", 2) + ONE) + push) == ["cut short", None]
    assert errors(frames.frame(frames.PUSH, point("m", {}, 1, struct.pack(">H", 1) + string("k") + b"\x09"))) == ["unknown type of value 9"]


def test_frames_to_the_engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(frames.frame(frames.PUSHS, struct.pack(">I", 2) + ONE + TWO))
    (tmp_path / "in" / "b.bin").write_bytes(frames.frame(frames.PUSH, ONE) + b"\x01")
    decoded = frames.decode(spark.read.format("binaryFile").load(str(tmp_path / "in")))
    assert [r["error"] for r in decoded.filter("error IS NOT NULL").collect()] == ["cut short"]
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.ingest(frames.points(decoded, 99), order=["path", "frame", "item"]) == 0
    assert sorted((r["ts_ns"], r["seq"]) for r in engine.view().df.collect()) == [(5, 3), (99, 2)]


def test_round_trip(spark):
    values = {"f": float("nan"), "i": -(1 << 63), "s": "ü\x00", "b": False, "n": None}
    df = spark.createDataFrame([("m", {"k": "v"}, 1 << 62, {k: typed_value(v) for k, v in values.items()}), ("é", {}, 0, {})], "metric string, tags map<string,string>, ts_ns long, fields map<string,struct<t:tinyint,f:double,i:bigint,s:string,b:boolean>>")
    sent = frames.encode(df).selectExpr("metric AS path", "content")
    got = {r["path"]: r for r in frames.decode(sent).collect()}
    for r in df.collect():
        back = got[r["metric"]]
        assert back["error"] is None and (back["metric"], back["tags"], back["ts_ns"]) == (r["metric"], r["tags"], r["ts_ns"]) and str(sorted(back["fields"].items())) == str(sorted(r["fields"].items()))
    assert frames.decode(sent.limit(0)).count() == 0


def test_advance():
    out, nxt, held = reorder.advance(1, {}, [(2, "b"), (4, "d"), (1, "a"), (0, "old")])
    assert out == [(1, "a"), (2, "b")] and nxt == 3 and held == {4: "d"}
    out, nxt, held = reorder.advance(nxt, held, [(4, "D"), (2, "b")])
    assert out == [] and nxt == 3 and held == {4: "D"}  # a number that comes again replaces what is held
    out, nxt, held = reorder.advance(nxt, held | {5: "e", 8: "h"}, [], skip=True)
    assert out == [(4, "D"), (5, "e")] and nxt == 6 and held == {8: "h"}
    assert reorder.advance(6, {}, [], skip=True) == ([], 6, {})


def test_a_missing_number_is_given_up(spark, tmp_path):
    spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("x", 4, "d"), ("y", 2, "q"), (None, 1, "n"), ("x", None, "-")], "k string, n long, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, n long, v string").parquet(f"{tmp_path}/in")
    out = reorder.reorder(stream, "k", "n", first=1, timeout_ms=2000)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        until, got = time.time() + 60, []
        while len(got) < 5 and time.time() < until and query.exception() is None:
            time.sleep(1)
            got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert sorted((r["k"] or "", r["n"], r["v"]) for r in got) == [("", 1, "n"), ("x", 1, "a"), ("x", 2, "b"), ("x", 4, "d"), ("y", 2, "q")]

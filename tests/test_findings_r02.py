"""What the findings of round 2 named, at small sizes."""

import datetime as dt

from oracle import compare
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import queries as core
from tidemark.engine import Engine
from tidemark.model import VALUE
from tidemark.operators import storage
from tidemark.plans import answers
from tidemark.plans.query import Query
from tidemark.sources import frames
from tidemark.store_queries import numbered
from tidemark.streaming import reorder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, rows):
    """An events table of (seconds, user, type, value)."""
    at = dt.datetime(2024, 1, 2)
    table = [(i, at + dt.timedelta(seconds=s), u, e, v, f'{{"k": {i % 90}}}') for i, (s, u, e, v) in enumerate(rows)]
    spark.createDataFrame(table, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    (folder / "events.parquet/_SUCCESS").unlink()
    return str(folder)


def test_halves_and_zeros_fall_as_in_the_sql(spark, tmp_path):
    """F2"""
    rows = [(1, 1, "error", 160.0), (2, 1, "error", 5.4), (1, 2, "view", 0.0), (2, 2, "view", 0.0), (1, 3, "view", 0.0), (2, 3, "view", 2.5), (1, 4, "view", 0.0)]
    events(spark, tmp_path, rows)
    got = {r["user_id"]: r["frac_value"] for r in core.queries()["downsample_all_functions"](spark, str(tmp_path)).collect()}
    assert got["1"] == -0.9663 and got["3"] == float("inf") and got["4"] is None and got["2"] != got["2"]
    compare(core.queries()["downsample_all_functions"](spark, str(tmp_path)), core.oracle_sql()["downsample_all_functions"], str(tmp_path))


def test_what_is_held_lies_in_pieces(spark, tmp_path):
    """rows of many blocks wait for the first, some come again, a hole stays; each number comes out once, in order, the latest row of it."""
    last, hole = 3 * reorder.BLOCK + 7, 2 * reorder.BLOCK + 5
    for i, sql in enumerate((
        f"SELECT 'x' k, id n, concat('old ', id) v, map('a', id) m FROM range(2, {last}) WHERE id != {hole} DISTRIBUTE BY id % 7",
        "SELECT 'x' k, id n, concat('new ', id) v, map('a', id) m FROM range(5, 9) UNION ALL SELECT 'x', 7, 'newer', map('a', 0L) UNION ALL SELECT 'y', 1L, 'y', NULL",
        "SELECT 'x' k, 1L n, 'one' v, map('a', 1L) m UNION ALL SELECT 'x', 1L, 'One', NULL",
    )):
        spark.sql(sql).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, n long, v string, m map<string,long>").parquet(f"{tmp_path}/in")
        out = reorder.reorder(stream, "k", "n", first=1, timeout_ms=None)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/cp").selectExpr("count(*) n", "max(length(user_map_value.body)) bytes").first()
        assert (held["n"] >= 4) == (i < 2) and held["bytes"] < 200_000
    got = [r for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").selectExpr("*", "input_file_name() f").collect()]
    x = {r["n"]: r["v"] for r in got if r["k"] == "x"}
    assert len(got) == hole and sorted(x) == list(range(1, hole)) and [r["m"] for r in got if r["k"] == "y"] == [None]
    assert x[1] == max("one", "One") and x[4] == "old 4" and x[5] == "new 5" and x[7] == "newer" and x[hole - 1] == f"old {hole - 1}"
    assert all(r["m"] == {"a": r["n"]} for r in got if r["n"] > 7)
    numbers = [r["n"] for r in got if r["k"] == "x" and r["f"] == max(q["f"] for q in got if q["k"] == "x" and q["n"] == 1)]
    assert len(numbers) == hole - 1 and numbers == sorted(numbers)


def test_numbers_within_keys(spark, tmp_path):
    """F1"""
    df = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'a' ELSE 'b' END k, 1000 - id o FROM range(1000)").repartition(5)
    got = numbered(df, "k", "o", f"{tmp_path}/placed")
    want = df.withColumn("number", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert got.count() == 1000 and got.exceptAll(want.select(got.columns)).isEmpty()


def test_a_compaction_sorts_so_many_points_a_task(spark, tmp_path, monkeypatch):
    """F3"""
    assert storage.partitions_for([storage.StoredFile("x", 1)], points=3 * storage.POINTS) == 3
    monkeypatch.setattr(storage, "POINTS", 100)
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(spark.sql(f"SELECT 'm' metric, map('h', concat(id % 7)) tags, 1000 - id ts_ns, map('v', cast(named_struct('t', 2Y, 'f', null, 'i', id, 's', null, 'b', null) AS {VALUE.simpleString()})) fields, id + 1 seq FROM range(950)").repartition(3))
    engine.compact()
    files = engine.store.files()
    assert len(files) == 10 and engine.view().df.count() == 950
    at = [spark.read.parquet(f.path).selectExpr("count(*) n", "min(struct(series_key, ts_ns)) lo", "max(struct(series_key, ts_ns)) hi").first() for f in files]
    at.sort(key=lambda r: r["lo"])
    assert max(r["n"] for r in at) < 200 and all(a["hi"] < b["lo"] for a, b in zip(at, at[1:]))
    assert not engine.compact_if_due(5)  # they are as few as they can be


def test_streamed_rows_come_in_packs(spark, tmp_path):
    """the rows that a collect gives, for few bytes each."""
    engine = Engine(spark, f"file://{tmp_path}/store")
    value = f"cast(named_struct('t', {{}}Y, 'f', {{}}, 'i', {{}}, 's', {{}}, 'b', {{}}) AS {VALUE.simpleString()})"
    fields = ", ".join(f"'{k}', {value.format(*v)}" for k, v in {"f": (1, "double(id / 4)", "null", "null", "null"), "i": (2, "null", "id", "null", "null"), "n": (0, "null", "null", "null", "null"), "s": (3, "null", "null", "'é'", "null"), "b": (4, "null", "null", "null", "id % 2 = 0")}.items())
    engine.ingest(spark.sql(f"SELECT 'm' metric, IF(id % 5 = 0, cast(map() AS map<string,string>), map('host', concat('h', id % 7))) tags, id ts_ns, map({fields}) fields, id + 1 seq FROM range(1, 20001)"))
    *rows, end = engine.stream("QUERY m FROM 0 TO 30000")
    assert rows == engine.execute("QUERY m FROM 0 TO 30000")["rows"] and end == {"status": "OK", "rows": 20000, "next_cursor": None}
    *rows, end = engine.stream("QUERY m FROM 0 TO 30000 AGGREGATE BY 50ns (avg(f) AS a, avg(absent) AS none) LIMIT 3")
    answer = engine.execute("QUERY m FROM 0 TO 30000 AGGREGATE BY 50ns (avg(f) AS a, avg(absent) AS none) LIMIT 3")
    assert rows == answer["rows"] and rows[0]["none"] is None and end["next_cursor"] == answer["next_cursor"] is not None
    assert [r["rows"] for r in engine.stream("QUERY nothing FROM 0 TO 9")] == [0]
    sent = answers.packed(engine.query(Query("m", {}, 0, 30000))).selectExpr("sum(length(body))").first()[0]
    assert sent < 40 * 20000


def test_rows_to_be_numbered_are_made_once(spark, tmp_path):
    """F5"""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.sql(f"SELECT 300 - id o, 'm' metric, cast(map() AS map<string,string>) tags, id ts_ns, cast(map() AS map<string,{VALUE.simpleString()}>) fields FROM range(300)")
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.ingest(df.mapInArrow(count, df.schema), order=["o"]) == 0
    assert made.value == 300 and engine.view().df.filter("seq + ts_ns = 300").count() == 300


def test_checksums_side_by_side(monkeypatch):
    """as one by one, for parts of all lengths, and only the capture that is broken ends."""
    parts = [bytes((i * 7 + j) % 256 for j in range(n)) for i, n in enumerate([*range(200), 90, 90, 5000, 0, 20000])]
    want = [frames.crc32c(p) for p in parts]
    assert frames.crc32c_all(parts) == want and frames.crc32c_all([]) == []
    monkeypatch.setattr(frames, "ROWS", 70)
    assert frames.crc32c_all(parts) == want
    good = [frames.frame(frames.QUERY, len(t).to_bytes(2) + t) for t in (f"q{i}".encode() for i in range(100))]
    bad = good[2][:-1] + bytes([good[2][-1] ^ 1])
    got = list(frames._read(iter([("a", b"".join(good)), ("b", good[0] + bad + good[1] * 100), ("c", good[5] + b"x"), ("d", b""), ("e", frames.frame(frames.PUSHS, bytes(4)) + good[9])])))
    assert [(r[0], r[1], r[5], r[6]) for r in got[100:]] == [("b", 0, "q0", None), ("b", 1, None, "checksum differs"), ("c", 0, "q5", None), ("c", 1, None, "cut short"), ("e", 1, "q9", None)]
    assert [r[5] for r in got[:100]] == [f"q{i}" for i in range(100)]

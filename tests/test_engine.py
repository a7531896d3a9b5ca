"""Goldens of the engine's semantics: aggregates, windows, versions, tombstones, commands, snapshots, feeds."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.aggregates import AggSpec
from tidemark.hooks import Hooks, outlier_hook, write_amplification
from tidemark.model import MUTATION, PointView, ValidationError, duration_ns, series_key, typed_value
from tidemark.operators import catalog, live, maintenance, monitors
from tidemark.operators.window import downsample, whole_range
from tidemark.plans.commands import parse
from tidemark.plans.query import Query, cache_key, next_cursor, plan
from tidemark.streaming import feed

M = 60 * 10**9
S = 10**9
INF = float("inf")


def log(spark, *points):
    """(metric, tags, ts, fields[, seq[, op]])"""
    rows = []
    for i, (metric, tags, ts, fields, *more) in enumerate(points):
        seq, op = (more + [i + 1, "E"][len(more):])[:2]
        rows.append((seq, op, metric, tags, series_key(metric, tags), ts, {k: typed_value(v) for k, v in fields.items()}))
    return spark.createDataFrame(rows, MUTATION)


def view(spark, *points):
    return PointView(log(spark, *points))


def specs(*texts):
    return [AggSpec(*t.split(":")) for t in texts]


def one(v, *texts, **kw):
    r = whole_range(v, specs(*texts), 0, 1000, **kw).first().asDict()
    return [r[s.name] for s in specs(*texts)]


def same(a, b):
    return all((math.isnan(x) and math.isnan(y)) if isinstance(x, float) and isinstance(y, float) and math.isnan(y) else x == pytest.approx(y) for x, y in zip(a, b, strict=True))


def test_multi_field_aggregate(spark):
    v = view(spark, ("m", {}, 100, {"latency": 50.5, "status": 200, "user": "alice"}), ("m", {}, 200, {"latency": 100.0, "status": 404}), ("m", {}, 300, {"latency": 25.5, "status": 200, "user": "bob"}), ("m", {}, 400, {"status": 500}))
    got = one(v, "avg:latency", "sum:latency", "min:latency", "max:latency", "count:latency", "count:status", "count:user", "count:*")
    assert same(got, [176 / 3, 176.0, 25.5, 100, 3, 4, 2, 4])


def test_empty_and_mixed(spark):
    assert same(one(PointView(spark.createDataFrame([], MUTATION)), "sum:v", "count:*", "min:v"), [0, 0, math.nan])
    v = view(spark, ("m", {}, 1, {"v": 10.0}), ("m", {}, 2, {"v": "no"}), ("m", {}, 3, {"v": 20.0}), ("m", {}, 4, {"o": 1.0}))
    assert same(one(v, "sum:v", "count:v"), [30, 3])


@pytest.mark.parametrize("values, frac, std", [([100.0, "x", 150.0], 0.5, None), ([0.0, 50.0], INF, None), ([0.0, -1.0], -INF, None), ([0.0, 0.0], 0, 0), ([100.0], math.nan, math.nan), ([2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0], 3.5, 2.138089935299395), ([5.0, 5.0, 5.0], 0, 0)])
def test_frac_stddev(spark, values, frac, std):
    v = view(spark, *[("m", {}, i + 1, {"v": x}) for i, x in enumerate(values)])
    got = one(v, "frac:v", "stddev:v")
    assert same(got[:1], [frac]) and (std is None or same(got[1:], [std]))


def test_percentile_and_nonfinite(spark):
    v = view(spark, *[("m", {}, i, {"v": float(i)}) for i in range(1, 21)])
    assert same(one(v, "p50:v", "p95:v", "p100:v:my_max"), [10.5, 19.05, 20])
    bad = view(spark, ("m", {}, 1, {"v": math.nan}), ("m", {}, 2, {"v": INF}), ("m", {}, 3, {"v": 2.0}))
    assert same(one(bad, "sum:v", "max:v", "count:v"), [2, 2, 3])
    w = downsample(view(spark, ("m", {}, 1, {"v": math.nan}), ("m", {}, 2, {"v": 2.0}), ("n", {}, 1, {"v": math.nan})), specs("sum:v", "min:v", "max:v"), 0, 100, 100).orderBy("metric").collect()
    assert math.isnan(w[0]["sum_v"]) and w[0]["max_v"] == 2 and w[1]["min_v"] == INF and w[1]["max_v"] == -INF


def windows(v, start, end, *texts, fill=None, interval=M):
    return {(r["window_start"] // M, r["series_key"][-1]): [r[s.name] for s in specs(*texts)] for r in downsample(v, specs(*texts), start, end, interval, fill=fill).collect()}


def test_windows(spark):
    a, b = {"h": "A"}, {"h": "B"}
    v = view(spark, ("m", a, 10 * S, {"v": 10.0}), ("m", b, 20 * S, {"v": 100.0}), ("m", a, 30 * S, {"v": 20.0}), ("m", b, 70 * S, {"v": 200.0}), ("m", a, 80 * S, {"v": 30.0}))
    assert windows(v, 0, 2 * M, "sum:v") == {(0, "A"): [30], (0, "B"): [100], (1, "A"): [30], (1, "B"): [200]}
    v = view(spark, ("m", a, 10 * S, {"v": 10.0}), ("m", a, 130 * S, {"v": 30.0}))
    got = windows(v, 0, 3 * M, "sum:v", "avg:v", fill="any")
    assert same(got[0, "A"], [10, 10]) and same(got[1, "A"], [0, math.nan]) and same(got[2, "A"], [30, 30]) and len(got) == 3
    v = view(spark, ("m", a, 10 * S, {"v": 10.0}), ("m", b, 70 * S, {"v": 30.0}))
    assert set(windows(v, 0, 4 * M, "sum:v", fill="any")) == {(0, "A"), (1, "B"), (2, "B"), (3, "B")}
    assert set(windows(v, 0, 3 * M, "sum:v", fill="per_series")) == {(0, "A"), (1, "A"), (2, "A"), (1, "B"), (2, "B")}
    v = view(spark, ("m", a, 0, {"v": 1.0}), ("m", a, M, {"v": 2.0}))
    assert windows(v, 0, M, "sum:v") == {(0, "A"): [1]}  # a point at an aligned end is in no window
    with pytest.raises(ValidationError):
        downsample(v, specs("sum:v"), 0, M, 0)


def test_versions_and_tombstones(spark):
    A, B = {"h": "A"}, {"h": "B"}
    ts = lambda df: sorted((r["series_key"][-1], r["ts_ns"], r["seq"]) for r in df.collect())
    assert ts(live.live_view(log(spark, ("m", A, 100, {}, 1), ("m", A, 100, {}, 2, "D")))) == []
    assert ts(live.live_view(log(spark, ("m", A, 100, {}, 2), ("m", A, 100, {}, 1, "D")))) == [("A", 100, 2)]
    assert ts(live.live_view(log(spark, ("m", A, 100, {}, 10), ("m", A, 100, {}, 15)))) == [("A", 100, 15)]
    tombs = spark.createDataFrame([(series_key("m", A), 100)], "series_key string, seq long")
    pts = log(spark, ("m", A, 1, {}, 50), ("m", A, 2, {}, 100), ("m", A, 3, {}, 150), ("m", A, 4, {}, 0), ("m", B, 5, {}, 1))
    assert ts(live.live_view(pts, tombs)) == [("A", 3, 150), ("B", 5, 1)]
    ranges = spark.createDataFrame([(series_key("m", A), *r) for r in ((100, 200, 500), (180, 220, 550), (300, 400, 600))], "series_key string, min_ts long, max_ts long, seq long")
    cases = [(150, 400, 1), (150, 500, 1), (150, 600, 0), (150, 0, 1), (190, 520, 1), (190, 560, 0), (350, 580, 1), (50, 10, 0), (500, 10, 0)]
    for t, seq, hidden in cases:
        assert (ts(live.hide(log(spark, ("m", A, t, {}, seq)), range_tombs=ranges)) == []) == bool(hidden), (t, seq)
    got = maintenance.compact(log(spark, ("a", A, 100, {"v": 1}, 10), ("a", A, 100, {}, 15, "D"), ("a", A, 100, {"v": 3}, 18), ("c", A, 300, {}, 30), ("c", A, 300, {}, 35, "D"))).collect()
    assert [(r["metric"], r["seq"]) for r in got] == [("a", 18)]
    kept = maintenance.retain(log(spark, ("m", A, 1000, {}), ("m", A, 2000, {}), ("m", A, 3000, {})), 5000, 3000)
    assert ts(kept) == [("A", 2000, 2), ("A", 3000, 3)]


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", clock=lambda: 10**15)


def test_commands(engine):
    run = engine.execute
    assert run('PUSH sys.cpu TIME 100 TAGGED (host="a", up=true) SET (v=1, s="x""y", ok=TRUE);')["rows_affected"] == 1
    assert run("PUSHS (sys.cpu TIME 200 TAGGED (host=?) SET (v=?); sys.cpu TIME 300 TAGGED (host='b') SET (v=3.5))", "b", 2.5)["rows_affected"] == 2
    rows = run("QUERY sys.cpu FROM 0 TO 1000")["rows"]
    assert [r["ts_ns"] for r in rows] == [100, 200, 300] and rows[0]["fields"] == {"v": 1, "s": 'x"y', "ok": True}
    assert [r["ts_ns"] for r in run("QUERY sys.cpu FROM 0 TO 1000 ORDER BY TIME DESC LIMIT 2")["rows"]] == [300, 200]
    first = run("QUERY sys.cpu FROM 0 TO 1000 LIMIT 2")
    assert [r["ts_ns"] for r in run(f"QUERY sys.cpu FROM 0 TO 1000 LIMIT 2 AFTER '{first['next_cursor']}'")["rows"]] == [300]
    assert run('QUERY sys.cpu FROM 0 TO 1000 TAGGED (host="b") AGGREGATE (avg(v) AS a, count(*), stddev(s))')["rows"] == [{"window_start": 0, "window_end": 1000, "a": 3.0, "count_*": 2.0, "stddev_s": None}]
    assert run('QUERY sys.cpu FROM 0 TO 1000 TAGGED (host="zz") AGGREGATE (count(*))')["rows"] == []
    assert [r["sum_v"] for r in run("QUERY sys.cpu FROM 0 TO 600 AGGREGATE BY 200ns (sum(v)) EMPTY WINDOWS")["rows"]] == [1, 6, 0]
    assert run("SHOW METRICS")["message"] == "sys.cpu" and run("SHOW TAG KEYS FROM sys.cpu")["message"] == "host\nup"
    assert run("SHOW TAG VALUES WITH KEY = host")["message"] == "a\nb" and run("SHOW TAG VALUES FROM nope WITH KEY = host")["message"] == "(empty set)"
    assert run('REMOVE FROM sys.cpu TAGGED (host="b") AT 200')["rows_affected"] == 1
    assert [r["ts_ns"] for r in run("QUERY sys.cpu FROM 0 TO 1000")["rows"]] == [100, 300]
    assert engine.get("sys.cpu", {"host": "b"}, 300) is not None and engine.get("sys.cpu", {"host": "b"}, 200) is None
    name = run("SNAPSHOT")["path"]
    run('REMOVE SERIES sys.cpu TAGGED (host="b")')
    run('PUSH sys.cpu TIME 400 TAGGED (host="b") SET (v=9)')  # re-created after the delete: visible, tagged or not
    assert [r["ts_ns"] for r in run('QUERY sys.cpu FROM 0 TO 1000 TAGGED (host="b")')["rows"]] == [400]
    run("FLUSH DISK")
    assert [r["ts_ns"] for r in run("QUERY sys.cpu FROM 0 TO 1000")["rows"]] == [100, 400]
    assert not any(engine.verify().values())
    with pytest.raises(ValidationError):
        run(f"RESTORE FROM '{name}'")
    run(f"RESTORE FROM '{name}' WITH OVERWRITE")
    assert [r["ts_ns"] for r in run("QUERY sys.cpu FROM 0 TO 1000")["rows"]] == [100, 300]
    for bad in ("QUERY", "QUERY m FROM 1", "NOPE", "QUERY m LIMIT x", "SHOW TAG VALUES FROM m", "QUERY m AGGREGATE (nope(v))", "QUERY ? FROM 0 TO 1", "CREATE DATABASE system"):
        with pytest.raises(ValidationError):
            run(bad)


def test_snapshots(engine):
    engine.put("m", {}, 1, {"v": 1.0})
    a = engine.snapshot()
    assert engine.snapshot() is None
    engine.put("m", {}, 2, {"v": 2.0})
    b = engine.snapshot()
    assert [s["parent"] for s in engine.store.snapshots()] == [None, a] and engine.store.prune(1) == []
    engine.restore(a, overwrite=True)
    assert [r["ts_ns"] for r in engine.query(Query("m", end=10)).collect()] == [1]
    engine.restore(b, overwrite=True)
    assert [r["ts_ns"] for r in engine.query(Query("m", end=10)).collect()] == [1, 2]


def test_validation_and_hooks(spark, tmp_path):
    said, order, hooks = [], [], Hooks()
    hooks.register("pre_put", outlier_hook([("m", "v", 0, 10)], said.append), 5)
    hooks.register("pre_put", lambda p: order.append("late"), 9)
    hooks.register("pre_put", lambda p: order.append("early"), 1)
    hooks.register("post_put", lambda p: 1 / 0)
    e = Engine(spark, f"file://{tmp_path}/s", hooks=hooks)
    with pytest.raises(ValidationError):
        e.put_batch([("m", {}, 1, {"v": 99}), ("", {}, 1, {}), ("m", {}, 3, {})])
    assert len(said) == 1 and order == ["early", "late"] and e.view().df.count() == 1
    for metric, tags, fields in (("", {}, {}), ("m", {"__r": "x"}, {}), ("m", {}, {"v": [1]}), ("1m", {}, {})):
        with pytest.raises(ValidationError):
            e.put(metric, tags, 1, fields)
    e.put("m", {}, 5, {})
    assert write_amplification(0, 5) == 0 and write_amplification(2, 5) == 2.5


def test_ingest_numbers_rows(engine, spark):
    df = spark.range(100).select(F.lit("m").alias("metric"), F.create_map(F.lit("h"), F.lit("a")).alias("tags"), (F.col("id") % 10).alias("ts_ns"), F.col("id").alias("o"), F.expr("map('v', named_struct('t', 2Y, 'f', cast(null as double), 'i', id, 's', cast(null as string), 'b', cast(null as boolean)))").alias("fields"))
    engine.ingest(df, order=["o"])
    assert engine.seq == 100 and sorted(r["fields"]["v"]["i"] for r in engine.view().df.collect()) == list(range(90, 100))


def test_relative(spark):
    now = 100 * 60 * M
    v = view(spark, ("m", {}, now - 30 * M, {"v": 30}), ("m", {}, now - 90 * M, {"v": 90}), ("m", {}, now + 10 * M, {"v": -10}))
    assert [r["ts_ns"] for r in plan(Query("m", relative="1h"), v, lambda: now).collect()] == [now - 30 * M]
    v = view(spark, ("m", {}, now - 200 * M, {"v": 30}), ("m", {}, now - 230 * M, {"v": 90}))
    assert plan(Query("m", relative="1h"), v, lambda: now).count() == 2  # anchored at the newest point
    w = view(spark, *[("m", {}, now - k * M, {"v": x}) for k, x in ((5, 10), (10, 20), (25, 30), (55, 40), (65, 99))])
    got = plan(Query("m", relative="1h", interval="15m", aggregations=tuple(specs("sum:v", "count:v")), fill="any"), w, lambda: now).collect()
    assert [(r["sum_v"], r["count_v"]) for r in got] == [(40, 1), (0, 0), (30, 1), (30, 2)]


def test_series_and_cache_key(spark):
    v = view(spark, ("cpu", {"h": "A", "r": "e"}, 1, {}), ("cpu", {"h": "B", "r": "e"}, 1, {}), ("mem", {"h": "A", "r": "w"}, 1, {}))
    got = lambda *a: [r[0] for r in catalog.series_by_tags(v, *a).collect()]
    assert got("cpu") == ["cpu\0h=A\1r=e", "cpu\0h=B\1r=e"] and got("", {"h": "A"}) == ["cpu\0h=A\1r=e", "mem\0h=A\1r=w"] and got("x") == [] and got("cpu", {"z": "1"}) == []
    a, b = Query("m", {"a": "1", "b": "2"}, limit=3, after="x"), Query("m", {"b": "2", "a": "1"})
    assert cache_key(a) == cache_key(b) != cache_key(Query("m", {"a": "1"})) and cache_key(b) != cache_key(Query("m", {"b": "2", "a": "1"}, descending=True))
    assert len({cache_key(Query("m", null_undefined=n, approximate=x)) for n in (False, True) for x in (False, True)}) == 4
    assert next_cursor(Query("m", limit=2), [1]) is None
    assert monitors.cardinality(v).orderBy("metric").collect()[0]["n_series"] == 2
    assert [r[0] for r in monitors.new_series(v, v.df.filter("metric = 'cpu'")).collect()] == ["mem\0h=A\1r=w"]


@pytest.mark.parametrize("text, ns", [("1h30m", 90 * M), ("1.5h", 90 * M), ("500ms", 500 * 10**6), ("0", 0), ("-2s", -2 * S), ("1d", None), ("", None), ("5", None)])
def test_durations(text, ns):
    if ns is None:
        with pytest.raises(ValidationError):
            duration_ns(text)
    else:
        assert duration_ns(text) == ns


def test_feed(spark, tmp_path):
    rows = log(spark, ("cpu.usage", {"h": "serverA"}, 1, {"v": 1}), ("cpu.usage", {"h": "x"}, 2, {"v": 1}), ("net", {"h": "serverB"}, 3, {"v": 1}), ("cpu.usage", {"h": "serverA"}, 1, {}, 4, "D"))
    hit = lambda *a: sorted(r["seq"] for r in feed.subscribe(rows, *a).collect())
    assert hit("cpu.usage", {"h": "server*"}) == [1, 4] and hit("cpu*") == [1, 2, 4] and hit("", {"h": "serverB"}) == [3] and hit() == [1, 2, 3, 4] and hit("disk") == []
    assert {r["update_type"] for r in feed.subscribe(rows).collect()} == {"PUT", "DELETE"}
    src, dst = f"file://{tmp_path}/src", f"file://{tmp_path}/dst"
    rows.filter("seq <= 2").write.parquet(src)
    spark.createDataFrame([], MUTATION).write.parquet(dst)
    read = lambda: spark.read.schema(MUTATION).parquet(dst)
    run = lambda: feed.replicate(feed.tail(spark, src, MUTATION), f"file://{tmp_path}/ck", lambda: read().agg(F.max("seq")).first()[0] or 0, lambda df: df.write.mode("append").parquet(dst)).awaitTermination()
    run()
    rows.filter("seq between 2 and 3").write.mode("append").parquet(src)  # 2 comes twice
    run()
    assert sorted(r["seq"] for r in read().collect()) == [1, 2, 3]
    rows.withColumn("seq", F.col("seq") + 10).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="expected seq 4"):
        run()
    assert feed.lag_ns(5, 9) == 0


def test_parse_forms():
    q = parse('QUERY "m" FROM RELATIVE(5m) TAGGED (host="s", region=123, active=true) AGGREGATE BY 1m (avg(a), max(b) AS top)')
    assert q.tags == {"host": "s", "region": "123", "active": "true"} and q.relative == "5m" and q.interval == "1m" and [s.name for s in q.aggregations] == ["avg_a", "top"]
    assert parse("QUERY btc FROM 1h TO now LIMIT 10", now=7200 * S).start == 3600 * S
    assert parse("FLUSH").args == {"what": "ALL"} and parse("CREATE DATABASE IF NOT EXISTS db1").args["name"] == "db1"

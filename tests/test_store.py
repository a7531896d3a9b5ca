"""What lies under the engine: pushdown, ties, files, snapshots, refused rows, the command line, held batches."""

import json

import pytest
from pyspark.sql import functions as F
from test_engine import M, log, specs, view, windows

from tidemark import __main__ as cli
from tidemark.engine import Engine
from tidemark.model import MUTATION, ValidationError
from tidemark.operators import live
from tidemark.operators import window as window_ops
from tidemark.operators.storage import StoredFile, compaction_due, compaction_score, partitions_for
from tidemark.plans.query import Query
from tidemark.sources.store import Store
from tidemark.streaming import feed


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", clock=lambda: 10**15, compression="zstd")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metric_and_tags_are_filtered_before_versions_are_merged(spark, engine):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    engine.put("cpu", {"h": "a"}, 5, {"v": 1})
    said = plan_of(engine.query(Query("cpu", {"h": "a"}, 0, 10)))
    assert "EqualTo(metric,cpu)" in said and "GreaterThanOrEqual(ts_ns,0)" in said
    assert "Join" not in said  # there are no tombstones yet
    below = said[said.index("Aggregate"):]
    assert "tags" in below[: below.index("Scan parquet")] and below.rindex("Filter") > below.rindex("Aggregate")


def test_equal_seqs_fall_alike_in_any_order(spark):
    rows = log(spark, ("m", {}, 1, {"v": 9.0}, 5), ("m", {}, 1, {"v": 3.0}, 5), ("m", {}, 1, {"v": 3.0, "w": 1}, 5))
    got = {live.live_view(rows.orderBy(F.rand(i)).coalesce(1)).first()["fields"]["v"]["f"] for i in range(4)}
    assert len(got) == 1


def test_names_of_windows_own_columns_are_refused(spark):
    for name in ("metric", "window_start", "series_key", "tags"):
        with pytest.raises(ValidationError):
            window_ops.downsample(view(spark, ("m", {}, 1, {"v": 1})), specs(f"sum:v:{name}"), 0, 100, 10)


def test_gaps_over_many_strides(spark, monkeypatch):
    monkeypatch.setattr(window_ops, "STRIDE", 3)
    v = view(spark, ("m", {"h": "A"}, 0, {"v": 1}), ("m", {"h": "B"}, 8 * M, {"v": 2}), ("m", {"h": "A"}, 9 * M, {"v": 2}), ("m", {"h": "B"}, 30 * M, {"v": 2}))
    got = windows(v, 0, 700 * M, "count:*", fill="any")
    assert {w: s for w, s in got} == {w: "A" if w < 8 or 9 <= w < 30 else "B" for w in range(700)}
    got = windows(v, 0, 40 * M, "count:*", fill="per_series")
    assert set(got) == {(w, "A") for w in range(40)} | {(w, "B") for w in range(8, 40)}


def test_refused_rows_are_kept(spark, engine):
    ok = {"v": 1}
    df = log(spark, ("m", {}, 1, ok), ("m", {}, 2, ok), ("m", {"__r": "x"}, 3, ok), ("9 bad", {}, 4, ok), ("m", {"a": "b"}, 5, ok)).withColumn("ts_ns", F.when(F.col("seq") == 2, -1).otherwise(F.col("ts_ns"))).drop("op", "series_key")
    assert engine.ingest(df) == 3 and engine.seq == 5 and engine.view().df.count() == 2
    assert sorted(r["reason"] for r in spark.read.json(f"{engine.store.root}/refused").collect()) == ["invalid metric name", "invalid tag name", "negative time"]
    assert engine.metrics()["refused"] == 3 and engine.ingest(df.limit(0)) == 0


def test_broken_files(spark, engine, tmp_path):
    engine.put("m", {}, 1, {"v": 1})
    bad = tmp_path / "store/mutations/base/part-bad.parquet"
    bad.write_bytes(b"PAR1 nothing PAR1")
    assert engine.verify() == {"unreadable_files": 1}
    assert engine.store.quarantine() == ["part-bad.parquet"] and engine.store.quarantine() == []
    assert engine.view().df.count() == 1 and not any(engine.verify().values())


def test_compaction_when_due(engine):
    for i in range(4):
        engine.put("m", {}, i + 1, {"v": i})
    assert not engine.compact_if_due(4) and engine.compact_if_due(3) and len(engine.store.files()) == 1
    m = engine.metrics()
    assert m["points"] == 4 and m["compactions"] == 1 and m["write_amplification"] > 0 and m["files"] == 1
    assert engine.store.vacuum() and engine.view().df.count() == 4
    files = [StoredFile(str(i), 1 << 20) for i in range(20)]
    assert compaction_due(files) and not compaction_due(files[:16]) and partitions_for(files) == 1 and partitions_for([StoredFile("x", 300 << 20)]) == 3
    assert compaction_score(files, 2) == 21 and compaction_score([StoredFile("x", 200 << 20)], 0) < 0
    with pytest.raises(ValidationError):
        Store(engine.spark, engine.store.root, "brotli")


def test_snapshots_are_checked_and_pruned_by_age(spark, engine, tmp_path):
    engine.put("m", {}, 1, {"v": 1})
    a = engine.snapshot()
    engine.delete_series("m", {})
    b = engine.snapshot()
    assert engine.store.validate(a) == engine.store.validate(b) == [] and engine.store.validate("none")
    first = next(s for s in engine.store.snapshots() if s["name"] == a)["taken_ns"]
    engine.compact()
    assert engine.store.prune(0, older_than_ns=first) == [] and engine.store.prune(1) == []  # b needs a
    for f in (tmp_path / f"store/snapshots/{b}/series_tombs").glob("*.parquet"):
        f.unlink()
    assert engine.store.validate(b) and engine.store.validate(a) == []
    assert set(engine.store.prune(0)) == {a, b}


def test_command_line(engine):
    said = []
    go = lambda *argv: cli.run(engine, _args(*argv), said.append)
    assert go("execute", "PUSH cpu TIME 5 TAGGED (h='a') SET (v=1)") == 0 and go("execute", "NOPE") == 1
    assert go("stream", "QUERY cpu FROM 0 TO 9") == 0 and json.loads(said[-1])["rows"] == 1 and json.loads(said[-2])["fields"] == {"v": 1}
    engine.delete_series("cpu", {"h": "a"})
    engine.delete_range("cpu", {"h": "b"}, 1, 2)
    at = len(said)
    assert go("watch", "c*", "h=*", "--once") == 0
    assert sorted(json.loads(x)["update_type"] for x in said[at:]) == ["DELETE_RANGE", "DELETE_SERIES", "PUT"]
    name = engine.snapshot()
    assert go("snapshots") == 0 and go("validate", name) == 0 and go("verify") == 0 and go("metrics") == 0
    assert json.loads(said[-1])["puts"] == 1


def _args(command, *rest):
    import argparse

    return argparse.Namespace(command=command, rest=[r for r in rest if r[:2] != "--"], once="--once" in rest, overwrite=False)


def test_early_batches_wait(spark, tmp_path):
    rows, src, dst = log(spark, *[("m", {}, i, {"v": i}) for i in range(1, 7)]), f"file://{tmp_path}/src", f"file://{tmp_path}/dst"
    spark.createDataFrame([], MUTATION).write.parquet(dst)
    read = lambda: spark.read.schema(MUTATION).parquet(dst)

    def run(lo, hi):
        rows.filter(f"seq between {lo} and {hi}").write.mode("append").parquet(src)
        feed.replicate(feed.tail(spark, src, MUTATION), f"file://{tmp_path}/ck", lambda: read().agg(F.max("seq")).first()[0] or 0, lambda df: df.write.mode("append").parquet(dst), held=f"file://{tmp_path}/held").awaitTermination()
        return sorted(r["seq"] for r in read().collect())

    assert run(1, 2) == [1, 2] and run(5, 6) == [1, 2] and run(3, 4) == [1, 2, 3, 4, 5, 6]


def test_nothing_is_stored_on_an_executors_own_disk():
    from tidemark.queries import shared_folder

    class Unset:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Unset)

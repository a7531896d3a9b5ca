"""Registered queries that go through the engine: its store, the text commands and points with maps of tags and fields."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.model import MUTATION
from tidemark.plans.query import Query
from tidemark.queries import AGG_SQL, BASIC, CLOCK, DAY, EVENTS, HOUR, IS_3, RAW, T0, _rounded, _spec, registered, shared_folder
from tidemark.sources import frames, tables
from tidemark.sources.store import TABLES
from tidemark.streaming import feed, reorder

#: The newest version of each point of the events table.
LIVE = f"""{EVENTS}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, ts_ns ORDER BY seq DESC) AS rn FROM p) WHERE rn = 1)"""
TAGS_3 = 'event_type="click", user_id="3"'
VALUE = "named_struct('t', {t}Y, 'f', {f}, 'i', {i}, 's', cast(null as string), 'b', cast(null as boolean))"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as metric, tags, ts_ns, fields, seq (from 1)."""
    df = tables.events(spark, sf).df
    value = VALUE.format(t=1, f="value", i="cast(null as bigint)")
    k = VALUE.format(t=2, f="cast(null as double)", i="k")
    return df.select("metric", F.create_map(F.lit("event_type"), "event_type", F.lit("user_id"), "user_id").alias("tags"), "ts_ns", F.expr(f"map('value', {value}, 'k', {k})").alias("fields"), (F.col("seq") + 1).alias("seq"))


def loaded(spark: SparkSession, sf: str) -> Engine:
    """An engine of its own over the whole events table."""
    engine = Engine(spark, shared_folder(spark), clock=lambda: CLOCK, compression="zstd")
    engine.ingest(points(spark, sf))
    return engine


def raw(df: DataFrame) -> DataFrame:
    return df.select("metric", F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"), "ts_ns", F.col("fields")["value"]["f"].alias("value"), F.col("fields")["k"]["i"].alias("k"), (F.col("seq") - 1).alias("seq"))


@registered("engine_query", f"WITH {LIVE} SELECT {RAW} FROM n WHERE event_type = 'click' AND ts_ns BETWEEN {T0 + DAY} AND {T0 + 5 * DAY}")
def engine_query(spark, sf):
    return raw(loaded(spark, sf).query(Query("events", {"event_type": "click"}, T0 + DAY, T0 + 5 * DAY)))


@registered("engine_query_to_now", f"WITH {LIVE} SELECT {RAW} FROM n WHERE user_id = '7' AND ts_ns BETWEEN {T0} AND {CLOCK}")
def engine_query_to_now(spark, sf):
    """An end of 0 is the clock."""
    return raw(loaded(spark, sf).query(Query("events", {"user_id": "7"}, T0)))


@registered("engine_windows_desc", f"""WITH {LIVE} SELECT 'events' AS metric, event_type, user_id, ts_ns - ts_ns % {DAY} AS window_start, {AGG_SQL} FROM n
  WHERE event_type = 'view' AND ts_ns BETWEEN {T0} AND {T0 + 9 * DAY} AND ts_ns - ts_ns % {DAY} < {T0 + 9 * DAY} GROUP BY ALL ORDER BY window_start DESC, user_id DESC LIMIT 60""")
def engine_windows_desc(spark, sf):
    q = Query("events", {"event_type": "view"}, T0, T0 + 9 * DAY, BASIC, "24h", descending=True, limit=60, null_undefined=True)
    out = loaded(spark, sf).query(q).withColumns({t: F.col("tags")[t] for t in ("event_type", "user_id")})
    return _rounded(out.drop("tags", "window_end"))


@registered("engine_aggregate", f"WITH {LIVE} SELECT {T0} AS window_start, {T0 + 30 * DAY} AS window_end, {AGG_SQL}, round(sum(k), 4) AS sum_k FROM n WHERE user_id = '3' AND ts_ns BETWEEN {T0} AND {T0 + 30 * DAY}")
def engine_aggregate(spark, sf):
    return _rounded(loaded(spark, sf).query(Query("events", {"user_id": "3"}, T0, T0 + 30 * DAY, (*BASIC, *_spec("sum:k")), null_undefined=True)))


@registered("approximate_percentiles", f"""WITH {EVENTS} SELECT {T0} AS window_start, {T0 + 30 * DAY} AS window_end, quantile_disc(value, 0.5) AS p50_value, quantile_disc(value, 0.9) AS p90_value
  FROM p WHERE user_id = '3' AND ts_ns BETWEEN {T0} AND {T0 + 30 * DAY}""")
def approximate_percentiles(spark, sf):
    from tidemark.plans.query import plan

    return plan(Query("events", {"user_id": "3"}, T0, T0 + 30 * DAY, _spec("p50:value", "p90:value"), null_undefined=True, approximate=True), tables.events(spark, sf))


@registered("engine_deletes", f"""WITH {LIVE}, f AS (SELECT event_type, user_id, ts_ns FROM n WHERE event_type = 'error' ORDER BY ts_ns, user_id LIMIT 1)
  SELECT {RAW} FROM n WHERE NOT ({IS_3}) AND NOT (event_type = 'view' AND user_id = '7' AND ts_ns BETWEEN {T0 + DAY} AND {T0 + 9 * DAY}) AND (event_type, user_id, ts_ns) NOT IN (SELECT (event_type, user_id, ts_ns) FROM f)""")
def engine_deletes(spark, sf):
    """A series, a range and a point, by text commands."""
    engine = loaded(spark, sf)
    one = engine.query(Query("events", {"event_type": "error"}, 0, T0 + 400 * DAY)).orderBy("ts_ns", F.col("tags")["user_id"]).first()
    engine.execute(f"REMOVE SERIES events TAGGED ({TAGS_3})")
    engine.execute(f'REMOVE FROM events TAGGED (event_type="view", user_id="7") FROM {T0 + DAY} TO {T0 + 9 * DAY}')
    engine.execute(f"REMOVE FROM events TAGGED (event_type='error', user_id=?) AT {one['ts_ns']}", one["tags"]["user_id"])
    return raw(engine.view().df)


@registered("engine_delete_point", f"WITH {LIVE}, f AS (SELECT ts_ns FROM n WHERE {IS_3} ORDER BY ts_ns LIMIT 1) SELECT {RAW} FROM n WHERE NOT ({IS_3} AND ts_ns IN (SELECT ts_ns FROM f))")
def engine_delete_point(spark, sf):
    engine, tags = loaded(spark, sf), {"event_type": "click", "user_id": "3"}
    first = engine.query(Query("events", tags, 0, T0 + 400 * DAY, limit=1)).first()
    engine.delete_point("events", tags, first["ts_ns"])
    return raw(engine.view().df)


@registered("engine_commands", f"""SELECT * FROM (VALUES ('raw', 0, 100::BIGINT, 1.5::DOUBLE, 1), ('raw', 1, 200, 2.5, 2), ('raw', 2, 300, 3.5, 2), ('sum', 0, 0, 6.0, 3), ('window', 0, 0, 1.5, 3), ('window', 1, 200, 6.0, 3), ('page', 0, 300, 3.5, 1)) t(what, i, ts, v, affected)""")
def engine_commands(spark, sf):
    """PUSH, PUSHS with parameters, QUERY in its forms, by text alone, and the cursor of a full page."""
    engine = Engine(spark, shared_folder(spark), clock=lambda: CLOCK)
    one = engine.execute('PUSH cpu TIME 100 TAGGED (host="a") SET (v=1.5, note="x");')["rows_affected"]
    two = engine.execute("PUSHS (cpu TIME 200 TAGGED (host=?) SET (v=?); cpu TIME 300 TAGGED (host='b') SET (v=3.5))", "b", 2.5)["rows_affected"]
    rows = engine.execute("QUERY cpu FROM 0 TO 1000")["rows"]
    out = [("raw", i, r["ts_ns"], r["fields"]["v"], one if i == 0 else two) for i, r in enumerate(rows)]
    tagged = engine.execute("QUERY cpu FROM 0 TO 1000 TAGGED (host='b') AGGREGATE (sum(v) AS s)")["rows"]
    out += [("sum", i, r["window_start"], r["s"], one + two) for i, r in enumerate(tagged)]
    windows = engine.execute("QUERY cpu FROM 0 TO 400 AGGREGATE BY 200ns (sum(v) AS s)")["rows"]
    out += [("window", i, r["window_start"], r["s"], one + two) for i, r in enumerate(windows)]
    cursor = engine.execute("QUERY cpu FROM 0 TO 1000 LIMIT 2")["next_cursor"]
    out += [("page", i, r["ts_ns"], r["fields"]["v"], 1) for i, r in enumerate(engine.execute(f"QUERY cpu FROM 0 TO 1000 LIMIT 2 AFTER '{cursor}'")["rows"])]
    return spark.createDataFrame(out, "what string, i int, ts long, v double, affected int")


@registered("engine_json", f"""WITH {LIVE} SELECT CAST(count(*) AS DOUBLE) AS n, round(sum(value), 4) AS total, CAST(NULL AS DOUBLE) AS nothing, 'ERROR' AS refused FROM n WHERE {IS_3}""")
def engine_json(spark, sf):
    """Answers as JSON text: no NaN, and errors as answers."""
    engine = loaded(spark, sf)
    row = json.loads(engine.execute_json(f"QUERY events FROM 0 TO {T0 + 400 * DAY} TAGGED ({TAGS_3}) AGGREGATE (count(*) AS n, sum(value) AS total, avg(absent) AS nothing)"))["rows"][0]
    refused = json.loads(engine.execute_json("QUERY events FROM 0 TO"))["status"]
    return spark.createDataFrame([(row["n"], round(row["total"], 4), row["nothing"], refused)], "n double, total double, nothing double, refused string")


@registered("engine_stream", f"WITH {LIVE} SELECT CAST(count(*) AS BIGINT) AS streamed, CAST(count(*) AS BIGINT) AS said, CAST(count(DISTINCT ts_ns) AS BIGINT) AS times FROM n WHERE event_type = 'error'")
def engine_stream(spark, sf):
    """Rows as they come, none of them kept, then the end row."""
    streamed, times, at, end = 0, 0, None, {}
    for row in loaded(spark, sf).stream(f"QUERY events FROM 0 TO {T0 + 400 * DAY} TAGGED (event_type='error')"):
        if "status" in row:
            end = row
        else:  # in the order of time
            streamed, times, at = streamed + 1, times + (row["ts_ns"] != at), row["ts_ns"]
    return spark.createDataFrame([(streamed, end["rows"], times)], "streamed long, said long, times long")


@registered("engine_pages", f"WITH {LIVE} SELECT {RAW} FROM n WHERE user_id = '7'")
def engine_pages(spark, sf):
    """All points of a user by pages, each from the cursor of the one before."""
    engine, rows, after = loaded(spark, sf), [], None
    while True:
        answer = engine.execute(f"QUERY events FROM 0 TO {T0 + 400 * DAY} TAGGED (user_id='7') LIMIT 100" + (f" AFTER '{after}'" if after else ""))
        rows += answer["rows"]
        after = answer["next_cursor"]
        if not after:
            break
    flat = [("events", r["tags"]["event_type"], r["tags"]["user_id"], r["ts_ns"], r["fields"]["value"], r["fields"]["k"], r["seq"] - 1) for r in rows]
    return spark.createDataFrame(flat, "metric string, event_type string, user_id string, ts_ns long, value double, k long, seq long")


@registered("engine_get", f"WITH {LIVE}, f AS (SELECT event_type, user_id, ts_ns FROM n ORDER BY ts_ns, event_type, user_id LIMIT 1) SELECT {RAW} FROM n WHERE (event_type, user_id, ts_ns) IN (SELECT (event_type, user_id, ts_ns) FROM f)")
def engine_get(spark, sf):
    engine = loaded(spark, sf)
    first = raw(engine.view().df).orderBy("ts_ns", "event_type", "user_id").first()
    got = engine.get("events", {"event_type": first["event_type"], "user_id": first["user_id"]}, first["ts_ns"])
    return raw(spark.createDataFrame([got], MUTATION))


@registered("engine_show", f"""WITH {EVENTS} SELECT 'metric' AS what, metric AS name FROM p UNION SELECT 'key', unnest(['event_type', 'user_id']) FROM p UNION SELECT 'value', event_type FROM p""")
def engine_show(spark, sf):
    engine = loaded(spark, sf)
    said = [(what, name) for what, text in (("metric", "SHOW METRICS"), ("key", "SHOW TAG KEYS FROM events"), ("value", "SHOW TAG VALUES FROM events WITH KEY = event_type")) for name in engine.execute(text)["message"].split("\n")]
    return spark.createDataFrame(said, "what string, name string")


@registered("engine_snapshot_restore", f"WITH {LIVE} SELECT {RAW} FROM n WHERE NOT ({IS_3})")
def engine_snapshot_restore(spark, sf):
    """A full snapshot, an increment with a delete, a later delete that the restore takes back; the snapshot is validated first."""
    engine = loaded(spark, sf)
    engine.execute("SNAPSHOT")
    engine.execute(f"REMOVE SERIES events TAGGED ({TAGS_3})")
    name = engine.execute("SNAPSHOT")["path"]
    engine.execute('REMOVE SERIES events TAGGED (event_type="view", user_id="7")')
    if engine.store.validate(name):
        raise AssertionError(engine.store.validate(name))
    engine.execute(f"RESTORE FROM '{name}' WITH OVERWRITE")
    return raw(engine.view().df)


@registered("engine_compact", f"WITH {LIVE} SELECT {RAW} FROM n WHERE NOT ({IS_3})")
def engine_compact(spark, sf):
    engine = loaded(spark, sf)
    engine.execute(f"REMOVE SERIES events TAGGED ({TAGS_3})")
    engine.execute("FLUSH DISK")
    if engine.store.read_if_any("series_tombs") is not None:
        raise AssertionError("tombstones stayed")
    return raw(engine.store.read("mutations"))


@registered("engine_verify", "SELECT 0 AS repeated_seqs, 0 AS bad_keys, 0 AS null_keys, 0 AS negative_times, 0 AS unknown_ops, 0 AS unreadable_files")
def engine_verify(spark, sf):
    """The stored files, each opened and decoded."""
    found = loaded(spark, sf).verify()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} int" for k in found))


@registered("engine_ingest_refused", f"""WITH {LIVE} SELECT 'taken' AS reason, CAST(count(*) AS BIGINT) AS n FROM p WHERE k % 3 <> 0 AND event_type <> 'error'
  UNION ALL SELECT 'negative time', count(*) FROM p WHERE k % 3 = 0 AND event_type <> 'error' UNION ALL SELECT 'invalid metric name', count(*) FROM p WHERE event_type = 'error'""")
def engine_ingest_refused(spark, sf):
    """Rows that put would refuse are kept with their reason."""
    engine = Engine(spark, shared_folder(spark), clock=lambda: CLOCK)
    df = points(spark, sf).withColumn("ts_ns", F.when(F.col("fields")["k"]["i"] % 3 == 0, -F.col("ts_ns")).otherwise(F.col("ts_ns")))
    engine.ingest(df.withColumn("metric", F.when(F.col("tags")["event_type"] == "error", "9 bad").otherwise(F.col("metric"))))
    refused = spark.read.json(f"{engine.store.root}/refused").groupBy("reason").agg(F.count("*").alias("n"))
    return engine.store.read("mutations").agg(F.count("*").alias("n")).select(F.lit("taken").alias("reason"), "n").unionByName(refused)


@registered("engine_published", f"WITH {EVENTS} SELECT 'PUT' AS update_type, event_type, CAST(count(*) AS BIGINT) AS n FROM p WHERE user_id = '3' GROUP BY ALL UNION ALL SELECT 'DELETE_SERIES', 'click', 1 UNION ALL SELECT 'DELETE_RANGE', 'view', 1")
def engine_published(spark, sf):
    """What a subscriber of user 3 sees: puts, and the deletes of series and ranges."""
    engine, work = loaded(spark, sf), shared_folder(spark)
    engine.execute(f"REMOVE SERIES events TAGGED ({TAGS_3})")
    engine.execute(f'REMOVE FROM events TAGGED (event_type="view", user_id="3") FROM {T0} TO {T0 + DAY}')
    folders = {t: f[-1] for t, f in engine.store.current().items()}
    changes = feed.tail_all(spark, engine.store.root, folders, TABLES).filter(feed.subscription("events", {"user_id": "3"}))
    out = changes.select("update_type", F.col("tags")["event_type"].alias("event_type"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{work}/out").groupBy("update_type", "event_type").agg(F.count("*").alias("n"))


@registered("live_windows", f"WITH {EVENTS} SELECT metric, ts_ns - ts_ns % {HOUR} AS window_start, count(value) AS n, round(sum(value), 4) AS sum_v, min(value) AS min_v, max(value) AS max_v FROM p GROUP BY ALL")
def live_windows(spark, sf):
    """Hourly windows of the stream of all points, as they stand at its end."""
    engine, work = loaded(spark, sf), shared_folder(spark)
    log = feed.tail(spark, f"{engine.store.root}/{engine.store.current()['mutations'][-1]}", MUTATION)
    windows = feed.live_windows(log, F.col("fields")["value"]["f"], "1 hour", "400 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out")

    windows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(windows.schema).parquet(f"{work}/out")
    return done.select("metric", (F.unix_micros("window.start") * 1000).alias("window_start"), F.col("count").alias("n"), F.round("sum", 4).alias("sum_v"), F.col("min").alias("min_v"), F.col("max").alias("max_v"))


@registered("binary_frames", f"WITH {LIVE} SELECT {RAW} FROM n")
def binary_frames(spark, sf):
    """All points sent as PUSH frames, decoded and loaded in the order of the captures."""
    engine = Engine(spark, shared_folder(spark), clock=lambda: CLOCK)
    sent = frames.encode(points(spark, sf)).select(F.format_string("%020d", "seq").alias("path"), "content")
    engine.ingest(frames.points(frames.decode(sent), CLOCK), order=["path", "frame", "item"])
    return raw(engine.view().df)


def numbered(df: DataFrame, key: str, order: str, folder: str) -> DataFrame:
    """number: from 1 within each key, by range partitions, their counts and the place in each, so that no task sees all rows of a key."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, key, order).sortWithinPartitions(key, order).withColumn("_id", F.monotonically_increasing_id())
    placed.write.parquet(folder)  # the counts and the rows are of one run
    placed = spark.read.parquet(folder).withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part", key).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # a row for each partition and its keys
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), (before + 1 - F.col("_first")).alias("_base"))
    joined = placed.join(F.broadcast(base), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumn("number", F.col("_base") + F.col("_id")).drop("_id", "_part", "_p", "_k", "_base")


@registered("reordered", f"""WITH {EVENTS}, k AS (SELECT event_type, ts_ns, value, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS number FROM p)
  SELECT event_type, number, ts_ns, value FROM k WHERE number <> 9 AND number < coalesce((SELECT min(number) FROM k AS g WHERE g.event_type = k.event_type AND g.number = 9), 9223372036854775807)""")
def reordered(spark, sf):
    """The points of each type, numbered, the ninth lost, in a stream of several batches: what comes out is what precedes it."""
    work = shared_folder(spark)
    rows = numbered(tables.events(spark, sf).df.select("event_type", "seq", "ts_ns", "value"), "event_type", "seq", f"{work}/placed")
    rows = rows.select("event_type", F.col("number").cast("int").alias("number"), "ts_ns", "value").filter("number <> 9")
    rows.repartition(6, F.xxhash64("event_type", "number")).write.parquet(f"{work}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{work}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{work}/in")
    out = reorder.reorder(stream, "event_type", "number", first=1, timeout_ms=None)
    out.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{work}/out")


@registered("follower_bootstrap", f"WITH {LIVE} SELECT {RAW} FROM n WHERE NOT ({IS_3})")
def follower_bootstrap(spark, sf):
    """A follower filled from a snapshot, then fed with the leader's later changes; it ends with no lag."""
    leader, follower, work = loaded(spark, sf), Engine(spark, shared_folder(spark), clock=lambda: CLOCK), shared_folder(spark)
    leader.snapshot()
    begin = feed.bootstrap(leader.store, follower.store)
    leader.execute(f"REMOVE SERIES events TAGGED ({TAGS_3})")
    folder = f"{leader.store.root}/{leader.store.current()['series_tombs'][-1]}"
    last = begin - 1
    feed.replicate(feed.tail(spark, folder, TABLES["series_tombs"], begin), work, lambda: last, lambda df: follower.store.append("series_tombs", df)).awaitTermination()
    if feed.progress(leader.store, follower.store)["behind"]:
        raise AssertionError("the follower is behind")
    return raw(follower.view().df)


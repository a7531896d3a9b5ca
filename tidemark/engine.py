"""The engine object: puts, deletes, queries and maintenance over one store."""

from __future__ import annotations

import json
import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.hooks import Hooks, write_amplification
from tidemark.model import MUTATION, RANGE_TOMB, SERIES_TOMB, PointView, ValidationError, check_metric, check_tag, series_key, series_key_of_map, typed_value
from tidemark.operators import catalog
from tidemark.operators.live import live_points
from tidemark.operators.maintenance import compact, laid_out
from tidemark.operators.select import point_get
from tidemark.operators.storage import StoredFile, compaction_due, partitions_for, violations
from tidemark.plans.answers import packed, rows_of
from tidemark.plans.commands import Admin, Push, Remove, Show, parse
from tidemark.plans.query import Query, next_cursor, plan
from tidemark.sources.store import Store

# The names that a database may have, and may not.
_DATABASE = re.compile(r"[a-zA-Z][a-zA-Z0-9_-]{0,63}$")
RESERVED = ("system", "internal")


class Engine:
    """Single writer: seq is handed out here.  Bulk loads (ingest) bring their own seq or get consecutive ones in a declared order."""

    def __init__(self, spark: SparkSession, root: str, *, clock: Callable[[], int] = time.time_ns, hooks: Hooks | None = None, retention_ns: int = 0, compression: str = "snappy"):
        self.spark, self.store, self.clock, self.hooks, self.retention_ns = spark, Store(spark, root, compression), clock, hooks or Hooks(), retention_ns
        self.seq = self.store.max_seq()
        self.counts: Counter = Counter()  # puts, points, refused, deletes, queries, compactions, snapshots, bytes_read, bytes_written

    def metrics(self) -> dict:
        """What this engine has done since it was made, the files of its log, and its write amplification."""
        files = self.store.files()
        return {**self.counts, "seq": self.seq, "files": len(files), "bytes": sum(f.bytes for f in files), "write_amplification": write_amplification(self.counts["bytes_read"], self.counts["bytes_written"])}

    # writes

    def _next(self) -> int:
        self.seq += 1
        return self.seq

    def put(self, metric: str, tags: dict[str, str], ts_ns: int, fields: dict) -> int:
        return self.put_batch([(metric, tags, ts_ns, fields)])

    def put_batch(self, points: Iterable[tuple]) -> int:
        """Stops at the first bad point, with an error; the points before it stay.  Time 0 is the time of the batch."""
        points, rows, now, bad = self.hooks.pre("put", list(points)), [], self.clock(), None
        for metric, tags, ts, fields in points:
            try:
                check_metric(metric)
                for k, v in tags.items():
                    check_tag(k)
                    if not isinstance(v, str):
                        raise ValidationError(f"tag {k!r} needs a string")
                ts = ts or now
                if ts < 0:
                    raise ValidationError("negative time")
                typed = {k: typed_value(v) for k, v in fields.items()}
            except ValidationError as e:
                bad = e
                break
            rows.append((self._next(), "E", metric, dict(tags), series_key(metric, tags), ts, typed))
        if rows:
            self.store.append("mutations", self.spark.createDataFrame(rows, MUTATION).coalesce(1))
            self.counts.update(puts=1, points=len(rows))
            self.hooks.post("put", points[: len(rows)])
        if bad:
            raise bad
        return len(rows)

    def ingest(self, df: DataFrame, order: list[str] | None = None) -> int:
        """Bulk load of metric, tags, ts_ns, fields and, unless order is given, seq (the caller's, above all earlier ones).

        With order, rows are numbered by those columns: by range partitions, their counts, and a row number inside
        each, so that no task sees all rows.  Ties in order share an arbitrary sequence.  Rows that put would refuse are
        written to refused/ with their reason; returns how many.
        """
        df = df.withColumn("_reason", _refusal())
        if order:
            df = self._numbered(df, order)
        seen = Observation()
        counted = df.observe(seen, F.count(F.when(F.col("_reason").isNull(), 1)).alias("taken"), F.max("seq").alias("top"), F.count("_reason").alias("refused"))
        good = counted.filter("_reason IS NULL").withColumn("series_key", series_key_of_map(F.col("metric"), F.col("tags"))).withColumn("op", F.lit("E"))
        self.store.append("mutations", good)
        taken, top, refused = (seen.get.get(k) for k in ("taken", "top", "refused"))
        if refused:
            self.store.refuse(df.filter("_reason IS NOT NULL").select(F.col("_reason").alias("reason"), "metric", "tags", "ts_ns", "seq"))
        self.seq = max(self.seq, top or 0)
        self.counts.update(puts=1, points=taken, refused=refused)
        return refused

    def _numbered(self, df: DataFrame, order: list[str]) -> DataFrame:
        from pyspark.sql import Window

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # range partitions look at all rows beforehand: what makes the rows runs once, and is read twice
        placed = self.store.staged(df).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
        placed = self.store.staged(placed)  # the counts and the rows are of one run
        placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
        base = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + self.seq + 1).alias("_base"))
        return placed.join(F.broadcast(base), "_part").withColumn("seq", F.col("_base") + F.col("_row"))

    def delete_point(self, metric: str, tags: dict[str, str], ts_ns: int) -> None:
        self.hooks.pre("delete", ("point", metric, tags, ts_ns))
        self.counts["deletes"] += 1
        row = (self._next(), "D", check_metric(metric), dict(tags), series_key(metric, tags), ts_ns, {})
        self.store.append("mutations", self.spark.createDataFrame([row], MUTATION))
        self.hooks.post("delete", ("point", metric, tags, ts_ns))

    def delete_series(self, metric: str, tags: dict[str, str]) -> None:
        self.hooks.pre("delete", ("series", metric, tags))
        self.counts["deletes"] += 1
        self.store.append("series_tombs", self.spark.createDataFrame([(series_key(check_metric(metric), tags), self._next())], SERIES_TOMB))
        self.hooks.post("delete", ("series", metric, tags))

    def delete_range(self, metric: str, tags: dict[str, str], start: int, end: int) -> None:
        """Both ends inclusive; tags are the whole identity of the series."""
        if start > end:
            raise ValidationError("range start after its end")
        self.hooks.pre("delete", ("range", metric, tags, start, end))
        self.counts["deletes"] += 1
        self.store.append("range_tombs", self.spark.createDataFrame([(series_key(check_metric(metric), tags), start, end, self._next())], RANGE_TOMB))
        self.hooks.post("delete", ("range", metric, tags, start, end))

    # reads

    def view(self, metric: str = "", tags: dict[str, str] | None = None) -> PointView:
        """The live points, of a metric and tags if they are given: these reach the scan."""
        s = self.store
        return live_points(s.read("mutations"), s.read_if_any("series_tombs"), s.read_if_any("range_tombs"), metric=metric, tags=tags)

    def get(self, metric: str, tags: dict[str, str], ts_ns: int):
        """The point's row, or None."""
        return point_get(self.view(metric, tags), metric, tags, ts_ns).first()

    def query(self, q: Query) -> DataFrame:
        q = self.hooks.pre("query", q)
        out = plan(q, self.view(q.metric, q.tags), self.clock)
        self.counts["queries"] += 1
        self.hooks.post("query", q)
        return out

    def series_by_tags(self, metric: str = "", tags: dict[str, str] | None = None) -> list[str]:
        return [r[0] for r in catalog.series_by_tags(self.view(metric, tags), metric, tags).collect()]

    # maintenance

    def compact(self, partitions: int | None = None) -> None:
        """Rewrites the log without what is overwritten, deleted or expired, by default into files of 128 MB or POINTS."""
        self.hooks.pre("compact", None)
        s, before = self.store, self.store.files()
        partitions = partitions or self._partitions(before)
        live = compact(s.read("mutations"), s.read_if_any("series_tombs"), s.read_if_any("range_tombs"), now_ns=self.clock(), period_ns=self.retention_ns)
        s.replace(laid_out(live, partitions))
        self.counts.update(compactions=1, bytes_read=sum(f.bytes for f in before), bytes_written=sum(f.bytes for f in s.files()))
        self.hooks.post("compact", None)

    def _partitions(self, files: list[StoredFile]) -> int:
        return partitions_for(files, points=self.store.read("mutations").count())  # by the files' footers

    def compact_if_due(self, most_files: int = 16, small_bytes: int = 16 << 20) -> bool:
        """Compacts once there are more than most_files small files, as many puts leave them, if fewer files can hold their points."""
        files = self.store.files()
        due = compaction_due(files, most_files=most_files, small_bytes=small_bytes) and self._partitions(files) < len(files)
        if due:
            self.compact()
        return due

    def verify(self) -> dict:
        """Violations in the stored files: see operators.storage.violations; and files that cannot be read."""
        bad = [f for t in ("mutations", "series_tombs", "range_tombs") for f in self.store.unreadable(t)]
        return {**violations(self.store.read("mutations")).first().asDict(), "unreadable_files": len(bad)} if not bad else {"unreadable_files": len(bad)}

    def snapshot(self) -> str | None:
        self.hooks.pre("snapshot", None)
        name = self.store.snapshot()
        self.counts["snapshots"] += 1
        self.hooks.post("snapshot", name)
        return name

    def restore(self, name: str | None = None, overwrite: bool = False) -> str:
        name = self.store.restore(name, overwrite)
        self.seq = max(self.seq, self.store.max_seq())
        return name

    def create_database(self, name: str, if_not_exists: bool = False) -> None:
        if not _DATABASE.match(name) or name in RESERVED:
            raise ValidationError(f"invalid database name {name!r}")
        self.spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' if if_not_exists else ''}`{name}`")

    # text

    def execute(self, text: str, *params) -> dict:
        """Runs one text command; results are collected, with NaN and infinities as None, as JSON has neither."""
        now = self.clock()
        cmd = parse(text, *params, now=now)
        if isinstance(cmd, Query):
            rows = self.query(replace(cmd)).collect()
            return {"status": "OK", "rows": [plain_row(r) for r in rows], "next_cursor": next_cursor(cmd, rows)}
        if isinstance(cmd, Push):
            return {"status": "OK", "rows_affected": self.put_batch([(m, t, ts or now, f) for m, t, ts, f in cmd.points])}
        if isinstance(cmd, Remove):
            if cmd.start is None:
                self.delete_series(cmd.metric, cmd.tags)
            else:
                self.delete_range(cmd.metric, cmd.tags, cmd.start, cmd.end)
            return {"status": "OK", "rows_affected": 1}
        if isinstance(cmd, Show):
            view = self.view()
            df = {"metrics": lambda: catalog.show_metrics(view), "tag_keys": lambda: catalog.show_tag_keys(view, cmd.metric), "tag_values": lambda: catalog.show_tag_values(view, cmd.key, cmd.metric)}[cmd.what]()
            return {"status": "OK", "message": "\n".join(sorted(r[0] for r in df.collect())) or "(empty set)"}
        return self._admin(cmd)

    def execute_json(self, text: str, *params) -> str:
        """The answer to one command as JSON text; an error is an answer too."""
        try:
            return json.dumps(self.execute(text, *params), default=str, allow_nan=False)
        except ValidationError as e:
            return json.dumps({"status": "ERROR", "message": str(e)})

    def stream(self, text: str, *params) -> Iterator[dict]:
        """The rows of a QUERY as they come, a partition at a time on the driver and in packs, then one end row with the count and the cursor."""
        cmd = parse(text, *params, now=self.clock())
        if not isinstance(cmd, Query):
            raise ValidationError("only QUERY has rows to stream")
        n, last = 0, None
        for pack in packed(self.query(cmd)).toLocalIterator():
            for row in rows_of(pack["body"]):
                n, last = n + 1, row
                yield row
        yield {"status": "OK", "rows": n, "next_cursor": next_cursor(cmd, [last] * n if n == cmd.limit else [])}

    def _admin(self, cmd: Admin) -> dict:
        if cmd.what == "flush":
            # every put is on disk when it returns, so MEMTABLE has nothing to write; ALL merges files if there are many
            if cmd.args["what"] == "DISK":
                self.compact()
            elif cmd.args["what"] == "ALL":
                self.compact_if_due()
            return {"status": "OK"}
        if cmd.what == "snapshot":
            return {"status": "OK", "message": "snapshot created", "path": self.snapshot()}
        if cmd.what == "restore":
            return {"status": "OK", "path": self.restore(cmd.args["path"] or None, cmd.args["overwrite"])}
        self.create_database(cmd.args["name"], cmd.args["if_not_exists"])
        return {"status": "OK"}


def _refusal() -> Column:
    """Why put would refuse a row of metric, tags, ts_ns; null if it would not.  The names' rules as in the model."""
    name = r"^[_:\p{L}\p{M}][_:.\p{L}\p{M}\p{N}]*$"
    bad_tag = F.exists(F.map_keys("tags"), lambda k: ~k.rlike(name) | k.startswith("__"))
    return (
        F.when(F.col("metric").isNull() | ~F.col("metric").rlike(name), "invalid metric name").when(F.col("tags").isNull() | F.coalesce(bad_tag, F.lit(False)), "invalid tag name")
        .when(F.exists(F.map_values("tags"), lambda v: v.isNull()), "tag without a value").when(F.col("ts_ns").isNull(), "no time").when(F.col("ts_ns") < 0, "negative time").when(F.col("fields").isNull(), "no fields")
    )


def plain_row(row) -> dict:
    def one(v):
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, T.Row) and "t" in v:  # a stored value
            return next((v[c] for c in "fisb" if v[c] is not None), None)
        if isinstance(v, dict):
            return {k: one(x) for k, x in v.items()}
        return v

    return {k: one(v) for k, v in row.asDict().items()}

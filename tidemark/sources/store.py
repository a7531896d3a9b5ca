"""The mutation log on any Hadoop file system: append, read, snapshots.

Layout under a root: mutations/, series_tombs/, range_tombs/ (Parquet, append
only) and manifests/ (one JSON row a version).  A compaction or restore writes
new folders and then a manifest that names them, so readers see all or nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.model import MUTATION, RANGE_TOMB, SERIES_TOMB, ValidationError
from tidemark.operators.storage import StoredFile, readable

TABLES = {"mutations": MUTATION, "series_tombs": SERIES_TOMB, "range_tombs": RANGE_TOMB}
CODECS = ("none", "snappy", "lz4", "zstd")


class Store:
    def __init__(self, spark: SparkSession, root: str, codec: str = "snappy"):
        """codec: of files written from now on; files of any codec are read."""
        if codec not in CODECS:
            raise ValidationError(f"unknown compression {codec!r}")
        self.spark, self.root = spark, root.rstrip("/")
        self.codec = "lz4_raw" if codec == "lz4" else codec

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _ls(self, *parts: str) -> list[str]:
        fs, p = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _put_text(self, text: str, *parts: str) -> None:
        """Written aside and renamed, so that a reader never sees half a file."""
        fs, tmp = self._fs(), self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(tmp, self._path(*parts)):
            raise OSError(f"cannot write {'/'.join(parts)}")

    def _get_text(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self) -> dict:
        """{table: [folders]} of the newest manifest; a fresh store has one folder a table."""
        found = [n for n in self._ls("manifests") if n.endswith(".json")]
        return json.loads(self._get_text("manifests", found[-1])) if found else {t: [f"{t}/base"] for t in TABLES}

    def publish(self, folders: dict) -> None:
        self._put_text(json.dumps(folders), "manifests", f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json")

    def _have(self, table: str, folders: dict | None = None) -> list[str]:
        fs = self._fs()
        return [f"{self.root}/{d}" for d in (folders or self.current())[table] if fs.exists(self._path(d))]

    def read(self, table: str, folders: dict | None = None) -> DataFrame:
        have = self._have(table, folders)
        return self.spark.read.schema(TABLES[table]).parquet(*have) if have else self.spark.createDataFrame([], TABLES[table])

    def read_if_any(self, table: str) -> DataFrame | None:
        """None where nothing was ever written, so that a plan needs no join with it."""
        return self.read(table) if self._have(table) else None

    def append(self, table: str, df: DataFrame) -> None:
        folder = self.current()[table][-1]
        df.select(*TABLES[table].names).write.mode("append").option("compression", self.codec).parquet(f"{self.root}/{folder}")

    def refuse(self, df: DataFrame) -> None:
        """Keeps rows that were not taken, with their reason, under refused/ for a later look."""
        df.write.mode("append").json(f"{self.root}/refused")

    def staged(self, df: DataFrame) -> DataFrame:
        """df written aside and read again, so that plans that use it twice see the same rows; `vacuum` removes it."""
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def files(self, table: str = "mutations") -> list[StoredFile]:
        """The Parquet files that the current manifest names."""
        fs, out = self._fs(), []
        for folder in self.current()[table]:
            p = self._path(folder)
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName().endswith(".parquet"):
                    out.append(StoredFile(s.getPath().toString(), s.getLen()))
        return out

    def unreadable(self, table: str = "mutations") -> list[str]:
        """Files that cannot be decoded.  All are read at once; those that gave no row are then opened one by one, as a file may be empty."""
        listed = {f.path.split("://")[-1].split(":")[-1].replace("//", "/"): f.path for f in self.files(table)}
        if not listed:
            return []
        found = readable(self.spark, list(listed.values()), TABLES[table]).select("path").toLocalIterator()  # a name a file
        good = {r["path"].split("://")[-1].split(":")[-1].replace("//", "/") for r in found}
        return sorted(path for plain, path in listed.items() if plain not in good and not self._opens(path))

    def _opens(self, path: str) -> bool:
        try:
            return self.spark.read.parquet(path).count() == 0
        except Exception:  # the JVM's complaint about a file
            return False

    def quarantine(self, table: str = "mutations") -> list[str]:
        """Moves unreadable files to quarantine/, from where none are read; returns their names."""
        fs, out = self._fs(), []
        for path in self.unreadable(table):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            fs.mkdirs(self._path("quarantine", table))
            if not fs.rename(p, self._path("quarantine", table, p.getName())):
                raise OSError(f"cannot move {path}")
            out.append(p.getName())
        return out

    def vacuum(self) -> list[str]:
        """Deletes folders that neither the newest manifest nor a snapshot names; no query that began before may still run."""
        needed = {f for folders in [self.current(), *[s["folders"] for s in self.snapshots()]] for t in folders.values() for f in t}
        gone = [f"{t}/{d}" for t in TABLES for d in self._ls(t) if f"{t}/{d}" not in needed] + [f"staged/{d}" for d in self._ls("staged")]
        for folder in gone:
            self._fs().delete(self._path(folder), True)
        return gone

    def replace(self, mutations: DataFrame) -> None:
        """The log becomes these mutations, without tombstones."""
        tag = uuid.uuid4().hex
        folders = {t: [f"{t}/{tag}"] for t in TABLES}
        mutations.select(*MUTATION.names).write.option("compression", self.codec).parquet(f"{self.root}/mutations/{tag}")
        self.publish(folders)

    def max_seq(self) -> int:
        """The highest seq of the log and its tombstones, 0 if empty."""
        return max((self.read(t).agg({"seq": "max"}).first()[0] or 0) for t in TABLES)

    # snapshots

    def snapshot(self, name: str | None = None) -> str | None:
        """A full copy, or after the first an increment of what has a higher seq; None if nothing is new."""
        chain, top = self.snapshots(), self.max_seq()
        parent = chain[-1] if chain else None
        if parent and parent["seq"] >= top and parent["folders"] == self.current():
            return None
        after = parent["seq"] if parent and parent["folders"] == self.current() else -1
        name = name or f"{time.time_ns():020d}"
        rows = {}
        for t in TABLES:
            self.read(t).filter(f"seq > {after}").write.option("compression", self.codec).parquet(f"{self.root}/snapshots/{name}/{t}")
            rows[t] = self.read(t, {t: [f"snapshots/{name}/{t}"]}).count()
        entry = {"name": name, "seq": top, "parent": parent["name"] if parent and after >= 0 else None, "folders": self.current(), "rows": rows, "taken_ns": time.time_ns()}
        self._put_text(json.dumps(entry), "snapshots", name, "manifest.json")
        return name

    def snapshots(self) -> list[dict]:
        """Complete snapshots, oldest first; folders without a readable manifest are ignored."""
        out = []
        for name in self._ls("snapshots"):
            try:
                out.append(json.loads(self._get_text("snapshots", name, "manifest.json")))
            except Exception:  # an unfinished or broken snapshot: the JVM's or the JSON's complaint
                continue
        return sorted(out, key=lambda s: (s["seq"], s["name"]))

    def chain(self, name: str) -> list[dict]:
        """The snapshot and its parents, oldest first."""
        by, out = {s["name"]: s for s in self.snapshots()}, []
        while name:
            if name not in by:
                raise ValidationError(f"snapshot {name!r} is missing or broken")
            out.append(by[name])
            name = by[name]["parent"]
        return out[::-1]

    def restore(self, name: str | None = None, overwrite: bool = False) -> str:
        """The log as of a snapshot (default: the newest); only into an empty store unless overwrite."""
        known = self.snapshots()
        if not known:
            raise ValidationError("there is no snapshot")
        name = name or known[-1]["name"]
        parts = self.chain(name)
        if not overwrite and self.max_seq() > 0:
            raise ValidationError("the store is not empty; restore WITH OVERWRITE")
        self.publish({t: [f"snapshots/{p['name']}/{t}" for p in parts] + [f"{t}/{uuid.uuid4().hex}"] for t in TABLES})
        return name

    def validate(self, name: str) -> list[str]:
        """What is wrong with a snapshot and those that it is built on; empty if it can be restored."""
        try:
            parts = self.chain(name)
        except ValidationError as e:
            return [str(e)]
        wrong = []
        for p in parts:
            for t, n in p.get("rows", {}).items():
                try:
                    table = self.read(t, {t: [f"snapshots/{p['name']}/{t}"]})
                    found, top = table.selectExpr("count(*)", "coalesce(max(seq), 0)", f"max(hash({', '.join(c for c in table.columns if c not in ('tags', 'fields'))}))").first()[:2]
                except Exception as e:  # the JVM's complaint about a file
                    wrong.append(f"{p['name']}/{t}: {str(e).splitlines()[0]}")
                    continue
                if found != n:
                    wrong.append(f"{p['name']}/{t}: {found} rows instead of {n}")
                if top > p["seq"]:
                    wrong.append(f"{p['name']}/{t}: seq {top} beyond {p['seq']}")
        return wrong

    def prune(self, keep: int, older_than_ns: int | None = None) -> list[str]:
        """Drops all but the newest keep snapshots, and what those are built on or the current log reads; with older_than_ns, only such as were taken before that time."""
        known = self.snapshots()
        stay = known[max(0, len(known) - keep):] + [s for s in known if older_than_ns is not None and s.get("taken_ns", 0) >= older_than_ns]
        needed = {p["name"] for s in stay for p in self.chain(s["name"])}
        needed |= {f.split("/")[1] for folders in self.current().values() for f in folders if f.startswith("snapshots/")}
        gone = [s["name"] for s in known if s["name"] not in needed]
        for name in gone:
            self._fs().delete(self._path("snapshots", name), True)
        return gone

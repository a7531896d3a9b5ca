"""WARC archives as a PySpark data source, and pages written as responses and revisits.

Writing: a task writes one file of gzip members, one a record; each member says its own size in an
extra field, so that readers step over it unread.  The driver's commit lists the files that belong to
the archive, with places at which they can be split; what failed attempts leave is in no list.

Reading: partitions are ranges of files between such places.  Filters on the record type and on header columns
are pushed down.  Of each record the first bytes are inflated until its headers end; if a filter rejects it, or
the schema asks for no payload, the rest is skipped.  Archives of others work too: members without the field are
inflated to find their end, plain .warc files are stepped through by Content-Length, and a folder without list is
read file by file.

Null payloads count as empty.  Pages with equal payloads (by SHA-1) are revisits of the one with the smallest id;
equal ids are one page, rows without id count as larger than any.  An empty table gives an archive without records.  A very long payload
is one record, held once in its task.  Other columns of pages are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.llm.common import shared_folder, stored, utf8

#: Compressed bytes between places where a file can be split.
SPLIT = 8 << 20
#: Column and header, of columns that filters are pushed down for.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary"
LIST = "_files.json"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """A gzip member whose extra field sl holds the sizes of the member and of the record."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    data = deflate.compress(record) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(data) + 8, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _line(value: str) -> str:
    """A header value: no line break may end it early."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(row: dict) -> bytes:
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.get('payload_length') or len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z"),
              ("WARC-Payload-Digest", row.get("payload_digest")), ("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", _PROFILE if revisit else None),
              ("X-Payload-Length", str(row["payload_length"]) if row.get("payload_length") is not None else None), ("Content-Type", row.get("content_type") or "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Headers of a record by lower-case name; the first line must be the version."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Members:
    """Steps through a file: the head of each record, and its block only when asked."""

    def __init__(self, file, start: int, end: int, gz: bool):
        self.file, self.at, self.end, self.gz = file, start, end, gz

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __iter__(self) -> Iterator[tuple[dict[str, str], callable]]:
        while self.at < self.end:
            if self.gz:
                yield from self._member()
            else:
                yield from self._plain()

    def _plain(self):
        head = b""
        while b"\r\n\r\n" not in head:
            more = self._read(self.at + len(head), 4096)
            if not more:
                if head.strip():
                    raise ValueError("the archive ends inside a header")
                self.at = self.end
                return
            head += more
        n = head.index(b"\r\n\r\n")
        fields = parse_head(head[:n])
        begin, length = self.at + n + 4, int(fields["content-length"])
        self.at = begin + length + 4
        yield fields, lambda: self._read(begin, length)

    def _member(self):
        first = self._read(self.at, 65536)
        size = None
        if first[3:4] == b"\x04" and first[12:14] == b"sl":
            size = struct.unpack("<I", first[16:20])[0]
        inflate = zlib.decompressobj(31)
        out, rest, at, got = b"", first if size is None else first[:size], self.at, min(len(first), size or len(first))
        while b"\r\n\r\n" not in out and not inflate.eof:
            out += inflate.decompress(rest, 8192)
            rest = inflate.unconsumed_tail
            if not rest and b"\r\n\r\n" not in out and not inflate.eof:
                rest = self._read(at + got, 65536)
                got += len(rest)
                if not rest:
                    raise ValueError("the archive ends inside a header")
        n = out.index(b"\r\n\r\n")
        fields = parse_head(out[:n])
        state = {"out": out, "rest": rest, "got": got}

        def inflated() -> bytes:
            parts = [state["out"]]
            rest, got = state["rest"], state["got"]
            while not inflate.eof:
                if not rest:
                    rest = self._read(at + got, 1 << 20 if size is None else max(1, min(1 << 20, size - got)))
                    got += len(rest)
                    if not rest:
                        raise ValueError("the archive ends inside a record")
                parts.append(inflate.decompress(rest))
                rest = b""
            state["got"], state["out"], state["rest"] = got, b"".join(parts), b""
            return state["out"]

        def block() -> bytes:
            return inflated()[n + 4 : n + 4 + int(fields["content-length"])]

        yield fields, block
        if size is None:  # its end shows only when it has been inflated
            inflated()
            self.at = at + state["got"] - len(inflate.unused_data)
        else:
            self.at = at + size


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.tests = schema, options, []

    def pushFilters(self, filters):
        """Takes tests of header columns; gives the others back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, row: dict) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            if v is None or (isinstance(f, EqualTo) and v != f.value) or (isinstance(f, In) and v not in f.value) or (isinstance(f, StringStartsWith) and not v.startswith(f.value)):
                return False
        return True

    def partitions(self):
        path = self.options["path"]
        fs, root = _fs(path)
        from pyarrow.fs import FileSelector, FileType

        info = fs.get_file_info(root)
        if info.type == FileType.File:
            return [Range(path, 0, info.size)]
        if fs.get_file_info(f"{root}/{LIST}").type == FileType.File:
            with fs.open_input_file(f"{root}/{LIST}") as f:
                files = json.loads(f.read())
        else:
            files = [{"file": i.base_name, "places": [0, i.size]} for i in fs.get_file_info(FileSelector(root)) if i.base_name.endswith((".warc", ".warc.gz"))]
        return [Range(f"{path}/{f['file']}", a, b) for f in files for a, b in zip(f["places"], f["places"][1:]) if b > a]

    def read(self, part):
        if part is None:
            return
        fs, path = _fs(part.file)
        names = [f.name for f in self.columns.fields]
        decode, verify = "payload" in names, self.options.get("verify", "false").lower() == "true"
        kinds = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in self.columns.fields])
        rows, size = [], 0
        with fs.open_input_file(path) as file:
            for fields, block in Members(file, part.start, part.end, part.file.endswith(".gz")):
                row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
                if not self._passes(row):
                    continue
                row["content_length"] = int(fields["content-length"])
                if decode:
                    row["payload"] = body = payload_of(fields, block())
                    if verify and row["record_type"] == "response" and row["payload_digest"] not in (None, digest(body)):
                        raise ValueError(f"payload of {row['record_id']} does not match its digest")
                    size += len(body)
                rows.append({c: row[c] for c in names})
                size += 500
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, or the block of other records."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Written(WriterCommitMessage):
    file: str
    places: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator):
        path = self.options["path"]
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"  # another attempt writes another file
        places, at = [0], 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for start in range(0, batch.num_rows, 64):
                    for row in batch.slice(start, 64).to_pylist():
                        data = member(record(row))
                        out.write(data)
                        at += len(data)
                        if at - places[-1] >= SPLIT:
                            places.append(at)
        return Written(name, places + [at] if places[-1] != at else places)

    def commit(self, messages):
        path = self.options["path"]
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        from pyarrow.fs import FileType

        files = []
        if not self.overwrite and fs.get_file_info(f"{root}/{LIST}").type == FileType.File:
            with fs.open_input_file(f"{root}/{LIST}") as f:
                files = json.loads(f.read())
        files += [{"file": m.file, "places": m.places} for m in messages if m is not None and len(m.places) > 1]
        with fs.open_output_stream(f"{root}/.{LIST}") as f:
            f.write(json.dumps(files).encode())
        fs.move(f"{root}/.{LIST}", f"{root}/{LIST}")

    def abort(self, messages):
        """Files of no list are never read."""


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); options: verify (payloads against their digests).  A schema of fewer columns reads less."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows for the writer: each page a response, or a revisit of the page with the smallest id and an equal payload of at least least_bytes."""
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), utf8(html_col).alias("payload"))
    page = page.withColumn("sha", F.sha1("payload")).withColumn("payload_length", F.length("payload"))
    # plain tables on both sides: Spark can split a payload that many pages have
    first = stored(page.filter(F.col("payload_length") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first")), "first")
    named = page.join(first.withColumnRenamed("sha", "_sha"), F.col("sha") == F.col("_sha"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return named.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("id").alias("record_id"), "target_uri", F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("string").alias("content_type"), _base32(F.col("sha")).alias("payload_digest"), F.when(revisit, urn("first")).alias("refers_to"),
        F.col("payload_length").cast("string").alias("payload_length"), F.lit(None).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(hex_digest):
    """sha1: and the digest in base 32: each five of its 160 bits a letter."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(F.lit("sha1:"), *[F.substring(F.lit(letters), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)])


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Writes the pages' records; returns the archive's folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_folder(spark, "warc")
    records(pages, least_bytes=least_bytes).write.format("warc").mode("append").save(path)
    return path


def contents(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest (bare), record_type, refers_to of each record: payloads of responses are decoded and checked, revisits give their headers alone."""
    register(spark)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(id_type)
    head = "record_type string, record_id string, payload_digest string, refers_to string, payload_length string"
    read = spark.read.format("warc").option("verify", "true")
    full = read.schema(f"{head}, payload binary").load(path).filter("record_type = 'response'").withColumn("n", F.length("payload").cast("long"))
    brief = read.schema(head).load(path).filter("record_type = 'revisit'").withColumn("n", F.col("payload_length").cast("long"))
    both = full.drop("payload").unionByName(brief)
    return both.select(page("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))

"""Line deduplication: a line goes if an earlier one equals it, or is one word edit away.

Lines are compared by their words (split at ASCII white space); lines without words are never
touched.  Earlier means a smaller (doc_id, line number); an id that comes twice is one
document, ids of null come last.  A line of `min_words` words or more also goes if any earlier line,
kept or not, differs in one word inserted, deleted or replaced; the earlier one may be a word shorter than `min_words`.
Lines of fewer words only go if they equal an earlier one.

Equal lines are found by two 64-bit hashes, rows of one id are told apart by a hash of their text.  The near ones by a deletion-neighbourhood join of
distinct lines: each line emits its hash without word i, for all i, as key (hash, i), and (hash) alone, and
its own hash; lines of `min_words` - 1 words, which only others can be near to, emit their own hash alone.  Lines that share (hash, i) differ in word i alone; a line whose own hash is another's
hash without a word lacks that word.  So the earliest line of a key is within the bound of all
others, and only it is linked: a million lines of one template make a million links and not their square.  Links are
verified on the words.  Beforehand, lines that share neither their first nor their last half
with another one of about their length are left out: one edit leaves one of the halves as it is.

Null texts stay null; an empty table gives an empty one.  Other columns are kept as they are, whatever their names.  Equal lines at
one place of rows with one id are one line.  A very long text costs as many rows as it has lines, a very long line as many keys as it has words.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Sieve, discard, named, slices, stored

MOD, BASE = (1 << 61) - 1, 0x1F3D5B79A8C6E421
INVERSE = pow(BASE, -1, MOD)
#: Keys that a task emits at a time.
EMITTED = 200_000


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = named(text_col)
    return docs.select(named(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text_hash, line_no, line, words of each line that has a word."""
    return _split(docs, id_col, text_col).withColumn("words", _words(F.col("line"))).filter(F.size("words") > 0)


def _half_keys(min_words: int) -> Column:
    """Hashes of the first and of the last k words, for a line of 2k + 1 words, and of k and of k - 1 words for one of 2k.

    Lines of 2k, 2k + 1 and 2k + 2 words have k in common, so any two whose lengths differ by one at most share it.
    """
    n = F.size("words")
    k = F.floor(n / 2).cast("int")
    of = lambda k: [F.xxhash64(k, F.lit(0), F.slice("words", F.lit(1), k)), F.xxhash64(k, F.lit(1), F.slice("words", n - k + 1, k))]
    return F.when(n >= min_words - 1, F.when(n % 2 == 1, F.array(*of(k))).otherwise(F.array(*of(k), *of(k - 1))))


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, deleted or replaced makes a of b; true for equal ones."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def neighbourhood(words: list[bytes], min_words: int = 0) -> Iterator[tuple[int, int]]:
    """(kind, key): 0 without word i and i, 1 without word i, 2 the whole; rolling, so linear in the words, of which it keeps 8 bytes each.  Of fewer than min_words words the whole only."""
    h = array("Q", (xxhash.xxh64_intdigest(w) % MOD for w in words))
    n = len(h)
    whole = 0
    for x in h:
        whole = (whole * BASE + x) % MOD
    yield 2, hash((whole, n))
    if n < min_words:
        return
    without, before, power = whole, 0, pow(BASE, n - 1, MOD)
    for i, x in enumerate(h):
        without = (without + (before - x) * power) % MOD  # the word before comes back where this one goes
        yield 0, hash((without, n, i))
        if i == 0 or x != before:  # dropping any word of a run gives the same line
            yield 1, hash((without, n - 1))
        before = x
        power = power * INVERSE % MOD


def emitted(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """key, kind, id of lines (id, line), EMITTED rows at a time at most, within a line as well."""
    for part in slices(batches):
        ids, kinds, keys = [], [], []
        for i, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            for kind, key in neighbourhood(line.split(), min_words):
                ids.append(i)
                kinds.append(kind)
                keys.append(key)
                if len(ids) >= EMITTED:
                    yield _keys(keys, kinds, ids)
                    ids, kinds, keys = [], [], []
        yield _keys(keys, kinds, ids)


def duplicate_lines(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text_hash (of the whole text, which tells rows of one id apart), line_no, near (false: equal to an earlier line) of every line that goes.

    One plan at every size: all joins are by key, and a `Sieve` of fixed size keeps back rows that have no partner.
    """
    found = lines(docs, id_col, text_col)
    h = F.struct(F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))
    pos = F.struct(F.col("doc").isNull().alias("none"), "doc", "line_no")
    seen = stored(found.select("doc", "text_hash", "line_no", h.alias("h"), _half_keys(min_words).alias("halves")).select("doc", "text_hash", "line_no", "h.*", "halves"), "lines")
    first = stored(seen.groupBy("h1", "h2").agg(F.min(pos).alias("first"), F.min_by("text_hash", pos).alias("text_hash"), F.first("halves").alias("halves"), F.count("*").alias("n")), "first")

    # distinct lines that share a half with another; a line emits a half once, so a count tells, and what one hash names too much is no link later
    halves = first.select("h1", F.explode("halves").alias("half"))
    shared = stored(halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"), "shared")
    sharing = stored(Sieve(shared, "half").passed(halves, "half").join(shared, "half", "left_semi").select("h1").distinct(), "sharing")
    alike = Sieve(sharing, "h1").passed(first.select("h1", "h2", "first", "text_hash"), "h1").join(sharing, "h1", "left_semi")
    at = stored(alike.select("h1", "h2", F.col("first.doc").alias("_doc"), F.col("first.line_no").alias("_line"), "first", F.col("text_hash").alias("_hash")), "alike")
    discard(shared, sharing)
    # a line is known by its place, without splitting all lines into words again
    split = Sieve(at, "_doc", "_line", "_hash").passed(_split(docs, id_col, text_col), "doc", "line_no", "text_hash")
    texts = split.join(at, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("line_no") == F.col("_line")) & (F.col("text_hash") == F.col("_hash")))
    # ids in the order of the lines; written before use, so that they hold; equal rows of one id give equal lines
    texts = texts.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.first("line").alias("line"))
    texts = stored(texts.orderBy("first").select(F.monotonically_increasing_id().alias("id"), "h1", "h2", F.col("line").cast("binary").alias("line")), "alike_lines")
    discard(at)

    keys = stored(texts.select("id", "line").mapInArrow(lambda batches: emitted(batches, min_words), "key long, kind byte, id long"), "neighbourhoods")
    whole = F.col("kind") == 2
    least = keys.groupBy("key").agg(F.min(F.when(~whole, F.col("id"))).alias("variant"), F.min(F.when(whole, F.col("id"))).alias("whole"), F.count("*").alias("n"))
    least = stored(least.filter("n > 1"), "least")  # plain tables on both sides, so that Spark can split a key of many lines
    partner = F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("variant"))
    links = Sieve(least, "key").passed(keys, "key").join(least, "key").withColumn("partner", partner).filter("partner < id").select("id", "partner").distinct()
    pairs = links.join(texts.select("id", "h1", "h2", "line"), "id").join(texts.select(F.col("id").alias("partner"), F.col("line").alias("other")), "partner")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            both = [(a.split(), b.split()) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            ok = [len(a) >= min_words and one_edit(a, b) for a, b in both]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["h1", "h2"]).filter(pa.array(ok, pa.bool_()))

    near = stored(pairs.select("h1", "h2", "line", "other").mapInArrow(verified, "h1 long, h2 long").distinct().withColumn("near", F.lit(True)), "near")
    discard(keys, least, texts)
    # equal lines that come once need no look-up; the others' first places are joined by hash
    judged = Sieve(near, "h1").mark(first.select("h1", "h2", "first", "n"), "maybe", "h1").filter("n > 1 OR maybe")
    judged = judged.join(near, ["h1", "h2"], "left").filter("n > 1 OR near").select("h1", "h2", "first", F.col("near").isNotNull().alias("near"))
    judged = stored(judged, "judged")
    discard(near, first)
    mine = Sieve(judged, "h1", "h2").passed(seen.select("doc", "text_hash", "line_no", "h1", "h2"), "h1", "h2").join(judged, ["h1", "h2"])
    is_first = pos.eqNullSafe(F.col("first"))
    gone = stored(mine.filter(F.col("near") | ~is_first).select("doc", "text_hash", "line_no", is_first.alias("near")), "gone")
    discard(judged, seen)
    return gone


def _keys(keys: list[int], kinds: list[int], ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int8()), pa.array(ids, pa.int64())], ["key", "kind", "id"])


def dedup_lines(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """The rows with their texts less the lines that go; with report, also n_lines, n_equal, n_near and emptied (it had words, and has none left).

    Only texts that lose a line, and a few others by the sieve's rate, meet their lists in a shuffle; the others pass by.
    """
    tag = uuid.uuid4().hex[:8]  # of column names that no table has
    may, doc, text_hash, drop = (f"{n}_{tag}" for n in ("may", "doc", "hash", "drop"))
    gone = duplicate_lines(docs, min_words, id_col, text_col)
    lists = gone.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("line_no", "near")).alias(drop))  # at most a document's lines
    lists = stored(lists.withColumnsRenamed({"doc": doc, "text_hash": text_hash}), "lists")
    discard(gone)
    at = docs.columns.index(text_col)
    own, text = [named(c) for c in docs.columns], named(text_col)
    extra = {"n_lines": "long", "n_equal": "long", "n_near": "long", "emptied": "boolean"}
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    marked = Sieve(lists, doc, text_hash).mark(docs, may, named(id_col), F.xxhash64(text))
    untouched = marked.filter(~F.col(may)).select(*own, n_lines.alias(f"n_lines_{tag}"), *[F.lit(0).cast(kind).alias(f"{n}_{tag}") for n, kind in list(extra.items())[1:]])
    touched = marked.filter(may).join(lists, named(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(text_hash)), "left").select(*own, drop)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, n_lines, n_equal, n_near, emptied = [], [], [], [], []
            for text, dropped in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                how = {d["line_no"]: d["near"] for d in dropped or ()}
                parts = text.split("\n") if text is not None else []
                if how:
                    text = "\n".join(line for i, line in enumerate(parts) if i not in how)
                texts.append(text)
                n_lines.append(len(parts))
                n_near.append(sum(how.values()))
                n_equal.append(len(how) - n_near[-1])
                emptied.append(bool(how) and not text.encode().split())
            columns = list(part.columns[:-1])
            columns[at] = pa.array(texts, part.schema.field(at).type)
            more = [pa.array(n_lines, pa.int64()), pa.array(n_equal, pa.int64()), pa.array(n_near, pa.int64()), pa.array(emptied, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*part.schema.names[:-1], *[f"{n}_{tag}" for n in extra]])

    places = [f"c{i}" for i in range(len(own))]  # columns by place, whatever their names
    schema = T.StructType([T.StructField(p, f.dataType, f.nullable) for p, f in zip(places, docs.schema.fields)])
    for n, kind in extra.items():
        schema = schema.add(f"{n}_{tag}", kind)
    out = touched.toDF(*places, drop).mapInArrow(cut, schema).unionAll(untouched)
    back = [F.col(p).alias(c) for p, c in zip(places, docs.columns)]
    return out.select(*back, *([F.col(f"{n}_{tag}").alias(n) for n in extra] if report else []))


def without_repeats(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """The rows with their texts less repeated lines; a row of which nothing is left goes."""
    out = dedup_lines(docs, min_words, report=True)
    places = [f"c{i}" for i in range(len(out.columns))]  # by place, as a column of the table may have a name of the report
    kept = out.toDF(*places).filter(~F.col(places[-1]))
    return kept.select(*[F.col(p).alias(c) for p, c in zip(places, docs.columns)])

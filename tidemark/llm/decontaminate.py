"""Benchmark decontamination over a distributed positional inverted index.

The corpus is read once.  Each block of documents (bounded bytes, laid end to end with a gap between them) stores a
posting list for each of its terms: the positions at which it stands, packed.  The index is a table in the
shared folder, so that further test sets don't read the corpus again.

A search joins the index with the terms of the test set, which are broadcast in blocks of bounded bytes, so that only
their lists are shuffled, and adds up their counts over the corpus.  The lists of a block meet in a task: a phrase
starts from the list of its rarest term of the corpus; the lists of its other terms, rarest first, are intersected with it after
the terms' offsets are taken off, and an empty intersection ends the phrase.  What is left are the exact starts.
Lists of a frequent term are cut by block, so none is long, and a block's lists are bounded by its bytes (or one text).

Proximity: the same lists, with up to `slop` further words between neighbouring terms.

The test set is read in blocks of bounded text, each broadcast, so that it may outgrow
a task's memory.  Null and empty texts have no words and no hits; items without words
match nothing; repeated rows are each answered; an empty table gives an empty one, and with an empty test set nothing is hit.
Other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named, rows_without, slices, stored, utf8

#: Bytes of test text that one block of the test set may have.
BLOCK_BYTES = 16 << 20
#: Places that are intersected at a time.
ROUND = 4_000_000
#: Bytes of text that are indexed at a time.
INDEX_BYTES = 16 << 20
#: Lower-case letters, digits and bytes of non-ASCII characters are words; other ASCII separates them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """Distinct phrases of a block of the test set, as term numbers, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.terms: dict[bytes, int] = {}
        by: dict[tuple[int, ...], set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                by.setdefault(tuple(ids[at : at + window]), set()).add(k)
        self.order: dict[int, np.ndarray] = {}
        # by length: the phrases as rows, and the items of each
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(p) for p in by}):
            self.by_length[n] = np.array([p for p in by if len(p) == n], np.int64), [sorted(o) for p, o in by.items() if len(p) == n]

    def by_rarity(self, counts: np.ndarray) -> None:
        """order: for each length, the places of each phrase's terms, the rarest of the corpus first."""
        self.order = {n: np.argsort(counts[rows], axis=1, kind="stable") for n, (rows, _) in self.by_length.items()}


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value in as many bytes of seven bits as it needs, the last one below 128; all bytes, and each value's number of them."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        some = size > k
        out[at[some] + k] = values[some] >> 7 * k & 127 | np.where(size[some] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The values of packed."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    nth = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * nth, starts)


class Postings:
    """Positions by term in a block of documents, of terms numbered from 0 on."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, n_terms: int, size: int):
        """terms: those that the block has, with their counts; positions: theirs, one term after the other."""
        order = np.argsort(np.repeat(terms, counts), kind="stable")
        self.positions, self.size = positions[order], size
        by = np.zeros(n_terms, np.int64)
        by[terms] = counts
        self.bounds = np.concatenate([[0], np.cumsum(by)])

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term] : self.bounds[term + 1]]

    def exact(self, phrases: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) of every match of the rows of phrases, terms of equally long ones; all phrases step together.

        order: the places of each phrase's terms, the rarest in the corpus first.
        """
        counts = np.diff(self.bounds)
        rarest = np.take_along_axis(counts[phrases], order[:, :1], 1)[:, 0]
        alive = np.flatnonzero(rarest)
        keys = np.repeat(np.arange(len(counts)), counts) * self.size + self.positions  # sorted: all lists as one
        # rounds of bounded size
        rounds = np.cumsum(rarest[alive]) // ROUND
        for r in np.unique(rounds):
            rows = alive[rounds == r]
            n = rarest[rows]
            which = np.repeat(rows, n)
            first = order[which, 0]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = self.positions[self.bounds[phrases[which, first]] + nth] - first
            fits = starts >= 0
            which, starts = which[fits], starts[fits]
            for step in range(1, phrases.shape[1]):
                k = order[which, step]
                want = phrases[which, k] * self.size + starts + k
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                which, starts = which[hit], starts[hit]
                if not len(which):
                    break
            yield which, starts

    def near(self, phrase: np.ndarray, slop: int) -> np.ndarray:
        """(start, end) of the tightest match around each place of the rarest term: every term in order, at most slop words apart from the one before."""
        sizes = self.bounds[phrase + 1] - self.bounds[phrase]
        if not sizes.min():
            return np.zeros((0, 2), np.int64)
        rare = int(np.argmin(sizes))
        # sets of reachable positions, from the rarest term to both ends: greedy choices could miss a match
        out = []
        for p in self.of(phrase[rare]):
            ends = []
            for step, rest in ((-1, phrase[:rare][::-1]), (1, phrase[rare + 1 :])):
                at = np.array([p])
                for term in rest:
                    held = self.of(term)
                    lo, hi = (at - 1 - slop, at) if step < 0 else (at + 1, at + 2 + slop)
                    i, j = np.searchsorted(held, lo), np.searchsorted(held, hi)
                    at = np.unique(np.concatenate([held[a:b] for a, b in zip(i, j)]))
                    if not len(at):
                        break
                ends.append(at)
            if len(ends[0]) and len(ends[1]):
                out.append((ends[0].max(), ends[1].min() + 1))
        return np.array(out, np.int64).reshape(-1, 2)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """The test set in blocks of bounded bytes, in the order of ids; an item is never cut."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item_id"), utf8(text_col).alias("text")).filter(F.col("item_id").isNotNull())
    block, size = [], 0
    for r in rows.orderBy("item_id").toLocalIterator():
        text = bytes(r["text"])
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    yield block


class Index:
    """A stored positional inverted index, to be searched for any number of test sets.

    postings: block, term, n, at (packed: its first position, then the steps to the next ones) for each term of each block of documents.
    places: row, doc_id, block, start, length (words) of each document; all documents of a block lie end to end with `gap` between them.
    """

    def __init__(self, docs: DataFrame, gap: int = 64, id_col: str = "doc_id", text_col: str = "text"):
        docs = docs.select(named(id_col).alias("doc_id"), utf8(text_col).alias("text"))
        self.gap, self.kind = gap, docs.schema["doc_id"].dataType.simpleString()
        shape = f"block long, term binary, n int, at binary, row long, doc_id {self.kind}, start long, length long"
        self.stored = stored(docs.mapInArrow(_indexer(gap), shape), "index")
        self.postings = self.stored.filter("term IS NOT NULL").select("block", "term", "n", "at")
        self.places = self.stored.filter("row IS NOT NULL").select("row", "doc_id", "block", "start", "length")


def _indexer(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        row = TaskContext.get().partitionId() << 40
        names = ["block", "term", "n", "at", "row", "doc_id", "start", "length"]
        for part in _sized(batches):
            number = itertools.count()
            vocabulary: dict[bytes, int] = defaultdict(number.__next__)
            runs = [np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)) for w in map(words, part.column(1).to_pylist())]
            length = np.array([len(r) for r in runs], np.int64)
            start = np.cumsum(length + gap) - length - gap
            ids = np.concatenate(runs)
            positions = np.arange(len(ids)) + np.repeat(start - (np.cumsum(length) - length), length)
            order = np.argsort(ids, kind="stable")
            ids, positions = ids[order], positions[order]
            counts = np.bincount(ids, minlength=len(vocabulary))
            first = np.cumsum(counts) - counts
            steps = np.diff(positions, prepend=0)
            steps[first] = positions[first]
            data, size = packed(steps)
            ends = np.cumsum(np.add.reduceat(size, first)) if len(first) else np.zeros(0, np.int64)
            at = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            terms, n = pa.array(list(vocabulary), pa.binary()), part.num_rows
            none = lambda kind, n: pa.nulls(n, kind)
            for lo in range(0, len(counts), 1 << 15):
                some = slice(lo, lo + (1 << 15))
                k = len(counts[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), terms[some], pa.array(counts[some].astype(np.int32)), at[some], none(pa.int64(), k), none(part.column(0).type, k), none(pa.int64(), k), none(pa.int64(), k)], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), none(pa.binary(), n), none(pa.int32(), n), none(pa.binary(), n), pa.array(np.arange(row, row + n)), part.column(0), pa.array(start), pa.array(length)], names)
            block, row = block + 1, row + n

    return run


def search(index: Index, benchmark: DataFrame, window: int = 10, slop: int | None = None, item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit (words inside a match), n_items, items (sorted), items_sha256, contaminated for each document of the index.

    slop None: exact phrases; else proximity matches with that many further words between neighbours.
    """
    spark = benchmark.sparkSession
    if window + (slop or 0) > index.gap:
        raise ValueError("windows of more words than the index keeps between documents")
    shape = f"row long, doc_id {index.kind}, n_words long, hits array<long>, items array<string>"
    found = []
    for block in _blocks(benchmark, item_col, "text"):
        phrases = Phrases(block, window)
        terms = spark.createDataFrame([(bytearray(t), i) for t, i in phrases.terms.items()], "term binary, id int")  # bounded by the block's bytes
        mine = index.postings.join(F.broadcast(terms), "term").select("block", "id", "n", "at")
        counts = np.zeros(len(phrases.terms), np.int64)
        for r in mine.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a number a term
            counts[r["id"]] = r["n"]
        phrases.by_rarity(counts)
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("doc_id", index.kind), ("start", "long"), ("length", "long"))]
        here = index.places.select("block", *[F.lit(None).cast(t).alias(c) for c, t in (("id", "int"), ("n", "int"), ("at", "binary"))], "row", "doc_id", "start", "length")
        together = mine.select("block", "id", "n", "at", *blank).unionByName(here).repartition("block").sortWithinPartitions("block")
        found.append(together.mapInArrow(_matcher(spark.sparkContext.broadcast(phrases), index.gap, slop), shape))
    many = found[0]
    if len(found) > 1:  # the blocks' answers of one document meet by its row
        for f in found[1:]:
            many = many.unionByName(f)
        many = many.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    many = many.withColumn("items", F.array_sort("items")).withColumn("n_hit", F.expr(_COVERED))
    return many.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """search of an index that is made for it."""
    return search(Index(docs, max(64, window + (slop or 0)), id_col, text_col), benchmark, window, slop, item_col)


#: Words covered by hits, an array of start * 2^31 + length that may overlap.
_COVERED = """aggregate(array_sort(hits), named_struct('n', 0L, 'end', 0L),
  (s, h) -> named_struct('n', s.n + greatest(0L, (h div 2147483648L) + (h % 2147483648L) - greatest(s.end, h div 2147483648L)),
    'end', greatest(s.end, (h div 2147483648L) + (h % 2147483648L))), s -> s.n)"""


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most INDEX_BYTES of text, or of one row."""
    for batch in slices(batches, 1 << 14):
        ends = np.cumsum([len(t) for t in batch.column(1).to_pylist()], dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, base + INDEX_BYTES, "right")) - at)
            yield batch.slice(at, n)
            at += n


def _matcher(shared, gap: int, slop: int | None):
    def answer(rows: pa.Table, phrases: Phrases) -> pa.RecordBatch:
        """Of all rows of a block."""
        of_term = rows.filter(pc.is_valid(rows.column("id")))
        docs = rows.filter(pc.is_valid(rows.column("row"))).sort_by("start")
        data = np.frombuffer(b"".join(of_term.column("at").to_pylist()), np.uint8)
        counts = of_term.column("n").to_numpy().astype(np.int64)
        steps, first = unpacked(data), np.cumsum(counts) - counts
        total = np.cumsum(steps)
        positions = total - np.repeat(total[first] - steps[first], counts)
        starts, lengths = docs.column("start").to_numpy(), docs.column("length").to_numpy()
        index = Postings(of_term.column("id").to_numpy(), counts, positions, len(phrases.terms), int(starts[-1] + lengths[-1]) + gap)
        spans: list[list[tuple[int, int]]] = [[] for _ in starts]
        items: list[set[int]] = [set() for _ in starts]

        def hit(owners: list[int], start: int, end: int) -> None:
            d = int(np.searchsorted(starts, start, "right")) - 1
            spans[d].append((int(start - starts[d]), int(end - start)))
            items[d].update(owners)

        for length, (rows_of, owners) in phrases.by_length.items():
            if slop is None:
                for which, at in index.exact(rows_of, phrases.order[length]):
                    for w, start in zip(which.tolist(), at.tolist()):
                        hit(owners[w], start, start + length)
            else:
                for w, phrase in enumerate(rows_of):
                    for start, end in index.near(phrase, slop).tolist():
                        hit(owners[w], start, end)
        names = phrases.items
        docs = docs.combine_chunks()
        return pa.RecordBatch.from_arrays([
            docs.column("row").combine_chunks(), docs.column("doc_id").combine_chunks(), docs.column("length").combine_chunks(),
            pa.array([merged(s) for s in spans], pa.list_(pa.int64())), pa.array([[names[i] for i in sorted(s)] for s in items], pa.list_(pa.string())),
        ], ["row", "doc_id", "n_words", "hits", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and hi > lo and held[-1].column(0)[0].as_py() != blocks[lo]:
                    yield answer(pa.Table.from_batches(held), phrases)
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield answer(pa.Table.from_batches(held), phrases)

    return run


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching spans as one, each start << 31 | length."""
    out: list[list[int]] = []
    for at, n in sorted(spans):
        if out and at <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
        else:
            out.append([at, n])
    return [at << 31 | n for at, n in out]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows whose doc_id no contaminated text has; rows without id count as one document here."""
    return rows_without(docs, contamination(docs, benchmark, window).filter("contaminated").select("doc_id"), "doc_id")

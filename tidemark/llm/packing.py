"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Documents become pieces of at most `capacity` tokens; only longer documents are cut.
Lengths are the only thing that packing sees, and there are at most `capacity` of
them, so the plan is made on the table of counts by length, whatever the corpus size:

1. reduction: a pair of lengths that provably dominates every alternative for its
   larger member is fixed for as many copies as there are, and leaves the instance;
2. best fit decreasing on the rest, a whole length class at a time;
3. every piece gets a rank in its length class from counts of (length, salt) and a
   row number inside these, so that a length that a third of all pieces share is
   ranked by many tasks; the rank picks its place in the plan.

Null and empty texts have the closing id alone.  Rows with equal doc_id are separate
documents of that id; equal rows may take each other's places, and so may pieces of one length.  An empty table gives no piece.  Other
columns are not read, whatever their names.  A very long text costs four bytes a token in its task; ids are kept for
words that come again, within a bound in bytes.
"""

from __future__ import annotations

import functools
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Kept, named, slices, stored, utf8
from tidemark.llm.token_counts import WS, byte_symbols

#: Pieces of one length that a task ranks, about.
RANKED = 500_000


class WordTokens(Kept):
    """The ids (little-endian unsigned 32-bit) of texts between white space, by the tokenizer's own model.

    No pre-token of this tokenizer spans white space, so a text's ids are those of its words in a row.
    Words of plain Latin letters skip the library's normaliser; all others go through it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self.of_word, room=128 << 20)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
        self.bytes = byte_symbols()
        self.simple = regex.compile(r"[\x21-\x7e\xa1-įı-ɏ]+\Z")

    def of_word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one pre-token
            return self._ids(word.decode().lower())
        if word[-1:] in b".,!?|" and word[-2:-1].isalnum():  # a mark after a letter or digit is a pre-token of its own
            return self[word[:-1]] + self[word[-1:]]
        return self._other(word)

    def _ids(self, *mapped: str) -> bytes:
        ids = [t.id for piece in mapped for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _other(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if b"<|" not in word and self.simple.match(text):
            text = text.lower()
            found = [text] if text.isalpha() else self.pattern.findall(text)
            return self._ids(*[p if p.isascii() else "".join([self.bytes[b] for b in p.encode()]) for p in found])
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        if b"<|" not in text:
            text = text.lower()  # as the tokenizer does anyway; fewer distinct words
        return b"".join([self[w] for w in text.split()])


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int, close_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    docs = docs.select(named(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([close_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        for part in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                ids = memoryview(words.encode(text) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(one) // 4)
                    crc.append(zlib.crc32(one))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs of places: pieces of one length, by rank from k0 on, fill sequences from b0 on, q in each, from an offset on."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.used, self.bins = capacity, [], {}, 0

    def put(self, size: int, n_bins: int, q: int, b0: int, offset: int, n: int | None = None) -> None:
        k0 = self.used.get(size, 0)
        n = n_bins * q if n is None else n
        self.used[size] = k0 + n
        self.runs.append((size, k0, b0, q, offset))

    def new_bins(self, n: int) -> int:
        self.bins += n
        return self.bins - n


def _largest_pair_sum(sizes: list[int], counts: dict[int, int], limit: int) -> int:
    """The largest sum of two available pieces that is at most limit; 0 if there is none."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total <= limit and (i < j or counts[sizes[i]] > 1):
            best = max(best, total)
        if total > limit:
            j -= 1
        else:
            i += 1
    return best


def reduce_dominated(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Martello and Toth's reduction on length classes, largest first; fixed sets go into the plan, the rest is returned.

    For a piece j with room r = capacity - j and i the longest other piece that fits beside it, {j, i} (or {j} if
    nothing fits) dominates when no set of other pieces that fits in r totals more than i: it could swap
    places with i.  That holds when i fills r; when no two others fit in r; when no three do, and no pair totals more than i.
    """
    counts = {s: n for s, n in counts.items() if n}
    sizes = sorted(counts)

    def drop(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect_left(sizes, size))

    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room = plan.capacity - j
            counts[j] -= 1  # the piece itself is no alternative to it
            smallest = []
            for s in sizes:
                smallest += [s] * min(counts[s], 3 - len(smallest))
                if len(smallest) == 3:
                    break
            at = bisect_right(sizes, room) - 1
            while at >= 0 and not counts[sizes[at]]:
                at -= 1
            i = sizes[at] if at >= 0 else 0
            fixed = not i or i == room or (len(smallest) < 2 or smallest[0] + smallest[1] > room)
            if not fixed and (len(smallest) < 3 or sum(smallest) > room):
                fixed = _largest_pair_sum([s for s in sizes if counts[s]], counts, room) <= i
            counts[j] += 1
            if not fixed:
                break
            n = counts[j] if not i else counts[j] // 2 if i == j else min(counts[j], counts[i])
            b0 = plan.new_bins(n)
            if i == j:
                plan.put(j, n, 2, b0, 0)
                drop(j, 2 * n)
            else:
                plan.put(j, n, 1, b0, 0)
                drop(j, n)
                if i:
                    plan.put(i, n, 1, b0, j)
                    drop(i, n)
    return counts


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Best fit decreasing: a piece goes into the open sequence with the least room that takes it.

    A sequence that has just taken a piece has the least room of all that fit as long as it takes another, so each is
    filled with as many pieces of the length as it holds before the next is touched; whole ranges of sequences move at once.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room: ranges of sequences (first, how many)
    rooms: list[int] = []

    def add(room: int, b0: int, n: int) -> None:
        if room and n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((b0, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                q = plan.capacity // size
                n = -(-left // q)
                room, b0, had = plan.capacity, plan.new_bins(n), n
            else:
                room = rooms[at]
                b0, had = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
                q = room // size
                n = min(had, -(-left // q))
                add(room, b0 + n, had - n)
            offset = plan.capacity - room
            whole, rest = divmod(min(left, n * q), q)
            if whole:
                plan.put(size, whole, q, b0, offset)
                add(room - q * size, b0, whole)
            if rest:
                plan.put(size, 1, q, b0 + whole, offset, rest)
                add(room - rest * size, b0 + whole, 1)
            left -= whole * q + rest


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(capacity)
    best_fit(reduce_dominated(counts, plan), plan)
    return plan


def pack(docs: DataFrame, path: str, capacity: int = 4096, close_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, capacity, close_id, id_col, text_col), "pieces")
    salts = max(256, -(-cut.count() // RANKED))  # were all pieces of one length, a task would rank RANKED of them
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = stored(cut.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")  # at most capacity x salts rows
    counts = dict(by_salt.groupBy("length").agg(F.sum("_n")).collect())  # at most capacity rows
    plan = make_plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = by_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = cut.withColumn("_row", F.row_number().over(inside)).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_row") - 1)

    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)  # a few runs a length, by the plan's size and not the corpus'
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        # runs are sorted by (length, first rank): one number orders both
        width = np.int64(1) << 48
        keys = runs[:, 0] * width + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            _, k0, b0, q, offset = runs[np.searchsorted(keys, length * width + rank, "right") - 1].T
            nth = rank - k0
            out = [pa.array(b0 + nth // q), pa.array(offset + nth % q * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *out], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.select(*names, "_rank").mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")

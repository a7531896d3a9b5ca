"""Language-model scores by a probabilistic suffix tree over words.

A text is its words and an end.  The tree's symbols are classes of words: a frequent word (more
than one in `alphabet` of all tokens) is a class of its own; other words share the class of their last two
bytes, which tell much of language and form.  A word's probability is that of its class after
the classes before it, times its add-half share of its class, where all unseen words are one.

Learning: contexts of one to three symbols that come `least` times or more, whatever the size of the corpus, are retained if
their next-symbol distribution diverges from that of their longest retained suffix: N KL > the price of naming each of its
symbols once after that suffix, so that symbols which came once never pay.  A state's distribution is smoothed with its suffix's by Witten and Bell's weights, the root's by half
counts.  Each symbol is scored in the state of the longest retained suffix of what came before.

The tree is never in one place.  Texts are laid out in blocks of bounded tokens, and a block asks others by messages of packed
arrays.  First it sends its distinct words, by hash, to owners that add up their counts and send them back.  Then, as classes
are known, it sends its distinct (context, next symbol) to the ranges of a tree that is cut by the context's last
symbol: all longer contexts that end in it are in the same range, so a range learns its subtrees and answers by itself.
A last symbol of more than a range's share is cut further by the symbol before it, and the distribution after it alone is
added up beforehand and given to each part.  Ranges, owners and blocks are bounded in tokens (or one text), and their numbers grow with the
corpus; the driver holds the alphabet (fewer than 65,000 symbols, whatever the corpus) and the cuts.  Words are told apart by 64 bits of hash.

Null texts are empty: one token, the end.  Base scores are the add-half unigram's of the words themselves.
Each row gets a row, whatever ids repeat; a null id counts as crc32 0; an empty table gives an empty one.  Words as frequent as
the bounds of the alphabet are not among the frequent ones.  A very long text is a block of its own.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_of_id, discard, shared_folder, slices, stored, utf8

#: Symbols: the mark before a text, its end, words of no class; and what stands before a text's beginning.
START, END, OTHER, FIRST, NOTHING = 0, 1, 2, 3, 0xFFFF
BITS = 20
#: Tokens of a block, about.
BLOCK = 1_000_000
#: Owners of words: at least so many, and one for each so many bytes of text, so that none is asked for more than some 10,000,000 words.
OWNERS, OWNER_BYTES = 1024, 512 << 20
#: Tokens whose contexts a range of the tree has, about: at most, and at least.
RANGE = (2_000_000, 100_000)


class Level:
    """Contexts of one length: codes (number of the context without its last symbol, last symbol), sorted; their place is their number."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes)

    def find(self, shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Numbers, -1 where there is no such context."""
        if not len(self.codes):
            return np.full(len(last), -1)
        want = shorter << BITS | last
        at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        return np.where((shorter >= 0) & (self.codes[at] == want), at, -1)


def numbers(sym: np.ndarray, levels: list[Level]) -> list[np.ndarray]:
    """For each level, the number of the context before each symbol.  START ends a context's growth to the left, as nothing stands before it."""
    out = [np.zeros(len(sym), np.int64)]
    for level in levels:
        shorter, last = np.full(len(sym), -1), np.zeros(len(sym), np.int64)
        shorter[1:], last[1:] = out[-1][:-1], sym[:-1]
        shorter[1:][sym[1:] == START] = -1
        out.append(level.find(shorter, last))
    return out


class SuffixTree:
    """The model on one machine, for small inputs and as the measure of `evaluated`.

    Levels of contexts; of the retained ones the log10 probabilities of symbols seen after them, and the weight of their suffix."""

    def __init__(self, size: int, counts: list[tuple[np.ndarray, np.ndarray]], levels: list[Level], least: int = 1):
        """counts: by level (0: the root), codes of (context, next symbol) and how often; contexts of fewer than least are not retained."""
        self.levels = levels
        root = np.full(size, 0.5)
        root[START] = 0.0
        root[counts[0][0]] += counts[0][1]
        with np.errstate(divide="ignore"):
            self.root = np.log10(root / root.sum())
        paths: list[list[tuple]] = [[()]]
        states = {(): 0}
        self.state = [np.zeros(1, np.int64)]  # by level and number: the retained state, or that of the longest retained suffix
        self.parent, self.backoff = [-1], [0.0]
        codes, logs = [], []
        for level, (code, n) in zip(levels, counts[1:]):
            path = [paths[-1][c >> BITS] + (int(c & (1 << BITS) - 1),) for c in level.codes.tolist()]
            paths.append(path)
            ctx, sym = code >> BITS, code & (1 << BITS) - 1
            order = np.argsort(code)
            ctx, sym, n = ctx[order], sym[order], n[order].astype(float)
            bounds = np.searchsorted(ctx, np.arange(len(path) + 1))
            where = np.zeros(len(path), np.int64)
            fresh = {}
            for i, p in enumerate(path):
                suffix = next(p[k:] for k in range(1, len(p) + 1) if p[k:] in states)
                up = where[i] = states[suffix]
                s, m = sym[bounds[i] : bounds[i + 1]], n[bounds[i] : bounds[i + 1]]
                if not len(s):
                    continue
                total, kinds = m.sum(), len(s)
                if total < least:
                    continue
                below = self._log(np.full(len(s), up), s, codes, logs)
                if float((m * (np.log(m / total) - below * np.log(10))).sum()) <= -float(below.sum()) * np.log(10):
                    continue
                where[i] = fresh[p] = len(self.parent)
                self.parent.append(up)
                self.backoff.append(float(np.log10(kinds / (total + kinds))))
                codes.append(np.int64(where[i]) << BITS | s)
                logs.append(np.log10((m + kinds * 10**below) / (total + kinds)))
            states |= fresh
            self.state.append(where)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)  # states come in order, symbols too
        self.logs = np.concatenate(logs) if logs else np.zeros(0)
        self.parent, self.backoff = np.array(self.parent), np.array(self.backoff)

    def _log(self, state: np.ndarray, sym: np.ndarray, codes: list, logs: list) -> np.ndarray:
        """While the tree grows: states number as they are appended, so a state's entries are codes[state - 1]."""
        out, at, todo = np.zeros(len(sym)), int(state[0]) if len(state) else 0, np.arange(len(sym))
        while at and len(todo):
            own, want = codes[at - 1], (np.int64(at) << BITS) | sym[todo]
            k = np.minimum(np.searchsorted(own, want), len(own) - 1)
            hit = own[k] == want
            out[todo[hit]] += logs[at - 1][k[hit]]
            todo = todo[~hit]
            out[todo] += self.backoff[at]
            at = self.parent[at]
        out[todo] += self.root[sym[todo]]
        return out

    def log(self, sym: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after those before it; 0 for STARTs."""
        ctx = numbers(sym, self.levels)
        state = np.zeros(len(sym), np.int64)
        done = np.zeros(len(sym), bool)
        for d in range(len(ctx) - 1, 0, -1):  # the longest context that is known leads to its longest retained suffix
            hit = ~done & (ctx[d] >= 0)
            state[hit] = self.state[d][ctx[d][hit]]
            done |= hit
        out, todo = np.zeros(len(sym)), np.flatnonzero(sym != START)
        state = state[todo]
        while len(todo):
            at_root = state == 0
            out[todo[at_root]] += self.root[sym[todo[at_root]]]
            todo, state = todo[~at_root], state[~at_root]
            if not len(todo):
                break
            want = state << BITS | sym[todo]
            k = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
            hit = self.codes[k] == want
            out[todo[hit]] += self.logs[k[hit]]
            todo, state = todo[~hit], state[~hit]
            out[todo] += self.backoff[state]
            state = self.parent[state]
        return out


def pack(values: np.ndarray) -> bytes:
    """An array of numbers, compressed byte by byte of its values."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


class Alphabet:
    """Classes: the frequent words in the order of their hashes, then endings; of all the counts, and of endings the add-half denominators."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, endings: dict[int, tuple[int, int]], rest: tuple[int, int], n_texts: int, owners: int = OWNERS):
        """hashes: of frequent words, unsigned and sorted; endings, rest: (tokens, distinct words)."""
        self.size = FIRST + len(hashes) + len(endings)
        first = FIRST + len(hashes)
        self.class_of_ending = np.full(1 << 16, OTHER, np.uint16)
        self.class_of_ending[list(endings)] = np.arange(first, self.size)
        self.before = np.searchsorted(hashes >> np.uint64(64 - owners.bit_length() + 1), np.arange(owners))  # frequent words of earlier owners
        self.counts = np.array([0, n_texts, rest[0], *counts, *[n for n, _ in endings.values()]], float)
        self.log_total = np.zeros(self.size)
        for at, (n, v) in zip([OTHER, *range(first, self.size)], [rest, *endings.values()]):
            self.log_total[at] = np.log10(n + 0.5 * (v + 1))
        root = self.counts + 0.5
        root[START] = 0.0
        self.root = root / root.sum()

    def cuts(self, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ranges begin (last symbol << 16 | the one before), and the last symbols that have several ranges."""
        mass = self.counts.copy()
        mass[START], mass[END] = n_texts, 0
        share = min(RANGE[0], max(RANGE[1], mass.sum() / 64))
        along = np.cumsum(mass) / max(mass.sum(), 1)
        bounds, split, held = {0}, [], 0.0
        for symbol, m in enumerate(mass.tolist()):
            if m > share:
                parts = int(-(-m // share))
                bounds |= {symbol << 16 | int(x) for x in np.searchsorted(along, np.arange(parts) / parts)} | {symbol << 16, symbol + 1 << 16}
                split.append(symbol)
                held = 0.0
            else:
                if held + m > share:
                    bounds.add(symbol << 16)
                    held = 0.0
                held += m
        return np.array(sorted(bounds), np.uint64), np.array(split, np.uint64)


def owners_for(size: int) -> int:
    """Owners of the words of texts of that many bytes: a power of two, as the first bits of a word's hash name its owner."""
    return max(OWNERS, 1 << max(0, -(-size // OWNER_BYTES) - 1).bit_length())


def blocks_and_questions(docs: DataFrame, fold: int, held: int, owners: int = OWNERS) -> DataFrame:
    """Rows of kind block (ids, data: lengths, train, words by rank of frequency, ranks by hash, endings) and of kind ask (target: an owner; data: hashes, training counts, endings)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", utf8().alias("text"), (F.pmod(crc32_of_id(), F.lit(fold)) != held).alias("train"))
    shift = np.uint64(64 - owners.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, kind_of_id = TaskContext.get().partitionId() << 32, [], None
        texts: list[np.ndarray] = []
        train: list[bool] = []
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)

        def flush() -> pa.RecordBatch:
            lengths, learn = np.array([len(t) for t in texts], np.int64), np.array(train, np.uint8)
            flat = np.concatenate(texts)
            times = np.bincount(flat, minlength=len(vocabulary))
            by_rank = np.argsort(-times, kind="stable")
            rank = np.empty(len(by_rank), np.uint32)
            rank[by_rank] = np.arange(len(by_rank))
            words = list(vocabulary)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[by_rank]
            endings = np.fromiter((int.from_bytes(w[-2:], "big") for w in words), np.uint16, len(words))[by_rank]
            flat = rank[flat]
            learned = np.bincount(flat[np.repeat(learn, lengths).astype(bool)], minlength=len(words)).astype(np.uint32)
            by_hash = np.argsort(hashes)
            h, c, e = hashes[by_hash], learned[by_hash], endings[by_hash]
            target = (h >> shift).astype(np.int32)
            begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(h) else np.zeros(0, np.int64)
            ask = [[pack(x[i:j]) for x in (h, c, e)] for i, j in zip(begin, [*begin[1:], len(h)])]
            own = [pack(lengths), pack(learn), pack(flat), pack(by_hash.astype(np.uint32)), pack(endings)]
            n = 1 + len(ask)
            return pa.RecordBatch.from_arrays([
                pa.array(["block", *["ask"] * len(ask)]), pa.array(np.full(n, block)), pa.array([-1, *target[begin].tolist()], pa.int32()), pa.array([ids, *[None] * len(ask)], pa.list_(kind_of_id)), pa.array([own, *ask], pa.list_(pa.binary())),
            ], ["kind", "block", "target", "ids", "data"])

        size = 0
        for part in slices(batches):
            kind_of_id = part.column(0).type
            for i, text, learn in zip(*(part.column(k).to_pylist() for k in range(3))):
                w = text.lower().split()
                if texts and size + len(w) > BLOCK:
                    yield flush()
                    block, size, vocabulary = block + 1, 0, defaultdict(count().__next__)
                    ids, texts, train = [], [], []
                ids.append(i)
                texts.append(np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)))
                train.append(learn)
                size += len(w) + 1
        if texts:
            yield flush()

    return docs.mapInArrow(run, f"kind string, block long, target int, ids array<{kind}>, data array<binary>")


def _parts_of(rows: pa.Table) -> tuple[list[int], list[list[bytes]]]:
    """Blocks and data of messages, in the order of blocks."""
    order = np.argsort(rows.column("block").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    return rows.column("block").to_pylist(), rows.column("data").to_pylist()


def own_words(asked: DataFrame, floor: float) -> DataFrame:
    """Answers of owners (kind answer: data: counts, place among the owner's frequent words from 1 on) and what they know (frequent: a word's hash and count; ending: its tokens and distinct words)."""

    def run(rows: pa.Table) -> pa.Table:
        blocks, data = _parts_of(rows)
        h, c, e = ([unpack(d[k]) for d in data] for k in range(3))
        lengths = [len(x) for x in h]
        words, at, of = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
        total = np.bincount(of, np.concatenate(c), len(words)).astype(np.int64)
        frequent = total > floor
        place = np.where(frequent, np.cumsum(frequent), 0).astype(np.uint16)
        ends = np.cumsum(lengths)[:-1]
        answers = [[pack(t), pack(p)] for t, p in zip(np.split(total[of], ends), np.split(place[of], ends))]  # counts may pass 32 bits; bytes that are all 0 pack to nothing
        ending = np.concatenate(e)[at][~frequent].astype(np.int64)
        tokens, distinct = np.bincount(ending, total[~frequent]), np.bincount(ending, total[~frequent] > 0)
        which = np.unique(ending)
        n, f = len(blocks), int(frequent.sum())
        empty = [None] * (f + len(which))
        return pa.table({
            "kind": ["answer"] * n + ["frequent"] * f + ["ending"] * len(which), "block": pa.array(blocks + empty, pa.int64()), "target": pa.array(rows.column("target").to_pylist() + empty, pa.int32()), "data": pa.array(answers + empty, pa.list_(pa.binary())),
            "k": pa.array([None] * n + words[frequent].view(np.int64).tolist() + which.tolist(), pa.int64()), "n": pa.array([None] * n + total[frequent].tolist() + [int(x) for x in tokens[which]], pa.int64()), "v": pa.array([None] * (n + f) + [int(x) for x in distinct[which]], pa.int64()),
        })

    return asked.select("block", "target", "data").groupBy("target").applyInArrow(run, "kind string, block long, target int, data array<binary>, k long, n long, v long")


def coded(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each symbol of texts end to end, with an END after each: the three before it, the last one first, and itself, 16 bits each."""
    sizes = lengths + 1
    ends = np.cumsum(sizes)
    nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    sym = np.full(len(nth), END, np.uint64)
    inner = np.ones(len(nth), bool)
    inner[ends - 1] = False
    sym[inner] = seq
    out = sym.copy()
    for d in range(1, 4):
        before = np.full(len(sym), NOTHING, np.uint64)
        at = np.flatnonzero(nth >= d)
        before[at] = sym[at - d]
        before[nth == d - 1] = START
        out |= before << np.uint64(64 - 16 * d)
    return out


def _divergent(n: np.ndarray, below: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts that begin at `first`: retained, total, kinds; n: how often each next symbol came, below: its probability after the suffix."""
    total, kinds = np.add.reduceat(n, first), np.add.reduceat((n > 0).astype(np.int64), first)
    gain = np.add.reduceat(n * (np.log(np.maximum(n, 1)) - np.log(below)), first) - total * np.log(np.maximum(total, 1))
    price = np.add.reduceat(np.where(n > 0, -np.log(below), 0.0), first)
    return (total >= least) & (gain > price), total, kinds


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, where each comes first, and of all keys their places among them: np.unique with less memory, as places have 32 bits."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    place = np.cumsum(fresh, dtype=np.uint32)
    place -= 1
    of = np.empty(len(keys), np.uint32)
    of[order] = place
    return keys[fresh], order[fresh], of


def evaluated(codes: np.ndarray, n: np.ndarray, root: np.ndarray, depth: int, least: int, shared: tuple[int, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each (distinct, sorted) code's symbol after its context, learned from n, how often each came in training.

    shared: a last symbol whose contexts are elsewhere, too, with all symbols after it and their counts.
    """
    p = root[(codes & np.uint64(0xFFFF)).astype(np.uint16)]
    for d in range(1, depth + 1):
        if d < 3:
            kinds_of, at, of = _grouped(codes >> np.uint64(64 - 16 * d) << np.uint64(16) | codes & np.uint64(0xFFFF))
            times, below = np.bincount(of, n, len(at)), p[at]
            del at
        else:  # a context of three and its symbol are the code
            kinds_of, of, times, below = codes, slice(None), np.asarray(n, float), p
        mine = kinds_of >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        retained, total, kinds = _divergent(times, below, first, least)
        retained &= (mine[first] & np.uint64(0xFFFF)) != NOTHING
        if d == 1 and shared is not None:
            symbol, after, counts = shared
            all_of = np.flatnonzero(mine[first] == symbol)
            r, t, k = _divergent(counts.astype(float), root[after], np.zeros(1, np.int64), least)
            retained[all_of], total[all_of], kinds[all_of] = r[0], t[0], k[0]
            here = mine == symbol
            where = np.minimum(np.searchsorted(after, kinds_of[here] & np.uint64(0xFFFF)), len(after) - 1)
            times[here] = np.where(after[where] == kinds_of[here] & np.uint64(0xFFFF), counts[where], 0)
        spread = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(np.append(first, len(mine))))
        del mine, first, kinds_of
        kept = np.flatnonzero(retained[spread])
        spread = spread[kept]
        below[kept] = (times[kept] + kinds[spread] * below[kept]) / (total[spread] + kinds[spread])
        del spread, kept, times
        p = below[of]
    return np.log10(p)


def answered(data: list[list[bytes]], root: np.ndarray, depth: int, least: int, shared: tuple[int, np.ndarray, np.ndarray] | None = None) -> list[bytes]:
    """The answers of a range to blocks' messages (codes, counts), in their order; some 70 bytes a code at most."""
    codes = [unpack(d[0]) for d in data]
    ends = np.cumsum([len(c) for c in codes])[:-1]
    codes = np.concatenate(codes)
    distinct, _, of = _grouped(codes)
    del codes, _
    n = np.bincount(of, np.concatenate([unpack(d[1]) for d in data]), len(distinct))
    lp = evaluated(distinct, n, root, depth, least, shared).astype(np.float32)
    return [pack(lp[x]) for x in np.split(of, ends)]


def log_scores(classed: DataFrame, alphabet: Alphabet, n_texts: int, depth: int, least: int) -> DataFrame:
    """block, target (a range), data (log10 probabilities of the block's distinct codes in the range, in order) from rows of block and data (lengths, train, classes, ...)."""
    spark = classed.sparkSession
    bounds, split = alphabet.cuts(n_texts)
    shared = spark.sparkContext.broadcast((bounds, split, alphabet.root))

    def of_block(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths, train, seq = (unpack(x) for x in data[:3])
        codes = coded(seq, lengths)
        distinct, of = np.unique(codes, return_inverse=True)
        return distinct, np.bincount(of, np.repeat(train, lengths + 1), len(distinct)).astype(np.uint32)

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, _, _ = shared.value
        for part in slices(batches, 1):
            codes, n = of_block(part.column(1)[0].as_py())
            target = np.searchsorted(bounds, codes >> np.uint64(32), "right") - 1
            begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            data = [[pack(codes[i:j]), pack(n[i:j])] for i, j in zip(begin, [*begin[1:], len(codes)])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), part.column(0)[0].as_py())), pa.array(target[begin].astype(np.int32)), pa.array(data, pa.list_(pa.binary()))], ["block", "target", "data"])

    def after_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, split, _ = shared.value
        for part in slices(batches, 1):
            codes, n = of_block(part.column(1)[0].as_py())
            last = codes >> np.uint64(48)
            for symbol in split:
                lo, hi = np.searchsorted(last, symbol), np.searchsorted(last, symbol, "right")
                times = np.bincount((codes[lo:hi] & np.uint64(0xFFFF)).astype(np.int64), n[lo:hi])
                after = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array([int(symbol)], pa.int32()), pa.array([[pack(after.astype(np.uint16)), pack(times[after].astype(np.int64))]], pa.list_(pa.binary()))], ["target", "data"])

    def added(rows: pa.Table) -> pa.Table:
        bounds, _, _ = shared.value
        total = np.zeros(1 << 16, np.int64)
        for after, times in rows.column("data").to_pylist():
            total[unpack(after)] += unpack(times)
        symbol, after = rows.column("target")[0].as_py(), np.flatnonzero(total)
        ranges = np.flatnonzero(bounds >> np.uint64(16) == symbol).tolist()
        data = [pack(np.array([symbol], np.uint64)), pack(after.astype(np.uint64)), pack(total[after])]
        return pa.table({"block": pa.array([-1] * len(ranges), pa.int64()), "target": pa.array(ranges, pa.int32()), "data": pa.array([data] * len(ranges), pa.list_(pa.binary()))})

    def answer(rows: pa.Table) -> pa.Table:
        _, _, root = shared.value
        blocks, data = _parts_of(rows)
        given = None
        if blocks[0] < 0:  # what is known of the last symbol as a whole
            symbol, after, counts = (unpack(x) for x in data[0])
            given, blocks, data = (symbol[0], after, counts), blocks[1:], data[1:]
        if not blocks:
            return pa.table({"block": pa.array([], pa.int64()), "target": pa.array([], pa.int32()), "data": pa.array([], pa.list_(pa.binary()))})
        answers = answered(data, root, depth, least, given)
        return pa.table({"block": pa.array(blocks, pa.int64()), "target": pa.array([rows.column("target")[0].as_py()] * len(blocks), pa.int32()), "data": pa.array([[x] for x in answers], pa.list_(pa.binary()))})

    shape = "block long, target int, data array<binary>"
    asked = classed.select("block", "data").mapInArrow(messages, shape)
    if len(split):
        sums = classed.select("block", "data").mapInArrow(after_split, "target int, data array<binary>").groupBy("target").applyInArrow(added, shape)
        asked = asked.unionByName(sums)
    return asked.groupBy("target").applyInArrow(answer, shape)


def tidy(spark: SparkSession) -> None:
    """Shuffle files of plans that are done go when the driver's garbage is collected: this asks for it."""
    gc.collect()
    spark._jvm.System.gc()


def score(docs: DataFrame, fold: int = 5, held: int = 1, depth: int = 3, least: int = 2, alphabet: int = 20_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    if not 1 <= depth <= 3:
        raise ValueError("contexts of one to three symbols")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    path = shared_folder(spark, "blocks")
    owners = owners_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])  # one number
    blocks_and_questions(docs, fold, held, owners).write.partitionBy("kind").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    shape = f"block long, target int, ids array<{kind}>, data array<binary>"
    blocks, asked = (spark.read.schema(f"{shape}, kind string").parquet(path).filter(F.col("kind") == k).drop("kind") for k in ("block", "ask"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            lengths, train = (unpack(x) for x in part.column(0)[0].as_py()[:2])
            yield pa.RecordBatch.from_arrays([pa.array([int(lengths[train > 0].sum())]), pa.array([int(train.sum())])], ["tokens", "texts"])

    tokens, n_texts = blocks.select("data").mapInArrow(totals, "tokens long, texts long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    n = tokens + n_texts
    known = stored(own_words(asked, max(n / alphabet, 1)), "words")
    frequent = known.filter("kind = 'frequent'").select("k", "n").toArrow()  # fewer than `alphabet` rows
    order = np.argsort(frequent.column("k").to_numpy().astype(np.int64).view(np.uint64))
    hashes, counts = frequent.column("k").to_numpy().astype(np.int64).view(np.uint64)[order], frequent.column("n").to_numpy()[order]
    by = known.filter("kind = 'ending'").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("k").toArrow().to_pylist()  # at most 2^16 rows
    floor = max(least, n / (2 * alphabet))
    endings = {r["k"]: (r["n"], r["v"]) for r in by if r["n"] >= floor}  # fewer than 2 x alphabet
    rest = tuple(sum(r[c] for r in by if r["n"] < floor) for c in ("n", "v"))
    v = len(hashes) + sum(r["v"] for r in by) + (n_texts > 0)
    letters = Alphabet(hashes, counts, endings, rest, n_texts, owners)
    if letters.size >= NOTHING:
        raise ValueError("an alphabet of fewer than 65,535 symbols")
    base_floor = float(np.log10(n + 0.5 * (v + 1)))
    shared = spark.sparkContext.broadcast(letters)

    def classes(rows: pa.Table) -> pa.Table:
        """A block with its answers: data: lengths, train, classes, known words, base scores, scores within classes."""
        letters: Alphabet = shared.value
        rows = rows.sort_by("target")
        targets, data = rows.column("target").to_pylist(), rows.column("data").to_pylist()
        lengths, train, flat, by_hash, ending = (unpack(x) for x in data[0])
        c, cls = np.zeros(len(ending), np.int64), letters.class_of_ending[ending].astype(np.int64)
        if len(targets) > 1:
            c[by_hash] = np.concatenate([unpack(d[0]) for d in data[1:]])
            own = np.concatenate([np.where((at := unpack(d[1]).astype(np.int64)) > 0, FIRST + letters.before[t] + at - 1, 0) for t, d in zip(targets[1:], data[1:])])
            of_word = np.zeros(len(ending), np.int64)
            of_word[by_hash] = own
            cls = np.where(of_word > 0, of_word, cls)
            within = np.where(of_word > 0, 0.0, np.log10(c + 0.5) - letters.log_total[cls])
        else:
            within = np.zeros(len(ending))
        sums = lambda per_word: np.bincount(np.repeat(np.arange(len(lengths)), lengths), per_word[flat], len(lengths))
        out = [pack(lengths), pack(train), pack(cls.astype(np.uint16)[flat]), pack(sums((c > 0).astype(float))), pack(sums(np.log10(c + 0.5) - base_floor)), pack(sums(within))]
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()]), "target": pa.array([-1], pa.int32()), "ids": rows.column("ids").slice(0, 1), "data": pa.array([out], pa.list_(pa.binary()))})

    answers = known.filter("kind = 'answer'").select("block", "target", F.lit(None).cast(f"array<{kind}>").alias("ids"), "data")
    classed = stored(blocks.unionByName(answers).groupBy("block").applyInArrow(classes, shape), "classes")
    discard(known)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    tidy(spark)
    lps = log_scores(classed, letters, n_texts, depth, least).withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    end_base, end_known = float(np.log10(n_texts + 0.5) - base_floor), int(n_texts > 0)

    def result(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("target")
        data = rows.column("data").to_pylist()
        lengths, train, seq, known, base, within = (unpack(x) for x in data[0])
        _, of = np.unique(coded(seq, lengths), return_inverse=True)
        lp = np.concatenate([unpack(d[0]) for d in data[1:]]).astype(float)[of]
        of_text = np.bincount(np.repeat(np.arange(len(lengths)), lengths + 1), lp, len(lengths))
        ids = rows.column("ids").combine_chunks()[0].values
        return pa.table({
            "doc_id": ids, "held_out": pa.array(train == 0), "n_tokens": pa.array(lengths + 1), "n_known": pa.array(known.astype(np.int64) + end_known), "train_tokens": pa.array(np.full(len(lengths), n, np.int64)),
            "base_score": pa.array(base + end_base), "score": pa.array(of_text + within),
        })

    return classed.unionByName(lps).groupBy("block").applyInArrow(result, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Token counts of byte-level BPE without token ids.

Heap-and-linked-list merging: the symbols of a pre-token form a linked list, a heap
holds the ranks of adjacent pairs, and the lowest-rank pair (leftmost first) is
merged until none is left.  The count is the initial symbols minus the merges.

Null and empty texts have 0 tokens.  Special strings inside a text count as one
token each, as the library does by default.  One row a row of the input, whatever
repeats; other columns are not read.  Counts are kept for pieces of text between
spaces, as pre-tokens never span a space that a non-space follows; what is kept is bounded in bytes, and long pieces are not
kept.  A very long text is counted piece by piece; one pre-token costs some 50 bytes of memory a byte while it is merged.  An empty table
gives an empty one; equal ranks cannot be: the leftmost of equal pairs is merged first.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import Kept, named, slices

# The pre-token pattern of the vocabulary, with Unicode's White_Space written out.
WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

#: Bytes of a pre-token from which on its symbols are held in arrays.
LONG = 4096
_UNSAFE = re.compile(rf" (?:[{WS}]|\Z)")
_CUT = re.compile(rf" (?=[^{WS}])")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or for unprintable ones the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        symbols = {c: b for b, c in enumerate(byte_symbols())}
        ids: dict[str, int] = dict(symbols)
        # every symbol gets a number; a pair of numbers (left << 20 | right) its rank << 20 | the number of what it becomes
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            for s in (a, b, a + b):
                ids.setdefault(s, len(ids))
            self.pairs.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that take their surroundings are not supported")
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.words = Kept(self.merged)
        self.pieces = Kept(lambda piece: self.pre_tokens(" " + piece), room=96 << 20)

    def merged(self, word: str) -> int:
        """The tokens of one pre-token."""
        sym = word.encode()
        n = count = len(sym)
        kind = list if n < LONG else functools.partial(array, "i")  # lists are quicker, arrays smaller
        sym = kind(iter(sym))
        pairs = self.pairs.get
        # an entry is rank << 32 | position of the left symbol
        heap = [p >> 20 << 32 | i for i in range(n - 1) if (p := pairs(sym[i] << 20 | sym[i + 1]))]
        if not heap:
            return count
        heapify(heap)
        after, before = kind(range(1, n + 1)), kind(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0:
                continue
            p = pairs(sym[i] << 20 | sym[j])
            if p is None or p >> 20 != top >> 32:
                continue  # one of the two has been merged since
            sym[i] = new = p & 0xFFFFF
            sym[j] = -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pairs(new << 20 | sym[k]):
                    heappush(heap, p >> 20 << 32 | i)
            h = before[i]
            if h >= 0 and (p := pairs(sym[h] << 20 | new)):
                heappush(heap, p >> 20 << 32 | h)
        return count

    def pre_tokens(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.pattern.findall(text)))

    def plain(self, text: str) -> int:
        parts = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        first = parts[0]
        parts[0] = parts[-1]  # the first piece has no space before it
        return (self.pre_tokens(first) if first else 0) + (sum(map(self.pieces.__getitem__, parts)) - self.pieces[parts[-1]] if len(parts) > 1 else 0)

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text) if text else 0
        segments = self.special.split(text)
        return len(segments) - 1 + sum(self.plain(s) for s in segments if s)


@functools.cache
def counter(path: str) -> TokenCounter:
    """One a Python worker."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row."""
    docs = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = pa.array([c.count(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has a bit where over half of a text's shingle hashes have it.  Distinct
fingerprints are cut into `blocks` blocks; two within `distance` bits agree on at
least `exact` = blocks - distance whole blocks, so for each choice of `exact` blocks all that
agree on them meet in one trie over the other bits.  The tries of a partition are
joined with themselves: node pairs descend together, the differing bits add up, and a
pair beyond the budget is cut off.  Pairs whose nodes are already in one component are
cut off too, so that a trie yields the edges of a spanning forest and not all pairs of a
dense group.  The forests' components are found by star contraction.

`near_duplicates` links 64-bit fingerprints within a few bits.  `similar_documents` links texts by the similarity of their
sets of shingles: signatures of WORDS fingerprints, each of other bits of the same shingles' hashes.  Two sets of Jaccard similarity s
have a cosine of 2s / (1 + s) or more, so a bit differs at a rate of arccos(2s / (1 + s)) / pi.  Candidates
are pairs for which one of the words' first 32 bits differ in `distance` bits at most, by the same tries; a candidate is a link if
the whole signatures differ in no more bits than that rate gives, and one standard deviation.  So links at the
border are a matter of chance, and candidates too: see README for the recall.

Texts without words have fingerprint 0 and are linked like any other; null counts as empty; an empty table gives an empty one.
Each distinct fingerprint is a node, whatever rows have it; a component's id is the smallest doc_id of its rows, null if none has one.
Equal doc_ids count once.  A very long text costs memory for its words' hashes.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, named, rows_without, slices, stored, utf8
from tidemark.llm.components import components

#: Node pairs that a traversal step holds.
FRONTIER = 1 << 18
#: Hashes whose bits are unpacked at a time.
UNPACK = 1 << 18
#: Fingerprints of a signature, and the bits of each that tries look at.
WORDS, TRIE_BITS = 8, 32


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), 42) for s in zip(*[words[i:] for i in range(width)])]


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes (uint64) that ends at `ends`; 0 for empty runs."""
    counts = np.zeros((len(ends), 64), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    for at in range(0, len(hashes), UNPACK):
        part = hashes[at : at + UNPACK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.clip(starts - at, 0, len(part)), np.clip(ends - at, 0, len(part))
        rows = np.flatnonzero(hi > lo)
        if len(rows):
            counts[rows] += np.add.reduceat(bits, lo[rows], axis=0, dtype=np.int32)
    set_bits = (2 * counts > (ends - starts)[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""
    docs = docs.select(named(id_col).alias("doc_id"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            runs = [np.array(shingle_hashes(t, width), np.uint64) for t in part.column(1).to_pylist()]
            fp = majority(np.concatenate(runs) if runs else np.zeros(0, np.uint64), np.cumsum([len(r) for r in runs], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th other 64 bits of each hash, by the finalizer of splitmix64."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signatures(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words (WORDS fingerprints of the set of shingles, as signed longs) of each row."""
    docs = docs.select(named(id_col).alias("doc_id"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            runs = [np.unique(np.array(shingle_hashes(t, width), np.uint64)) for t in part.column(1).to_pylist()]
            ends = np.cumsum([len(r) for r in runs], dtype=np.int64)
            flat = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
            words = np.stack([majority(mixed(flat, k), ends) for k in range(WORDS)], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(len(runs) + 1, dtype=np.int32) * WORDS, pa.array(words.ravel()))], ["doc_id", "words"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words array<long>")


class _Forest:
    """Component labels of positions, the smallest position of each; edges that joined two components are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            hi, lo = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort((lo, hi))
            first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]  # one hook a component and turn: no cycles
            self.edges.append(np.stack([a[first], b[first]]))
            parent = np.arange(len(self.label))
            parent[hi[first]] = lo[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]


def trie_pairs(group: np.ndarray, fp: np.ndarray, distance: int, bits: int = 64, total: int | None = None) -> np.ndarray:
    """Edges (2 x n positions) of a spanning forest of all links inside groups; fp sorted within the sorted groups, distinct there.

    A link differs in distance of the first `bits` bits at most, and in `total` (default: distance) of all.
    """
    total = distance if total is None else total
    top = np.uint64((1 << 64) - (1 << 64 - bits))
    n = len(fp)
    forest = _Forest(n)
    zeros = np.zeros((64, n + 1), np.int32)  # how many before a position have a 0 at a bit
    for bit in range(64):
        np.cumsum((fp >> np.uint64(63 - bit)) & np.uint64(1) == 0, out=zeros[bit, 1:])
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    big = ends - starts > 1
    # a node pair: ranges [alo, ahi), [blo, bhi), the bit to look at, the differing bits so far
    roots = np.stack([starts[big], ends[big], starts[big], ends[big], np.zeros(big.sum(), np.int64), np.zeros(big.sum(), np.int64)])
    stack = [roots[:, i : i + FRONTIER] for i in range(0, roots.shape[1], FRONTIER)]
    changed = True
    while stack:
        alo, ahi, blo, bhi, bit, err = pairs = stack.pop()
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():  # two leaves: the rest of their bits at once
            a, b = alo[single], blo[single]
            apart = fp[a] ^ fp[b]
            near = (a != b) & (np.bitwise_count(apart & top) <= distance) & (np.bitwise_count(apart) <= total)
            if near.any():
                forest.add(a[near], b[near])
                changed = True
            alo, ahi, blo, bhi, bit, err = pairs = pairs[:, ~single]
        if not pairs.shape[1]:
            continue
        if changed:  # where the run of equal labels ends that a position is in
            breaks = np.flatnonzero(forest.label[1:] != forest.label[:-1]) + 1
            run_end = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n), "right")]
            changed = False
        joined = (run_end[alo] >= ahi) & (run_end[blo] >= bhi) & (forest.label[alo] == forest.label[blo])
        alo, ahi, blo, bhi, bit, err = pairs[:, ~joined]
        if not len(alo):
            continue
        amid, bmid = alo + zeros[bit, ahi] - zeros[bit, alo], blo + zeros[bit, bhi] - zeros[bit, blo]
        same = (alo == blo) & (ahi == bhi)
        out = []
        for x0, x1, y0, y1, cost, once in ((alo, amid, blo, bmid, 0, False), (amid, ahi, bmid, bhi, 0, False), (alo, amid, bmid, bhi, 1, False), (amid, ahi, blo, bmid, 1, True)):
            ok = (x1 > x0) & (y1 > y0) & (err + cost <= np.where(bit < bits, distance, total)) & ~(same & once)
            ok &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))  # a leaf with itself
            out.append(np.stack([x0[ok], x1[ok], y0[ok], y1[ok], bit[ok] + 1, err[ok] + cost]))
        nxt = np.concatenate(out, axis=1)
        stack += [nxt[:, i : i + FRONTIER] for i in range(0, nxt.shape[1], FRONTIER)]
    return np.concatenate(forest.edges, axis=1) if forest.edges else np.zeros((2, 0), np.int64)


def links(distinct: DataFrame, distance: int = 3, blocks: int | None = None, bits: int = 64, total: int | None = None) -> DataFrame:
    """Edges (a, b) between ids of distinct (fp, id) whose fingerprints are within distance; they connect all that are linked.

    With a column w, only fingerprints of one w are compared.  bits and total: see trie_pairs; equal fingerprints of two ids are linked.

    More blocks make smaller tries in more tables: blocks choose distance tables, each with 64 * (1 - distance / blocks) key
    bits.  By default distance + 1 blocks, and two more from 2^28 fingerprints on.  A trie of more than a 40th of all
    fingerprints (2^18 at most) is cut into chunks, and each pair of chunks is joined by a task of its own.
    """
    n = distinct.count()
    blocks = blocks or distance + (1 if n < 1 << 28 else 3)
    if blocks <= distance:
        raise ValueError("a pair within distance needs a block in common: blocks > distance")
    bounds = [bits * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        m = 0
        for c in chosen:
            m |= ((1 << bounds[c + 1] - bounds[c]) - 1) << 64 - bounds[c + 1]
        masks.append(m - (1 << 64) if m >> 63 else m)
    tables = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    w = F.col("w") if "w" in distinct.columns else F.lit(0)
    keyed = distinct.select("fp", "id", w.alias("w"), F.explode(tables).alias("k")).select((F.col("w") * len(masks) + F.col("k.t")).cast("int").alias("t"), "k.key", "fp", "id")
    most = min(max(n // 40, 64), 1 << 18)
    # at most len(masks) * n / most rows, so a broadcast is safe
    large = stored(keyed.groupBy("t", "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > most), "large")
    chunks = F.ceil(F.col("_n") / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    pairs = F.when(F.col("_n").isNull(), F.array(F.lit(-1))).otherwise(pairs)
    keyed = keyed.join(F.broadcast(large), ["t", "key"], "left").select("t", "key", F.explode(pairs).alias("pair"), "fp", "id")
    parted = keyed.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair", "fp")
    kind = distinct.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def group_of(batch) -> list[np.ndarray]:
            return [batch.column(i).to_numpy() for i in range(3)]

        def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            fp = table.column(3).to_numpy().view(np.uint64)
            change = np.any([c[1:] != c[:-1] for c in group_of(table)], axis=0)
            group = np.concatenate([[0], np.cumsum(change)])
            order = np.lexsort((fp, group))  # signed order becomes bit order
            group, fp = group[order], fp[order]
            again = np.concatenate([[False], (fp[1:] == fp[:-1]) & (group[1:] == group[:-1])])  # linked to the one before, and left out of the tries
            once = np.flatnonzero(~again)
            a, b = trie_pairs(group[once], fp[once], distance, bits, total)
            a, b = np.concatenate([once[a], np.flatnonzero(again) - 1]), np.concatenate([once[b], np.flatnonzero(again)])
            ids = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(order[a])), ids.take(pa.array(order[b]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # all but the last group, which may go on in the next batch
            columns = group_of(batch)
            before = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
            cut = int(before[-1]) + 1 if len(before) else 0
            if held and (cut or any(h.column(i)[-1] != batch.column(i)[0] for i in range(3) for h in held[-1:])):
                goes_on = cut if cut and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(3)) else 0
                yield from joined([*held, batch.slice(0, goes_on)])
                held, batch, cut = [], batch.slice(goes_on), cut - goes_on
            if cut:
                yield from joined([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from joined(held)

    return parted.mapInArrow(run, f"a {kind}, b {kind}")


def _component_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component_id (the smallest id in its component) from nodes (node, id: the smallest of its rows) and edges (a, b) between them."""
    roots = components(edges)
    rooted = stored(nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    # both sides are plain scans, so that Spark can split a large component
    out = stored(rooted.join(least, "root").select("node", "component_id"), "named")
    discard(rooted, least)
    return out


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links) of each row."""
    fp = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    # equal fingerprints are one node, named by their bits; partial minima before the shuffle
    nodes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumnRenamed("fp", "node"), "nodes")
    known = _component_ids(nodes, links(nodes.select(F.col("node").alias("fp"), F.col("node").alias("id")), distance, blocks))
    # both sides are plain scans, so that Spark can split a fingerprint that many rows share
    out = fp.join(known, F.col("fp") == F.col("node"), "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def most_bits(similarity: float) -> int:
    """The bits of a signature in which two texts of that similarity differ, and one standard deviation more."""
    n, rate = WORDS * 64, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(n * rate + np.sqrt(n * rate * (1 - rate)))


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, distance: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links) of each row; links: sets of shingles of that Jaccard similarity or more, as far as signatures tell."""
    rows = stored(signatures(docs, width, id_col, text_col).withColumn("node", F.xxhash64("words")), "signatures")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("words").alias("words")), "nodes")
    word = nodes.select(F.col("node").alias("id"), F.posexplode("words").alias("w", "fp"))
    most = most_bits(similarity)
    # beyond the trie's bits a word may have as many more as are likely in its other half
    half = most / (2 * WORDS)
    pairs = stored(links(word, distance, blocks, TRIE_BITS, distance + int(half + 4 * np.sqrt(half))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    of = lambda name: nodes.select(F.col("node").alias(name), F.col("words").alias(f"words_{name}"))
    apart = F.aggregate(F.zip_with("words_a", "words_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    edges = pairs.join(of("a"), "a").join(of("b"), "b").filter(apart <= most).select("a", "b")
    known = _component_ids(nodes, edges)
    out = rows.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")
    discard(pairs)
    return out


def _first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose doc_id is the smallest of a component that it is in; equal ids go or stay together, and so do rows without, which stay if some have no row with an id in their component."""
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows_without(docs, groups.groupBy("doc_id").agg(stays.alias("stays")).filter("NOT stays").select("doc_id"), "doc_id")


def one_of_each_group(docs: DataFrame, distance: int = 3, width: int = 3, blocks: int | None = None) -> DataFrame:
    """One document of each component of near_duplicates: see _first_of_each."""
    return _first_of_each(docs, near_duplicates(docs, distance, width, blocks))


def one_of_each_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One document of each component of similar_documents: see _first_of_each."""
    return _first_of_each(docs, similar_documents(docs, similarity, width))

"""Toxic passages as maximum-scoring segments of token log-odds.

Learning reads a bounded sample of labelled rows (`sample` rows at most, by a hash of the
id) that are not held out, in two parts, three to one.  On the first, every word gets the log-odds of
the label against the base rate, its rate shrunk by a two-class Dirichlet prior to the rate of
words with the same first bytes, and that in turn to a shorter beginning and the base rate.
Texts that look like copies of each other share one text's weight.  On the second, the extreme-value parameters and the calibration are fitted, so
that no word is judged by texts that it was learned from.

Scoring adds the log-odds, less a drift, along a text.  One linear scan finds all
maximal scoring segments (Ruzzo and Tompa).  A segment's E-value, K n exp(-lambda S), is the number of
segments so good that a clean text of n words has by chance; those below `significance` are
passages.  A text's evidence, the sum of -log E over its passages (or that of its best segment), becomes a
probability by a logistic curve.

Null and empty texts have no segment and get the lowest evidence.  Labels of null id or null value
are left out; an id with several labels counts as toxic if one says so; each input row gets a row.  Of equally good segments the
shortest, then the first is meant.  Empty tables: without labels all texts get the same low score, no documents give no rows.  A very long text costs
memory for its words' scores.  Other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Kept, crc32_of_id, slices, stored, utf8
from tidemark.llm.decontaminate import words
from tidemark.llm.simhash import shingle_hashes

#: Beginnings of words that stand in for unseen ones, in bytes, longest first.
BEGINNINGS = (6, 5, 4)
#: Weight, in documents, of a word's prior and of a beginning's.
PRIOR = {"word": 4.0, "beginning": 12.0}
#: What every word costs, so that clean text drifts down.
DRIFT = 2.0
#: Evidence of texts without a segment, and the most that counts.
EVIDENCE = (-12.0, 40.0)
#: Independent least hashes of a text's three-word shingles, by which copies are recognised.
SKETCH = 4
#: Bytes of text whose words a task counts before it hands them on.
FLUSH_BYTES = 24 << 20


class TokenScores(Kept):
    """Log-odds less drift, by word; unseen words take that of their longest known beginning."""

    def __init__(self, seen: dict[bytes, float], beginnings: dict[bytes, float]):
        super().__init__(self.by_beginning, known=seen)
        self.beginnings = beginnings

    def by_beginning(self, word: bytes) -> float:
        return next((v for n in BEGINNINGS if len(word) >= n and (v := self.beginnings.get(word[:n])) is not None), -DRIFT)


def learn(counts: dict[bytes, tuple[float, float]], beginnings: dict[bytes, tuple[float, float]], base: float) -> tuple[dict, dict]:
    """Scores of words and beginnings from their (toxic, clean) weights of documents."""
    rate: dict[bytes, float] = {}

    def prior(key: bytes, lengths: tuple[int, ...]) -> float:
        return next((rate[key[:n]] for n in lengths if len(key) >= n and key[:n] in rate), base)

    for key in sorted(beginnings, key=len):
        a, b = beginnings[key]
        w = PRIOR["beginning"]
        rate[key] = (a + w * prior(key, tuple(n for n in BEGINNINGS if n < len(key)))) / (a + b + w)
    odds = lambda p: math.log(p / (1 - p)) - math.log(base / (1 - base)) - DRIFT
    seen = {}
    for key, (a, b) in counts.items():
        w = PRIOR["word"]
        seen[key] = odds((a + w * prior(key, BEGINNINGS)) / (a + b + w))
    return seen, {k: odds(p) for k, p in rate.items()}


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), by Ruzzo and Tompa's linear scan.

    Neighbouring words of one sign are one step of the scan, which changes no segment.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    positive = scores > 0
    starts = np.flatnonzero(positive & ~np.concatenate([[False], positive[:-1]]))
    ends = np.flatnonzero(positive & ~np.concatenate([positive[1:], [False]])) + 1
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, sum before, sum after
    for s, e in zip(starts.tolist(), ends.tolist()):
        new = [s, e, total[s], total[e]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(float(b - a), s, e) for s, e, a, b in stack]


class Extremes:
    """lambda and K of the segment scores of clean text."""

    def __init__(self, scores: dict[float, int], best: list[tuple[int, float]]):
        """scores: how many clean words have a score; best: (words, best segment score) of clean texts."""
        x, n = np.array(list(scores)), np.array(list(scores.values()), float)
        p = n / n.sum()
        lo, hi = 1e-3, 1.0
        moment = lambda t: float((p * np.exp(np.minimum(t * x, 600))).sum())
        while moment(hi) < 1 and hi < 50:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if moment(mid) < 1 else (lo, mid)
        self.rate = (lo + hi) / 2
        tails = [n * math.exp(-self.rate * s) for n, s in best if n]
        self.k = len(tails) / sum(tails) if tails else 1.0

    def log_e(self, score: float, n: int) -> float:
        return math.log(self.k * max(n, 1)) - self.rate * score


def evidence(found: list[tuple[float, int, int]], n: int, extremes: Extremes, significance: float) -> float:
    if not found:
        return EVIDENCE[0]
    logs = [-extremes.log_e(s, n) for s, *_ in found]
    passages = [x for x in logs if x > -math.log(significance)]
    return float(np.clip(sum(passages) if passages else max(logs), *EVIDENCE))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with backtracking.

    A slight ridge gives separable samples a solution, with the boundary midway between the classes.
    """
    design, ridge = np.stack([np.ones(len(x)), x], axis=1), np.array([1e-4, 1e-2])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * w * w).sum())

    w = np.array([-1.0, 0.1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (p - y) + ridge * w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge), grad)
        size, now = 1.0, loss(w)
        while size > 1e-8 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if size * abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]), 0.0)


class Model:
    def __init__(self, seen: dict, beginnings: dict, significance: float):
        self.seen, self.beginnings, self.significance = seen, beginnings, significance
        self.extremes, self.curve = Extremes({-DRIFT: 1, DRIFT: 1}, []), (-3.0, 1.0)

    def ready(self) -> TokenScores:
        """One a Python worker and model."""
        if not hasattr(self, "_scores"):
            self._scores = TokenScores(self.seen, self.beginnings)
        return self._scores

    def scan(self, text: bytes) -> tuple[np.ndarray, list[tuple[float, int, int]]]:
        scores = np.array(list(map(self.ready().__getitem__, words(text))))
        return scores, segments(scores)

    def probability(self, x: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_scores"}


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, y, half (1: for calibration) of the sampled training rows.  The sampled labels are bounded, so their side is broadcast."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(F.pmod(crc32_of_id(), F.lit(3)) != 1)
    y = y.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    share = min(1.0, 0.95 * sample / max(1, y.count()))
    if share < 1:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    y = y.withColumn("half", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).cast("int"))
    return docs.select("doc_id", utf8().alias("text")).join(F.broadcast(y), "doc_id")


def weighted(train: DataFrame) -> DataFrame:
    """train with a weight: one over the number of sampled texts that look like copies of a text, so that a group of copies counts about once.

    Copies share most shingles and so, nearly always, one of SKETCH least hashes; the largest group that a text shares one with counts.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 for i in range(SKETCH)], np.uint64)
        for part in slices(batches):
            out = []
            for t in part.column(1).to_pylist():
                h = np.array(shingle_hashes(t, 3) or [0], np.uint64)
                out.append([int(x) for x in ((h[:, None] ^ salts) * np.uint64(0xFF51AFD7ED558CCD)).min(axis=0).view(np.int64)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    kind = train.schema["doc_id"].dataType.simpleString()
    sketch = train.select("doc_id", "text").mapInArrow(sketched, f"doc_id {kind}, sketch array<long>").select("doc_id", F.posexplode("sketch").alias("i", "h"))
    size = sketch.groupBy("i", "h").agg(F.count_distinct("doc_id").alias("n"))
    weight = stored(sketch.join(size, ["i", "h"]).groupBy("doc_id").agg((1 / F.max("n")).alias("weight")), "weights")
    return train.join(F.broadcast(weight), "doc_id")  # one row a sampled id


def _features(total: Counter, texts: list[bytes], ys: list[int], weights: list[float]) -> None:
    for t, y, w in zip(texts, ys, weights):
        distinct = set(words(t))
        beginnings = {x[:n] for x in distinct for n in BEGINNINGS if len(x) >= n}
        for key in [*((0, x, y) for x in distinct), *((1, x, y) for x in beginnings)]:
            total[key] += w


def fit(docs: DataFrame, labels: DataFrame, sample: int = 120_000, significance: float = 0.01, least: float = 2.0) -> Model:
    """The model; words and beginnings in sampled texts of less than `least` weight are left to their prior."""
    spark = docs.sparkSession
    train = labelled(docs, labels, sample)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = Counter(), 0
        for part in slices(batches):
            texts = part.column(0).to_pylist()
            _features(total, texts, *(part.column(i).to_pylist() for i in (1, 2)))
            size += sum(map(len, texts))
            if size > FLUSH_BYTES:
                yield _counter_batch(total)
                total.clear()
                size = 0
        yield _counter_batch(total)

    first = train.filter("half = 0")
    shape = "kind int, token binary, toxic double, clean double"
    sums = weighted(first).select("text", "y", "weight").mapInArrow(counted, shape).groupBy("kind", "token").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n_toxic, n = first.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    base = min(max((n_toxic + 0.5) / (n + 1), 1e-4), 0.5)
    # a clean word needs no entry of its own when its rate is about the base rate's or lower
    said = sums.filter((F.col("a") + F.col("b") >= least) & (F.col("a") > 1.5 * base * (F.col("a") + F.col("b"))))
    by: dict[int, dict] = {0: {}, 1: {}}
    for r in said.toLocalIterator():
        by[r["kind"]][bytes(r["token"])] = (r["a"], r["b"])
    model = Model(*learn(by[0], by[1], base), significance)

    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for part in slices(batches):
            ns, best, sums, hist = [], [], [], Counter()
            for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                scores, found = m.scan(t)
                ns.append(len(scores))
                best.append([s for s, *_ in found])
                if not y:
                    hist.update(np.round(scores, 1).tolist())
            yield pa.RecordBatch.from_arrays([
                part.column(1), pa.array(ns, pa.int64()), pa.array(best, pa.list_(pa.float64())),
                pa.array([list(hist) if i == 0 else [] for i in range(len(ns))], pa.list_(pa.float64())), pa.array([list(hist.values()) if i == 0 else [] for i in range(len(ns))], pa.list_(pa.int64())),
            ], ["y", "n", "found", "score", "times"])

    rows = train.filter("half = 1").select("text", "y").mapInArrow(measured, "y int, n long, found array<double>, score array<double>, times array<long>").collect()  # bounded by the sample
    hist: Counter = Counter()
    for r in rows:
        for s, k in zip(r["score"], r["times"]):
            hist[s] += k
    if hist and rows:
        model.extremes = Extremes(dict(hist) | {DRIFT: hist.get(DRIFT, 0) + 1}, [(r["n"], max(r["found"], default=0.0)) for r in rows if not r["y"]])
        x = np.array([evidence([(s, 0, 0) for s in r["found"]], r["n"], model.extremes, significance) for r in rows])
        model.curve = logistic(x, np.array([r["y"] for r in rows], float))
    return model


def _counter_batch(total: Counter) -> pa.RecordBatch:
    rows = [(k, t, n if y else 0.0, 0.0 if y else n) for (k, t, y), n in total.items()]
    kind, token, a, b = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(token, pa.binary()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["kind", "token", "toxic", "clean"])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages (start and end word, -log E) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("significance", pa.float64())])
        for part in slices(batches):
            out, passages = [], []
            for t in part.column(1).to_pylist():
                scores, found = m.scan(t)
                out.append(m.probability(evidence(found, len(scores), m.extremes, m.significance)))
                logs = [(s, e, -m.extremes.log_e(v, len(scores))) for v, s, e in found]
                passages.append([{"start": s, "end": e, "significance": x} for s, e, x in logs if x > -math.log(m.significance)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64()), pa.array(passages, pa.list_(passage))], ["doc_id", "score", "passages"])

    scored = docs.select("doc_id", utf8().alias("text")).mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start: long, end: long, significance: double>>")
    return scored.select(
        "doc_id", (F.pmod(crc32_of_id(), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"), "passages",
    )

"""Line deduplication against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import line_dedup as ld


def brute(rows, min_words=8):
    """(doc, line_no): near, of the lines that go."""
    order = sorted(((d is None, d if d is not None else 0, i, line) for d, text in rows for i, line in enumerate((text or "").split("\n")) if line.encode().split()), key=lambda x: x[:3])
    first, by, near_of, out = {}, defaultdict(list), {}, {}
    for none, d, i, line in order:
        w = tuple(line.encode().split())
        pos = (none, d, i)
        if w not in first:
            first[w] = pos
            near_of[w] = len(w) >= min_words and any(ld.one_edit(list(w), list(o)) for n in (len(w) - 1, len(w), len(w) + 1) for o in by[n])
            by[len(w)].append(w)
        if near_of[w] or first[w] != pos:
            out[None if none else d, i] = first[w] == pos
    return out


def gone(df):
    return {(r["doc"], r["line_no"]): r["near"] for r in ld.duplicate_lines(df).collect()}


def test_random_edits(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    lines = [[rng.choice(words) for _ in range(rng.randint(6, 40))] for _ in range(60)]
    rows = []
    for d in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, how = rng.randrange(len(line)), rng.random()
                line[at : at + (how < 0.6)] = [] if how < 0.3 else [rng.choice(words)]
            text.append(" ".join(line))
        rows.append((d, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(want.values()) > 20 and gone(df) == want


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b\n\n a  b \nc"), (4, "a b"), (4, "a b"), (None, "c\nd é"), (5, long), (6, long + " y"), (7, "É É É É É É É É\nÉ É É É É É É É É"), (8, "é é é é é é é é")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("near", T.StringType()), T.StructField("_drop", T.ArrayType(T.IntegerType()))])
    df = spark.createDataFrame([(*r, "keep", [1]) for r in rows], schema)
    assert gone(df) == brute(rows) == {(3, 2): False, (4, 0): False, (None, 0): False, (6, 0): True, (7, 1): True}
    out = ld.dedup_lines(df)
    assert out.schema == df.schema
    got = sorted((str(r["doc_id"]), r["text"]) for r in out.collect())
    assert ("1", None) in got and ("2", "") in got and ("3", "a b\n\nc") in got and ("None", "d é") in got and got.count(("4", "")) == 2 and ("6", "") in got
    kept = ld.without_repeats(df)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "7", "8", "None"] and kept.columns == df.columns
    assert ld.dedup_lines(df.limit(0), report=True).count() == 0


def test_one_template(spark):
    """Lines that all differ in one word: each goes but the first."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("posted by user "), F.col("id"), F.lit(" on a day of the year at noon")).alias("text"))
    assert len(gone(df)) == 399

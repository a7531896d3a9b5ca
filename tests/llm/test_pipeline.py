"""The pipeline stage by stage against plain Python, over whole small tables."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_operators import shingle_set
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontaminate
from tidemark.llm.common import stored

SF = "/root/testdata/sf0.001"


def repeat_words(w):
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)})


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r.asDict() for r in table.collect()}

    def step(name, docs):
        out = stored(stages[name](spark, docs, SF), "test")
        assert out.columns == table.columns, name
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    # quality: no host's rate is high enough here to go as a whole unless its own rows say so
    want, failed = {}, {}
    for i, r in rows.items():
        w = (r["text"] or "").encode().split()
        bad = len(w) < 50 or 100 * repeat_words(w) > 50 * len(w)
        failed.setdefault(r["source"], []).append(bad)
        if not bad:
            want[i] = r["text"]
    docs, kept = step("quality_rules", table)
    lost = {rows[i]["source"] for i in want.keys() - kept.keys()}
    assert kept.items() <= want.items() and all(np.mean(failed[s]) > 0.4 for s in lost)
    assert not any(rows[i]["source"] in lost for i in kept)
    # lines
    gone = brute_lines(list(kept.items()))
    want = {}
    for i, text in kept.items():
        left = "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone)
        if left == text or left.encode().split():
            want[i] = left
    docs, kept = step("line_dedup", docs)
    assert kept == want
    # near duplicates
    sets = {i: shingle_set(t) for i, t in kept.items()}
    similar = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    docs, after = step("simhash_near_dedup", docs)
    assert after.items() <= kept.items()
    for i in kept.keys() - after.keys():
        assert any(similar(i, j) >= 0.65 for j in kept if j < i), i
    left = sorted(after)
    assert not any(similar(i, j) >= 0.85 for n, i in enumerate(left) for j in left[:n])
    # benchmark
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        b = decontaminate.words((r["text"] or "").encode())
        n = min(10, len(b))
        grams |= {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
    sizes = {len(g) for g in grams}

    def dirty(text):
        w = decontaminate.words(text.encode())
        return any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))

    docs, kept = step("decontamination", docs)
    assert kept == {i: t for i, t in after.items() if not dirty(t)}
    # packing
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for i, t in kept.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        pieces |= {(i, k): (at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    out = stages["packing"](spark, docs, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == pieces
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of in places.values():
        at = 0
        for offset, n in sorted(of):
            assert offset == at
            at += n
        assert at <= 4096


def test_run_and_odd_tables(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() and {"doc_id", "piece", "sequence_id"} <= set(packed.columns)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = table.limit(30).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, "")).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).withColumn("_rejected", F.lit(1)).withColumn("may.be", F.lit(2))
    for some in (table.limit(0), odd):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, some, SF)
            assert out.columns == some.columns and out.count() <= some.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() >= some.count()

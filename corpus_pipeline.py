"""From raw documents to packed training sequences: five stages, each an operator of tidemark.llm.

Every stage reads what the one before has kept, written as Parquet; all but the last return
documents' columns.  Part of the tidemark.llm subpackage, whose fate it shares.

In every stage: null texts have no words, so quality rules drop them, and later stages leave them as they are; an empty table
gives an empty one; rows of one id (and rows without) are one document, which goes or stays; of equals the smallest id stays; extra
columns are kept whatever their names; very long texts are taken whole, a row at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, line_dedup, packing, quality, simhash
from tidemark.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail by their text or by their host."""
    return quality.keep(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; documents that consisted of such lines go."""
    return line_dedup.without_repeats(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of five-word shingles have a similarity of 0.8 or more, the document with the smallest id."""
    return simhash.one_of_each_similar(docs, similarity=0.8, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a ten-word window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]

#: Near-line links, SimHash and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the training-data operators, over whole tables, and their SQL where there is any.

These are thin: each takes its rows from its operator and derives the digest columns from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, line_dedup, packing, quality, simhash, suffix_tree, token_counts, toxicity, url_filter, warc

#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near, emptied, kept_sha256 (of the text that is left)."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_equal", "n_near", "emptied", F.sha2("text", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"))).drop("passages")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).drop("host_kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.contents(spark, warc.archive(_table(spark, sf_dir, "pages")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_score, op2_decontaminate, op3_line_dedup, op4_url_filter, op5_toxicity, op6_simhash, op7_quality, op8_warc, op9_packing, op10_token_counts)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_WORD = r"'[^\x20\x09-\x0D]+'"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM d, lengths, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
m AS (SELECT row, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
hit AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) t(k) GROUP BY row),
items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)""",
    "op4_url_filter": rf"""
WITH r(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT row_number() OVER () AS row, page_id, {_FOLD.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT row, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host) * 100000 + length(r.path)) AS best
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY row)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (row)""",
    "op7_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, host, text, regexp_extract_all(text, {_WORD}) AS w, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM d),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM w, unnest(range(1, len(w) - 1)) t(i) WHERE len(w) > 2),
twice AS (SELECT row, gram FROM g GROUP BY row, gram HAVING count(*) > 1),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM g JOIN twice USING (row, gram), unnest(range(0, 3)) t(k) GROUP BY row),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (row)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY host),
t AS (SELECT sum(n) AS n, sum(failed) / sum(n) AS m, count(*) AS k FROM h),
s AS (SELECT any_value(t.m) AS m, any_value(t.k) AS k, (sum(h.n * pow(h.failed / h.n - t.m, 2)) - any_value(t.m * (1 - t.m) * (t.k - 1))) / greatest(any_value(t.n - t.n / t.k), 1) AS between_hosts FROM h, t),
p AS (SELECT m, CASE WHEN k > 1 AND between_hosts > 0 THEN least(greatest(m * (1 - m) / between_hosts - 1, 1), 10000) ELSE 10000 END AS strength FROM s),
v AS (SELECT host, (failed + m * strength) / (n + strength) <= 0.5 AS host_kept FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM f JOIN v USING (host)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
five AS (SELECT h, first, list_transform(range(8), lambda i: CAST('0x' || substr(h, i * 5 + 1, 5) AS INTEGER)) AS v FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN five USING (h)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

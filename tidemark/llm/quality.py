"""Quality rules by text and by host, in DataFrame expressions only.

A text fails by its own words: fewer than `least_words`, or more than half of them in
three-word windows that come twice or more.  Failures are added up by host (the source column),
each host's rate is shrunk by a beta prior fitted to all hosts, and texts of hosts whose shrunken
rate exceeds `most_failed` go too.

Null texts have no words and fail; a null host is a host of its own; repeated rows count as
often as they come.  Window repeats are found by sorting a text's window hashes with their
positions, so the cost of a long text is that of a sort.  An empty table gives an empty one; hosts' ties don't matter, as
verdicts are by rate alone.  `keep` returns the table's own columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named, stored

#: Host tables of at most so many rows are broadcast; larger ones are joined by host.
BROADCAST_HOSTS = 500_000
SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated_positions(hashes: Column) -> Column:
    """Positions (from 0) of the hashes that come twice or more.

    Hash bits and position share a long, which sorts as a plain array.  The bits that the position displaces are
    checked by a second sort on the other end of the hash.  Texts of up to 2^20 windows give it 20 bits, longer ones 30.
    """

    def with_bits(bits: Column) -> Column:
        left, right = (lambda v, f=f: F.call_function(f, v, bits) for f in ("shiftleft", "shiftright"))
        mask = left(F.lit(1).cast("long")) - 1

        def doubles(pack: Callable[[Column, Column], Column]) -> Column:
            def found(s: Column) -> Column:
                code = lambda i: right(F.get(s, i))
                same = F.filter(s, lambda v, i: F.coalesce(right(v) == code(i - 1), F.lit(False)) | F.coalesce(right(v) == code(i + 1), F.lit(False)))
                return F.transform(same, lambda v: v.bitwiseAND(mask))

            return _let(F.sort_array(F.transform(hashes, lambda h, i: pack(h, i.cast("long")))), found)

        high = doubles(lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i))
        low = doubles(lambda h, i: left(h).bitwiseOR(i))
        return F.array_intersect(high, low)

    return _let(F.when(F.size(hashes) < 1 << 20, 20).otherwise(30), with_bits)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more."""
    n = F.size(words)
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        spread = lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(_repeated_positions(h), spread)).otherwise(0)

    return _let(windows, covered)


def measures(text: Column, least_words: int = 50) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    by_words = _let(
        F.array_remove(F.split(text, SPACES), ""),
        lambda words: F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words).cast("long").alias("n_repeat_words")),
    )
    dup_lines = _let(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    return _let(by_words, lambda m: F.struct(
        m["n_words"].alias("n_words"), F.char_length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        ((m["n_words"] < least_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])).alias("base_failed"),
    ))


def host_verdicts(judged: DataFrame, most_failed: float = 0.5) -> DataFrame:
    """host, n, failed, rate (shrunk), host_kept, from rows of host and base_failed.

    The beta prior has the mean m of all rows; its strength comes from the variance of the hosts' rates around m
    beyond what m itself makes in hosts of their size, and lies between 1 and 10,000 rows.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = stored(hosts, "hosts")
    n, failed, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0)), F.count("*")).first()
    m = failed / n if n else 0.0
    spread = hosts.agg(F.coalesce(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - m, 2)), F.lit(0.0))).first()[0]
    between = (spread - m * (1 - m) * (k - 1)) / max(n - n / max(k, 1), 1) if k > 1 else 0.0
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e4) if between > 0 else 1e4
    rate = (F.col("failed") + m * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate <= most_failed).alias("host_kept"))


def _with_verdict(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows with host_kept; rows have a column host that is never null."""
    side = hosts.select(F.col("host").alias("_host"), "host_kept")
    side = F.broadcast(side) if hosts.count() <= BROADCAST_HOSTS else side
    return rows.join(side, F.col("host") == F.col("_host"), "left").drop("_host")


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), named(host_col)), F.lit(""))


def quality(docs: DataFrame, least_words: int = 50, most_failed: float = 0.5, host_col: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, host_rate's verdict host_kept, and kept, of each row."""
    rows = stored(docs.select("doc_id", _host(host_col).alias("host"), measures(F.col("text"), least_words).alias("m")).select("doc_id", "host", "m.*"), "measures")
    out = _with_verdict(rows, host_verdicts(rows, most_failed))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host")


def keep(docs: DataFrame, least_words: int = 50, most_failed: float = 0.5, host_col: str = "source") -> DataFrame:
    """The rows that are kept, by their own text's measures and their host's verdict.  Texts are measured once; those that pass are written meanwhile."""
    failed = measures(F.col("text"), least_words)["base_failed"]
    row = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])  # by place: whatever a column is called
    judged = stored(docs.select(_host(host_col).alias("host"), _let(failed, lambda f: F.struct(f.alias("failed"), F.when(~f, row).alias("row"))).alias("m")).select("host", F.col("m.failed").alias("base_failed"), "m.row"), "judged")
    rejected = host_verdicts(judged, most_failed).filter(~F.col("host_kept")).select(F.col("host").alias("_host"))
    side = F.broadcast(rejected) if rejected.count() <= BROADCAST_HOSTS else rejected
    kept = judged.filter(~F.col("base_failed")).join(side, F.col("host") == F.col("_host"), "left_anti")
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

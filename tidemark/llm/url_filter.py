"""URL rules by a sort-merge range join, in DataFrame expressions only.

A rule is a host with a path prefix and a verdict; it fits its host and all subdomains.  The
canonical key of a host and path is the host's labels reversed, a byte that no UTF-8 text has, and the path, so that a
rule is the interval of keys that begin with its own.  A url has one key for each suffix of
its host.  Rules' starts and ends and urls' keys are sorted together and swept once: intervals are
nested, so what is on top of the stack of open rules after a start is that rule and after
an end its parent, which is worked out on the rules beforehand; the top at a url's key is
the longest rule that fits at that level.  The longest host with a rule wins, then the
longest path.

The sweep is partitioned by the level's host and a salt of the url.  A host (or com) has one salt for each SWEEP_ROWS of its
urls, or each SWEEP_PART-th of all urls if that is less, counted beforehand, and its rules are copied to each: no sweep grows with the
corpus, none takes much longer than others, and rules of small hosts are not copied.

Null urls and urls without :// have an empty host and path, no rule, and the default
verdict.  Of rules for one host and path, block wins.  Repeated rows each get their verdict.  Without rules every url gets the
default, an empty table of pages gives an empty one.  A very long url is one key for each level that rules have, however many labels
it has.  Other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import named, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls of one host that a sweep takes, about, and the part of all urls; hosts with more are cut.
SWEEP_ROWS, SWEEP_PART = 1_000_000, 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _reversed(host: Column, levels: Column | None = None) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.array_join(labels if levels is None else F.slice(labels, F.lit(1), levels), ".")


def _key(reversed_host: Column, path: Column) -> Column:
    return F.concat(reversed_host.cast("binary"), F.lit(b"\xfe").cast("binary"), path.cast("binary"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict for each row.  rules: host, path, verdict."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter(F.col("host").isNotNull())
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict")
    # the parent: the longest rule of the same host that begins the rule's path
    shorter = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), rule.alias("_rule"))
    heads = rules.select("host", "path", F.explode(F.sequence(F.lit(0), F.char_length("path"))).alias("n")).filter(F.col("n") < F.char_length("path"))
    parents = heads.join(shorter, (F.col("host") == F.col("_host")) & (F.substring("path", F.lit(1), F.col("n")) == F.col("_path")))
    parents = parents.groupBy("host", "path").agg(F.max_by("_rule", "n").alias("parent"))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    nested = rules.join(parents, ["host", "path"], "left").withColumn("rev", _reversed(F.col("host")))
    start = F.struct(_key(F.col("rev"), F.col("path")).alias("key"), F.lit(0).alias("kind"), rule.alias("top"))
    end = F.struct(F.concat(_key(F.col("rev"), F.col("path")), F.lit(b"\xff").cast("binary")).alias("key"), F.lit(0).alias("kind"), F.coalesce("parent", none).alias("top"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("level", "int"))]
    edges = nested.select("rev", F.explode(F.array(start, end)).alias("e")).select("rev", "e.*", *blank)

    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]  # one number
    host, path = host_and_path(named(url_col))
    # written before use, so that rows keep their numbers
    urls = stored(pages.select(named(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()), "urls")
    levels = F.least(F.size(F.split("host", r"\.")), F.lit(deepest))
    levelled = urls.filter(F.col("host") != "").select("row", "host", "path", F.explode(F.sequence(F.lit(1), levels)).alias("level")) if deepest else urls.limit(0).select("row", "host", "path", F.lit(1).alias("level"))
    levelled = levelled.withColumn("rev", _reversed(F.col("host"), F.col("level")))
    most = max(1, min(SWEEP_ROWS, urls.count() // SWEEP_PART))  # one number, of the files' footers
    # a row for each `most` keys of a level at most; broadcast while the optimiser finds it small, else joined by host, where AQE splits hot ones
    hot = stored(levelled.groupBy("rev").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("rev", F.ceil(F.col("n") / most).cast("int").alias("salts")), "hot_hosts")
    salts = F.coalesce("salts", F.lit(1))
    edges = edges.join(hot, "rev", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    keys = levelled.join(hot, "rev", "left").select(
        "rev", _key(F.col("rev"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("struct<rule: string, verdict: string>").alias("top"),
        F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"), "row", "level",
    )
    swept = Window.partitionBy("rev", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_rule = edges.unionByName(keys).withColumn("open", F.last("top", ignorenulls=True).over(swept))
    hits = open_rule.filter(F.col("row").isNotNull() & F.col("open.rule").isNotNull())
    best = hits.groupBy("row").agg(F.max_by("open", "level").alias("open"))
    out = urls.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("open.rule").alias("rule"), F.coalesce("open.verdict", F.lit(default)).alias("verdict"))

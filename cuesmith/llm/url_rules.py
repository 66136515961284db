"""URL filters by hash-prefix lookup, in DataFrame functions only.

Each URL is expanded into every host suffix joined with every path prefix that a
rule could have: suffixes with as many labels, prefixes as long, as some rule
has (both sets of numbers are bounded by the longest rule). The first four
bytes of an expression's SHA-256 find candidate rules by an equi-join; the full
digest confirms them; the longest confirmed rule (then the one with the longer
host) decides. A rule matches its host, all subdomains and every path that
starts with its own.

Rules are broadcast only while there are at most ``BROADCAST_RULES`` of them;
beyond, the same equi-join is shuffled and adaptive execution splits hot
prefixes. Matches are reduced to one number before the only other shuffle, which
is keyed by page, so a hot host moves no more rows than any other.

Cases: null URLs and URLs without ``://`` have empty host and path, match no
rule and take the default verdict; repeated rows are kept as often as they
occur; of equal rules with different verdicts ``block`` holds; null hosts or
paths in rules are dropped; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import clear_columns

BROADCAST_RULES = 100_000
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Room for the host length and the verdict below the length in a match's number.
HOST_ROOM = 1 << 20


def parts(url):
    """(host, path) columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, 2**31 - 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWERED)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(host, path):
    return F.sha2(F.concat(host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) and ``rules`` (host, path, verdict) -> page_id, host, path, rule, verdict."""
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    rules = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
    rules = rules.withColumn("full", _digest(F.col("host"), F.col("path")))
    shape = rules.agg(F.collect_set(F.length("path")).alias("paths"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.count("*").alias("n")).first()
    number = (F.length("host") + F.length("path")).cast("long") * (2 * HOST_ROOM) + F.length("host") * 2 + F.col("block").cast("int")
    book = rules.select(F.substring("full", 1, 8).alias("short"), "full", number.alias("number"))
    if shape.n <= BROADCAST_RULES:
        book = F.broadcast(book)

    host, path = parts(F.col("url"))
    base = clear_columns(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.spark_partition_id().alias("origin"))
    labels = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(shape.labels)])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape.paths)])
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    tries = base.withColumn("full", F.explode(F.concat(F.array(F.lit("")), F.array_compact(pairs))))
    found = tries.withColumn("short", F.substring("full", 1, 8)).join(book.withColumnRenamed("full", "whole"), "short", "left")
    best = found.groupBy("page_id", "host", "path", "origin").agg(
        F.max(F.when(F.col("full") == F.col("whole"), F.col("number"))).alias("number"), F.count_if(F.col("full") == "").alias("times")
    )
    once = best.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    size, of_host = F.floor(F.col("number") / (2 * HOST_ROOM)), F.floor(F.col("number") % (2 * HOST_ROOM) / 2)
    rule = F.concat(F.right("host", of_host.cast("int")), F.substring(F.col("path"), F.lit(1), (size - of_host).cast("int")))
    return once.select(
        "page_id", "host", "path", F.when(F.col("number").isNotNull(), rule).alias("rule"),
        F.when(F.col("number").isNull(), default).when(F.col("number") % 2 == 1, "block").otherwise("allow").alias("verdict"),
    )

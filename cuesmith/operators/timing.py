"""Cue timing: reading speed, display time, overlaps. Cues have timeline_id, seq, start_ms, end_ms, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.functions.text import cps, visible_chars

MAX_CPS, TARGET_CPS, MIN_CPS = 45, 27, 5
MIN_DISPLAY_MS, MAX_DISPLAY_MS, GAP_MS = 800, 7000, 80


def _order():
    return Window.partitionBy("timeline_id").orderBy("seq")


def _ideal():
    return F.floor(visible_chars(F.col("text")) / TARGET_CPS * 1000).cast("long")


def extend_fast(cues: DataFrame) -> DataFrame:
    """Cues above ``MAX_CPS`` end later, at the target speed's time at best, before the next cue's gap."""
    fast = cps(visible_chars(F.col("text")), F.col("start_ms"), F.col("end_ms")) > MAX_CPS
    want = F.col("start_ms") + F.least(_ideal(), F.lit(MAX_DISPLAY_MS))
    free = F.least(want, F.lead("start_ms").over(_order()) - GAP_MS)  # least() skips the missing next cue
    return cues.withColumn("end_ms", F.when(fast, F.greatest(F.col("end_ms"), free)).otherwise(F.col("end_ms")))


def trim_slow(cues: DataFrame) -> DataFrame:
    """Cues below ``MIN_CPS`` end at the target speed's time, but are shown ``MIN_DISPLAY_MS``."""
    chars = visible_chars(F.col("text"))
    slow = (cps(chars, F.col("start_ms"), F.col("end_ms")) < MIN_CPS) & (chars > 0)
    end = F.col("start_ms") + F.greatest(_ideal(), F.lit(MIN_DISPLAY_MS))
    return cues.withColumn("end_ms", F.when(slow, F.least(F.col("end_ms"), end)).otherwise(F.col("end_ms")))


def min_duration(cues: DataFrame, least_ms: int = MIN_DISPLAY_MS) -> DataFrame:
    """Short cues are shown ``least_ms`` if the gap to the next one holds all that is missing."""
    need = least_ms - (F.col("end_ms") - F.col("start_ms"))
    fits = (need > 0) & (F.lead("start_ms").over(_order()) - F.col("end_ms") >= need)
    return cues.withColumn("end_ms", F.when(fits, F.col("end_ms") + need).otherwise(F.col("end_ms")))


def overlaps(cues: DataFrame) -> DataFrame:
    """How often a cue ends after the next one has begun, by timeline."""
    flagged = cues.select("timeline_id", (F.col("end_ms") > F.lead("start_ms").over(_order())).alias("over"))
    return flagged.groupBy("timeline_id").agg(F.count("*").alias("n_cues"), F.coalesce(F.sum(F.col("over").cast("long")), F.lit(0)).alias("n_overlaps"))


def grades(cues: DataFrame) -> DataFrame:
    """Counts of cues that break a rule, by timeline."""
    chars = visible_chars(F.col("text"))
    speed, lasts = F.round(cps(chars, F.col("start_ms"), F.col("end_ms")), 2), F.col("end_ms") - F.col("start_ms")
    rules = {"n_fast": speed > MAX_CPS, "n_slow": (speed < MIN_CPS) & (chars > 0), "n_short": lasts < MIN_DISPLAY_MS, "n_long": lasts > MAX_DISPLAY_MS, "n_one_word": visible_chars(F.col("text"), "words") <= 1}
    return cues.groupBy("timeline_id").agg(F.count("*").alias("n_cues"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


def interval_lookup(points: DataFrame, spans: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """The first span (smallest ``span``) that holds each point's ``mid``; all points stay.

    Spans are spread over the time buckets they touch, which turns the range join
    into an equi-join on (timeline, bucket)."""
    bucket = lambda c: F.floor(c / bucket_ms)
    spans = spans.where("to_ms >= from_ms")  # others hold no point
    spread = spans.select("timeline_id", "span", "from_ms", "to_ms", F.explode(F.sequence(bucket(F.col("from_ms")), bucket(F.col("to_ms")))).alias("_b"))
    joined = points.withColumn("_b", bucket(F.col("mid"))).join(spread, ["timeline_id", "_b"], "left")
    inside = F.col("mid").between(F.col("from_ms"), F.col("to_ms"))
    return joined.groupBy("timeline_id", "pos").agg(F.min(F.when(inside, F.col("span"))).alias("span"))

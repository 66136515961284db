"""Audio events: merging, classification, density."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.operators.cues import fold


def merge_adjacent(events: DataFrame, gap_ms: int = 2000, least_ms: int = 300) -> DataFrame:
    """Neighbours of one type with at most ``gap_ms`` between them become one event;
    those shorter than ``least_ms`` go. Events count in order of (start, end, pos)."""
    order = Window.partitionBy("timeline_id").orderBy("start_ms", "end_ms", "pos")
    run = F.sum(F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(order)), 0).otherwise(1)).over(order)
    inside = Window.partitionBy("timeline_id", "_run").orderBy("start_ms", "end_ms", "pos")
    e = events.withColumn("_run", run).withColumn("_until", F.max("end_ms").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("_isle", F.sum(F.when(F.col("start_ms") - F.col("_until") <= gap_ms, 0).otherwise(1)).over(inside))
    out = e.groupBy("timeline_id", "_run", "_isle").agg(F.first("event_type").alias("event_type"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_events"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("_run", "_isle")


def classify(tag: Column, needles: list[tuple[str, str]]) -> Column:
    """The type of the first needle that the tag, lower-cased and with single blanks, holds; null if none does."""
    t = F.trim(F.lower(F.regexp_replace(tag, r"\s+", " ")))
    out = None
    for needle, kind in needles:
        out = (F if out is None else out).when(F.contains(t, F.lit(needle)), kind)
    return F.lit(None).cast("string") if out is None else out


def thin_out(cues: DataFrame, density: str = "conservative", least_ms: int = 250, gap_ms: int = 1500) -> DataFrame:
    """Sound cues (timeline_id, start_ms, end_ms, pos) far enough from the last one kept, in order:
    ``conservative`` wants the whole gap and a least length, others half the gap, ``aggressive`` nothing."""
    if density == "aggressive":
        return cues
    gap, least = (gap_ms, least_ms) if density == "conservative" else (gap_ms // 2, 0)

    def kept(rows: list[dict]) -> Iterator[dict]:
        until = None
        for r in sorted(rows, key=lambda r: (r["start_ms"], r["end_ms"], r["pos"])):
            if (until is None or r["start_ms"] - until >= gap) and r["end_ms"] - r["start_ms"] >= least:
                until = r["end_ms"]
                yield {k: r[k] for k in ("start_ms", "end_ms", "pos")}

    wanted = cues.where("start_ms is not null and end_ms is not null").select("timeline_id", "start_ms", "end_ms", "pos")
    return fold(wanted, "start_ms", "timeline_id long, seq long, start_ms long, end_ms long, pos long", kept).drop("seq")

"""Windows over cues: walls between neighbours, runs of one speaker, neighbourhoods of failures, words in a cue.

Cases: a first cue has nothing before it; spans that end before they start hold no
word; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order():
    return Window.partitionBy("timeline_id").orderBy("seq")


def boundaries(cues: DataFrame) -> DataFrame:
    """For each cue but the first, whether it may never join the one before, and why.

    Cues have ``wall``, ``review`` and ``speakers`` (distinct known ones)."""
    one = F.size("speakers") == 1
    same = one & (F.array_sort("speakers") == F.array_sort(F.lag("speakers").over(order())))
    review = F.coalesce("review", F.lit(False)) | F.coalesce(F.lag("review").over(order()), F.lit(False))
    wall = F.coalesce("wall", F.lit(False))
    reason = F.when(wall, "pause_boundary").when(review, "unknown_speaker").when(~F.coalesce(same, F.lit(False)), "speaker_change")
    first = F.lag("seq").over(order()).isNull()
    marked = cues.select("timeline_id", "seq", reason.alias("reason"), first.alias("_first"))
    return marked.where("not _first").select("timeline_id", "seq", F.col("reason").isNotNull().alias("immutable"), "reason")


def speaker_windows(cues: DataFrame) -> DataFrame:
    """Dialogue cues with ``window_id``: maximal runs of one first speaker without a wall inside."""
    dialogue = F.col("type") == "dialogue"
    opens = F.coalesce("wall", F.lit(False)) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order())) | ~dialogue | ~F.coalesce(F.lag(dialogue).over(order()), F.lit(False))
    return cues.withColumn("_opens", opens.cast("int")).withColumn("window_id", F.sum("_opens").over(order())).where(dialogue).drop("_opens")


def repair_windows(cues: DataFrame, around: int = 2) -> DataFrame:
    """(from_cue, to_cue) numbers from 0, half open: cues with ``failed`` and ``around`` neighbours, united where they touch."""
    number = F.row_number().over(order()) - 1
    n = F.count("*").over(Window.partitionBy("timeline_id"))
    near = cues.select("timeline_id", "failed", number.alias("i"), n.alias("n")).where("failed")
    spans = near.select("timeline_id", F.greatest(F.lit(0), F.col("i") - around).cast("long").alias("a"), F.least("n", F.col("i") + around + 1).cast("long").alias("b"))
    by_start = Window.partitionBy("timeline_id").orderBy("a", "b")
    fresh = ~F.coalesce(F.col("a") <= F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    isles = spans.withColumn("_f", fresh.cast("int")).withColumn("_isle", F.sum("_f").over(by_start))
    return isles.groupBy("timeline_id", "_isle").agg(F.min("a").alias("from_cue"), F.max("b").alias("to_cue")).drop("_isle")


def words_in(spans: DataFrame, tokens: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """For each span (timeline_id, span, from_ms, to_ms) the timed words whose middle lies in it, in order.

    Spans are spread over the time buckets they touch; the join is on (timeline, bucket)."""
    bucket = lambda c: F.floor(c / bucket_ms)
    spread = spans.where("to_ms >= from_ms").withColumn("_b", F.explode(F.sequence(bucket(F.col("from_ms")), bucket(F.col("to_ms")))))
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    timed = tokens.where("start_ms is not null and end_ms >= start_ms").select("timeline_id", "pos", "text", "start_ms", "end_ms", middle.alias("_mid"), bucket(middle).alias("_b"))
    inside = spread.join(timed, ["timeline_id", "_b"]).where(F.col("_mid").between(F.col("from_ms"), F.col("to_ms")))
    listed = F.sort_array(F.collect_list(F.struct("pos", "text", "start_ms", "end_ms")))
    return inside.groupBy("timeline_id", "span").agg(F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))).alias("timings"))


def with_timings(cues: DataFrame, tokens: DataFrame) -> DataFrame:
    """Cues with the words that lie in them."""
    spans = cues.select("timeline_id", F.col("seq").alias("span"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    return cues.drop("timings").join(words_in(spans, tokens).withColumnRenamed("span", "seq"), ["timeline_id", "seq"], "left")

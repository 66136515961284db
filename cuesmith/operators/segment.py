"""Sentence groups: islands of one speaker, sentence and stretch without a hard pause.

Cases: untimed tokens belong to groups by text and speaker but never move time; a
group without any timed token is unresolved; null speakers are a speaker of their
own; empty input gives no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.functions.text import is_sentence_end

PAUSE_MS = 1200


def with_groups(tokens: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Tokens with ``group_id`` (from 1 in each timeline) and ``hard`` on tokens after a hard pause."""
    order = Window.partitionBy("timeline_id").orderBy("pos")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    usable = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms"))
    last_end = F.last(F.when(usable, F.col("end_ms")), ignorenulls=True).over(past)
    first = F.lag("pos").over(order).isNull()
    hard = F.coalesce((F.col("utt") != F.lag("utt").over(order)) & usable & (F.col("start_ms") - last_end >= pause_ms), F.lit(False))
    turned = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order))
    flagged = tokens.select("*", first.alias("_first"), hard.alias("hard"), turned.alias("_turned"), F.lag(is_sentence_end(F.col("text"))).over(order).alias("_ended"), usable.alias("timed"))
    opens = (F.col("_first") | F.col("hard") | F.col("_turned") | F.coalesce("_ended", F.lit(False))).cast("long")
    return flagged.withColumn("group_id", F.sum(opens).over(order)).drop("_first", "_turned", "_ended")


def sentence_groups(tokens: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """One row per group: speaker, times of its timed tokens, words, joined text."""
    t = with_groups(tokens, pause_ms)
    listed = F.sort_array(F.collect_list(F.struct("pos", "text", "hard")))
    g = t.groupBy("timeline_id", "group_id").agg(
        F.first("speaker").alias("speaker"), F.min(F.when(F.col("timed"), F.col("start_ms"))).alias("start_ms"), F.max(F.when(F.col("timed"), F.col("end_ms"))).alias("end_ms"),
        F.count("*").alias("n_words"), F.sum(F.col("timed").cast("long")).alias("n_timed"), listed.alias("_l"),
    )
    return g.withColumn("hard_before", F.col("_l")[0]["hard"]).withColumn("text", F.array_join(F.transform("_l", lambda x: x["text"]), " ")).drop("_l")


def unresolved(groups: DataFrame) -> DataFrame:
    return groups.where("start_ms is null")


def speaker_letters(tokens: DataFrame) -> DataFrame:
    """A, B, C ... by first appearance in each timeline."""
    firsts = tokens.where("speaker is not null").groupBy("timeline_id", "speaker").agg(F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy("timeline_id").orderBy("first_pos"))
    return firsts.select("timeline_id", "speaker", "first_pos", F.chr((64 + rank).cast("long")).alias("letter"))


def dedup(tokens: DataFrame) -> DataFrame:
    """Of equal (text, start, end, speaker) in a timeline the first token stays."""
    first = Window.partitionBy("timeline_id", "text", "start_ms", "end_ms", "speaker").orderBy("pos")
    return tokens.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def described_groups(tokens: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Sentence groups with the half-open range of their words, whether the speaker is known, and
    - where a hard pause opened them - its length, the utterances on both sides and the threshold."""
    order = Window.partitionBy("timeline_id").orderBy("pos")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    t = with_groups(tokens, pause_ms)
    t = t.withColumns({
        "_gap": F.when(F.col("hard"), F.col("start_ms") - F.last(F.when(F.col("timed"), F.col("end_ms")), ignorenulls=True).over(past)),
        "_from": F.when(F.col("hard"), F.lag("utt").over(order)), "_number": F.row_number().over(order),
    })
    g = t.groupBy("timeline_id", "group_id").agg(
        F.first("speaker").alias("speaker"), F.min(F.when(F.col("timed"), F.col("start_ms"))).alias("start_ms"), F.max(F.when(F.col("timed"), F.col("end_ms"))).alias("end_ms"),
        (F.min("_number") - 1).cast("long").alias("source_word_start"), F.max("_number").cast("long").alias("source_word_end"), F.min_by("utt", "pos").alias("source_utterance_id"),
        F.min_by("hard", "pos").alias("hard_before"), F.min_by("_gap", "pos").alias("gap_before_ms"), F.min_by("_from", "pos").alias("prev_utterance_id"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("words"),
    )
    return g.withColumns({
        "speaker_known": F.col("speaker").isNotNull(), "review_required": F.col("speaker").isNull(), "timing_unresolved": F.col("start_ms").isNull(),
        "effective_pause_boundary_ms": F.when(F.col("hard_before"), F.lit(pause_ms).cast("long")),
    })

"""Token sources.

``baseline`` reads transcript JSON; ``from_turns`` gives plain dialogue turns
exact integer word timings. Tokens have timeline_id, utt, speaker, pos (gap-free
from 1), text, start_ms, end_ms; untimed tokens have null times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<text string, start bigint, end bigint, speaker string, confidence double>"
BASELINE = (
    "transcript_id string, language_code string, transcription_provider string, transcription_model string, audio_duration double, audio_duration_sec double, "
    f"utterances array<struct<source_utterance_id bigint, speaker string, start bigint, end bigint, text string, confidence double, words array<{WORD}>>>, "
    f"words array<{WORD}>, audio_events array<struct<event_type string, start bigint, end bigint, text string>>"
)


def baseline(spark: SparkSession, path: str, strict: bool = False, most_bytes: int = 128 << 20) -> DataFrame:
    """One row per transcript file that has utterances; the duration falls back to its older name.

    ``strict`` makes a file without utterances, or of more than ``most_bytes``, an error; else the
    first is left out and the second read."""
    if strict:
        large = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > most_bytes).head(1)  # names and lengths alone are read
        if large:
            raise ValueError(f"{large[0].path} has {large[0].length} bytes")
    raw = spark.read.schema(BASELINE).json(path, multiLine=True)
    has = F.coalesce(F.size("utterances"), F.lit(0)) > 0
    kept = raw.where(F.when(has, True).otherwise(F.raise_error(F.lit("a transcript has no utterances")).cast("boolean"))) if strict else raw.where(has)
    return kept.withColumn("audio_duration", F.coalesce("audio_duration_sec", "audio_duration")).drop("audio_duration_sec")


def tokens_of(baselines: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Words of utterances in order; a word without a speaker has its utterance's, blank words go."""
    utts = baselines.select(F.col(key).alias("timeline_id"), F.posexplode("utterances").alias("utt", "u"))
    words = utts.select("timeline_id", "utt", F.col("u.speaker").alias("of"), F.posexplode("u.words").alias("k", "w"))
    kept = words.where(F.trim(F.coalesce("w.text", F.lit(""))) != "")
    order = Window.partitionBy("timeline_id").orderBy("utt", "k")
    return kept.select(
        "timeline_id", F.col("utt").cast("long").alias("utt"), F.coalesce("w.speaker", "of").alias("speaker"),
        F.row_number().over(order).cast("long").alias("pos"), F.trim("w.text").alias("text"), F.col("w.start").alias("start_ms"), F.col("w.end").alias("end_ms"),
    )


def from_turns(turns: DataFrame) -> DataFrame:
    """Tokens of (conv_id, turn, role, text): a word lasts 60 ms and 45 for each sign,
    40 ms lie between words, 400 to 1999 before a turn; every 50th word is untimed."""
    words = turns.select(F.col("conv_id").alias("timeline_id"), F.col("turn").cast("long").alias("utt"), F.col("role").alias("speaker"), F.posexplode(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("k", "text"))
    lasts = 60 + 45 * F.length("text").cast("long")
    pause = F.when(F.col("k") == 0, 400 + (F.col("timeline_id") * 7 + F.col("utt") * 397) % 1600).otherwise(0)
    order = Window.partitionBy("timeline_id").orderBy("utt", "k")
    placed = words.withColumn("pos", F.row_number().over(order).cast("long")).withColumn("end_ms", F.sum(lasts + pause + 40).over(order) - 40)
    timed = F.col("pos") % 50 != 0
    return placed.select("timeline_id", "utt", "speaker", "pos", "text", F.when(timed, F.col("end_ms") - lasts).alias("start_ms"), F.when(timed, F.col("end_ms")).alias("end_ms"))


def from_events(events: DataFrame, lasts_ms: int = 1000) -> DataFrame:
    """Timed events of a table with event_id, ts, user_id and event_type."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60  # from the fields, so no time zone plays a part
    start = (F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long") * 86_400_000 + second.cast("long") * 1000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000)).cast("long")
    return events.select(F.col("user_id").alias("timeline_id"), F.col("event_id").alias("pos"), "event_type", start.alias("start_ms"), (start + lasts_ms).alias("end_ms"))

"""Queries over the test tables: dialogue turns stand for transcripts, events for audio events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesmith.functions import text as T
from cuesmith.functions import timecode as C
from cuesmith.operators import events as E
from cuesmith.operators import normalize as N
from cuesmith.operators import segment as S
from cuesmith.operators import sinks, timing
from cuesmith.session import ship
from cuesmith.sources import transcripts

# ---- fixed values: audio tags and their types, the first that a tag holds wins
TAGS = [
    ("music playing", "music_playing"), ("music", "music"), ("crowd cheering", "crowd_noise"), ("cheering", "crowd_noise"), ("crowd noise", "crowd_noise"), ("crowd", "crowd_noise"), ("applause", "applause"), ("laughter", "laughter"), ("laughing", "laughter"), ("gasps", "gasping"), ("gasping", "gasping"), ("screaming", "screaming"),
    ("shouting", "shouting"), ("crying", "crying"), ("sobbing", "crying"), ("whispering", "whispering"), ("phone ringing", "ringtone"), ("phone rings", "ringtone"), ("ringtone", "ringtone"), ("doorbell", "ringtone"), ("alarm", "alarm"), ("siren", "siren"), ("buzzer", "alarm"), ("whistle blows", "whistle"), ("whistle", "whistle"), ("gunshot", "gunshot"), ("gunfire", "gunshot"), ("explosion", "explosion"), ("engine revving", "engine_noise"), ("engine noise", "engine_noise"), ("engine", "engine_noise"), ("car horn", "engine_noise"), ("thunder", "thunder"), ("rain", "rain"), ("wind", "rain"), ("footsteps", "footsteps"), ("knocking", "knocking"), ("knock", "knocking"),
]
SAMPLES = ["(Music  Playing)", "(soft music)", "(CROWD cheering)", "(applause)", "(door)", "(Laughing hard)", "(crowd)"]
# ----


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.from_turns(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentence_groups(_tokens(spark, sf_dir))


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).where("start_ms is not null").select("timeline_id", F.col("group_id").alias("seq"), "start_ms", "end_ms", "text")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def speaker_totals(spark, sf_dir):
    """Sentence groups, words and milliseconds by timeline and speaker."""
    g = _groups(spark, sf_dir).groupBy("timeline_id", "speaker")
    return g.agg(F.count("*").alias("n_groups"), F.sum("n_words").alias("n_words"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


def seg1_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


def seg3_sentence_ends(spark, sf_dir):
    """Only words that end in a sentence sign are taken out of the text and looked at."""
    text = F.coalesce("text", F.lit(""))
    ends = F.regexp_extract_all(text, F.lit(r"(?<![^ \t\n\r])([^ \t\n\r]++)(?<=[.!?。！？．])"), 1)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long").alias("n_words"), F.size(F.filter(ends, T.is_sentence_end)).cast("long").alias("n_ends"))


def seg5_unresolved(spark, sf_dir):
    return S.unresolved(_groups(spark, sf_dir)).select("timeline_id", "group_id", "n_words", "text")


def flt1_timing(spark, sf_dir):
    timed = F.col("start_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms"))
    return _tokens(spark, sf_dir).groupBy("timeline_id").agg(F.count("*").alias("n_tokens"), F.count_if(timed).alias("n_timed"), F.max("end_ms").alias("until_ms"))


def nrm5_speaker_letters(spark, sf_dir):
    return S.speaker_letters(_tokens(spark, sf_dir))


def nrm7_utterances(spark, sf_dir):
    t = _tokens(spark, sf_dir).where("start_ms is not null").withColumn("confidence", (F.length("text") * 37 % 100) / 100)
    return N.utterances(t)


def nrm2_event_types(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("event_id") % len(SAMPLES) + 1).cast("int"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(E.classify(tag, TAGS).alias("kind"))
    return e.groupBy("kind").agg(F.count("*").alias("n"))


def evt1_merged_events(spark, sf_dir):
    return E.merge_adjacent(_events(spark, sf_dir), gap_ms=3_600_000)


def flt3_density(spark, sf_dir):
    return E.thin_out(_events(spark, sf_dir), gap_ms=86_400_000).groupBy("timeline_id").agg(F.count("*").alias("n_kept"), F.sum("pos").alias("sum_pos"))


def nrm14_distinct_tokens(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumns({"start_ms": F.lit(0).cast("long"), "end_ms": F.lit(1).cast("long")})
    return S.dedup(t).select("timeline_id", "pos", "speaker", "text")


def jn1_interval_lookup(spark, sf_dir):
    t = _tokens(spark, sf_dir).where("start_ms is not null")
    spans = t.groupBy("timeline_id", F.col("utt").alias("span")).agg((F.min("start_ms") - 500).alias("from_ms"), (F.max("end_ms") + 500).alias("to_ms"))
    points = t.select("timeline_id", "pos", F.expr("(start_ms + end_ms) div 2").alias("mid"))
    return timing.interval_lookup(points, spans)


def jn7_previous_speaker(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("timeline_id"), F.col("turn").cast("long").alias("turn"), F.expr("nullif(role, 'assistant')").alias("known"))
    past = Window.partitionBy("timeline_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("timeline_id", "turn", F.last("known", ignorenulls=True).over(past).alias("previous"))


def cps1_extended(spark, sf_dir):
    return timing.extend_fast(_cues(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + F.length("text") * 20)).drop("text")


def cps3_trimmed(spark, sf_dir):
    return timing.trim_slow(_cues(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + F.length("text") * 250)).drop("text")


def rdb3_min_duration(spark, sf_dir):
    return timing.min_duration(_cues(spark, sf_dir)).drop("text")


def agg1_grades(spark, sf_dir):
    return timing.grades(_cues(spark, sf_dir))


def agg3_overlaps(spark, sf_dir):
    return timing.overlaps(_cues(spark, sf_dir).withColumn("end_ms", F.col("end_ms") + F.length("text") * 3))


def agg7_rollup(spark, sf_dir):
    g = _groups(spark, sf_dir).rollup("timeline_id", "speaker")
    return g.agg(F.count("*").alias("n_groups"), F.count_if("hard_before").alias("n_hard"), F.sum("n_words").alias("n_words"))


def tim_timecodes(spark, sf_dir):
    c = _cues(spark, sf_dir).select("timeline_id", "seq", C.to_srt(F.col("start_ms") * 40).alias("srt_time"), C.to_vtt(F.col("end_ms")).alias("vtt_time"))
    return c.withColumn("ms", C.parse(F.col("srt_time")))


def grd2_frames(spark, sf_dir):
    s = F.col("start_ms")
    c = _cues(spark, sf_dir).select("timeline_id", "seq", C.to_frame(s).alias("nearest"), C.to_frame(s, 30000, 1001, "floor").alias("floor"), C.to_frame(s, 30000, 1001, "ceil").alias("ceil"))
    return c.withColumn("back_ms", C.from_frame(F.col("ceil"), 30000, 1001))


def hsh1_group_hash(spark, sf_dir):
    body = F.to_json(F.struct("end_ms", "speaker", "start_ms", "text"), {"ignoreNullFields": "false"})
    return _groups(spark, sf_dir).select("timeline_id", "group_id", T.canonical_sha256(body).alias("digest"))


def hsh4_fnv(spark, sf_dir):
    state = F.concat_ws("|", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), F.col("text"))
    return _cues(spark, sf_dir).select("timeline_id", "seq", T.fnv1a(state).alias("state"))


def txt16_visible(spark, sf_dir):
    c = F.col("text")
    return _cues(spark, sf_dir).select("timeline_id", "seq", *[T.visible_chars(c, m).cast("long").alias(m) for m in ("characters", "characters_no_spaces", "words")])


def set4_new_words(spark, sf_dir):
    """Distinct words of each turn that the turn before does not have."""
    words = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("timeline_id"), F.col("turn").cast("long").alias("turn"), F.array_distinct(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("w"))
    before = F.coalesce(F.lag("w").over(Window.partitionBy("timeline_id").orderBy("turn")), F.array().cast("array<string>"))
    return words.select("timeline_id", "turn", F.size(F.array_except("w", before)).cast("long").alias("n_new"))


def snk1_srt(spark, sf_dir):
    return sinks.srt(_cues(spark, sf_dir))


def snk2_vtt(spark, sf_dir):
    return sinks.vtt(_cues(spark, sf_dir))


def snk3_scc(spark, sf_dir):
    return sinks.scc(_cues(spark, sf_dir))


QUERIES = {f.__name__: f for f in (speaker_totals, seg1_groups, seg3_sentence_ends, seg5_unresolved, flt1_timing, flt3_density, nrm2_event_types, nrm5_speaker_letters, nrm7_utterances, nrm14_distinct_tokens, evt1_merged_events, jn1_interval_lookup, jn7_previous_speaker, cps1_extended, cps3_trimmed, rdb3_min_duration, agg1_grades, agg3_overlaps, agg7_rollup, tim_timecodes, grd2_frames, hsh1_group_hash, hsh4_fnv, txt16_visible, set4_new_words, snk1_srt, snk2_vtt, snk3_scc)}

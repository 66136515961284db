"""Each query of the engine against its SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from compare import from_spark, from_sql
from cuesmith.operators import events as E
from cuesmith.operators import normalize as N
from cuesmith.operators import sinks
from cuesmith.plans import cue_queries, oracle, queries
from cuesmith.plans.queries import TAGS
from cuesmith.sources import transcripts
from cuesmith.streaming.sessions import sessions

QUERIES, ORACLE_SQL = queries.QUERIES | cue_queries.QUERIES, oracle.ORACLE_SQL | cue_queries.ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert from_spark(QUERIES[name](spark, SF)) == from_sql(ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    """Folds, which SQL cannot express, are held against worked cases elsewhere."""
    assert QUERIES[name](spark, SF).count() > 0


def test_density(spark):
    rows = [(1, 0, 300, 1), (1, 1700, 1800, 2), (1, 2000, 2300, 3), (1, 2400, 2700, 4), (1, 3900, 4300, 5), (2, 0, 250, 6), (1, None, 5, 7)]
    cues = spark.createDataFrame(rows, "timeline_id long, start_ms long, end_ms long, pos long")
    kept = lambda d: sorted(r.pos for r in E.thin_out(cues, d).collect())
    assert kept("conservative") == [1, 3, 5, 6] and kept("normal") == [1, 2, 5, 6] and len(kept("aggressive")) == 7


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:04"), (2, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "timeline_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.timeline_id, r.n_events, (r.to_ts - r.from_ts).total_seconds()) for r in sessions(events).collect())
    assert got == [(1, 1, 2.0), (1, 2, 3.0), (2, 1, 2.0)]


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 10)] + [(1, "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "timeline_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("timeline_id long, ts timestamp").parquet(f"{tmp_path}/in")
    run = sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.n_events for r in spark.table("sessions_out").collect()) == [1, 2]  # the last one is still open


def test_written_documents(spark, tmp_path):
    cues = spark.createDataFrame([(1, 2, 1000, 1500, "b"), (1, 1, 0, 900, "a"), (2, 1, 0, 900, "c")], "timeline_id long, seq long, start_ms long, end_ms long, text string")
    sinks.write_text(sinks.srt(cues), f"{tmp_path}/out")
    read = {r.timeline_id: r.value for r in spark.read.text(f"{tmp_path}/out", wholetext=True).collect()}
    assert read[1].rstrip() == "1\n00:00:00,000 --> 00:00:00,900\na\n\n2\n00:00:01,000 --> 00:00:01,500\nb"


def test_provider_results(spark):
    words = [("Hello", "0.1", "0.5", "word", "s2", 0.9, None), (" ", "0.5", "0.6", "spacing", "s2", None, None), ("there.", "0.6", "1.0", "word", "s2", 0.7, None), ("(applause)", "1.0", "2.0", "audio_event", None, None, None), ("Hi", "2.5", "x", "word", "s1", None, -0.2), ("[door]", "3.0", "3.2", "word", "s1", None, None)]
    raw = spark.createDataFrame([("t1", "en", "Hello there. (applause) Hi [door]", words)], N.PROVIDER).withColumn("id", F.lit("x"))
    out = N.normalized(raw.withColumn("transcription_id", F.lit(7).cast("long")), TAGS)
    assert [(r.text, r.speaker, r.start_ms, r.end_ms, r.confidence) for r in out["words"].orderBy("pos").collect()] == [("Hello", "A", 100, 500, 0.9), ("there.", "A", 600, 1000, 0.7), ("Hi", "B", 2500, 0, 1.0), ("[door]", "B", 3000, 3200, 0.0)]
    assert [(r.speaker, r.text, r.confidence) for r in out["utterances"].orderBy("utt").collect()][0] == ("A", "Hello there.", 0.8)
    assert [(r.event_type, r.start_ms, r.end_ms) for r in out["audio_events"].collect()] == [("applause", 1000, 2000)]
    (head,) = out["transcripts"].collect()
    assert (head.audio_duration, head.text) == (3.2, "Hello there. Hi")


def test_cjk_tokens(spark):
    rows = [(1, 1, "A", "今日は。明日も！", 0, 800), (1, 2, "A", "hello. there.", 0, 10), (1, 3, "A", "今日は。明日も。", None, None)]
    got = N.exploded_cjk(spark.createDataFrame(rows, "timeline_id long, pos long, speaker string, text string, start_ms long, end_ms long")).orderBy("pos", "k").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("今日は。", 0, 400), ("明日も！", 400, 800), ("hello. there.", 0, 10), ("今日は。明日も。", None, None)]


def test_baselines(spark, tmp_path):
    (tmp_path / "none.json").write_text('{"transcript_id": "t", "utterances": []}')
    assert transcripts.baseline(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no utterances"):
        transcripts.baseline(spark, str(tmp_path), strict=True).collect()
    with pytest.raises(ValueError, match="bytes"):
        transcripts.baseline(spark, str(tmp_path), strict=True, most_bytes=10)

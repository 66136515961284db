"""Digests that identify inputs and outputs: equal content has equal digests, however it was written.

Cases: absent labels, segments and flags count as empty or false; a cue without a
quality summary has null for it; order is that of ``seq`` or of the arrays.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.functions.text import canonical_json, canonical_sha256
from cuesmith.operators.optimizer import OPTIMIZER_VERSION, POLICY_VERSION, digest

FORMATTER_VERSION = 6


def byte_hash(raw: bytes) -> str:
    """Digest of an artifact's bytes."""
    return hashlib.sha256(raw).hexdigest()


def baseline_hash(baselines: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Digest of what a transcript says: utterances with words, audio events, language."""
    word = lambda w: F.struct(F.coalesce(w["text"], F.lit("")).alias("t"), w["start"].alias("s"), w["end"].alias("e"))

    def utterance(u):
        words = F.coalesce(F.transform(u["words"], word), F.array().cast("array<struct<t:string,s:bigint,e:bigint>>"))
        return F.struct(u["source_utterance_id"].alias("u"), u["speaker"].alias("sp"), u["start"].alias("s"), u["end"].alias("e"), F.coalesce(u["text"], F.lit("")).alias("t"), words.alias("w"))

    event = lambda e: F.struct(e["event_type"].alias("et"), e["start"].alias("s"), e["end"].alias("e"), F.coalesce(e["text"], F.lit("")).alias("t"))
    events = F.coalesce(F.transform("audio_events", event), F.array().cast("array<struct<et:string,s:bigint,e:bigint,t:string>>"))
    shaped = baselines.select(key, "language_code", F.transform("utterances", utterance).alias("utterances"), events.alias("audio_events"))
    body = F.struct(F.lit("cc_baseline_content").alias("kind"), "language_code", "utterances", "audio_events")
    return shaped.select(key, canonical_sha256(canonical_json(body)).alias("baseline_hash"))


def output_hash(cues: DataFrame) -> DataFrame:
    """Digest of each timeline's cues as delivered.

    Cues have timeline_id, seq, type, start_ms, end_ms, lines, speaker_label, speaker_segments
    (speaker, text), speaker_review_required, position and qc (status, severity, codes, review)."""
    segments = F.transform(F.filter(F.coalesce("speaker_segments", F.array().cast("array<struct<speaker:string,text:string>>")), lambda s: s["speaker"].isNotNull()), lambda s: F.struct(s["speaker"].alias("sp"), F.coalesce(s["text"], F.lit("")).alias("t")))
    qc = F.when(F.col("qc").isNotNull(), F.struct(F.col("qc.status").alias("st"), F.col("qc.severity").alias("sev"), F.array_sort("qc.codes").alias("codes"), F.coalesce("qc.review", F.lit(False)).alias("rr")))
    row = F.struct(
        F.col("seq"), F.coalesce("type", F.lit("dialogue")).alias("tp"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.coalesce("speaker_label", F.lit("")).alias("sp"), segments.alias("seg"),
        F.coalesce("speaker_review_required", F.lit(False)).alias("rr"), F.coalesce(F.nullif("position", F.lit("")), F.lit("bottom")).alias("pos"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), qc.alias("qc"),
    )
    listed = F.array_sort(F.collect_list(row), lambda a, b: (a["seq"] - b["seq"]).cast("int"))
    names = ("tp", "s", "e", "sp", "seg", "rr", "pos", "lines", "qc")
    cued = F.transform(listed, lambda x, i: F.struct(i.alias("i"), *[x[n].alias(n) for n in names]))
    grouped = cues.groupBy("timeline_id").agg(cued.alias("cues"))
    return grouped.select("timeline_id", canonical_sha256(canonical_json(F.struct(F.lit("cc_delivery_output").alias("kind"), "cues"))).alias("output_hash"))


def input_tuple(content: str | None, artifact: str | None, overlay: str | None, slug: str | None, version, overrides: dict, mode: str, engine: str) -> dict:
    """Everything that a run's output depends on."""
    return {
        "baseline_hash": content, "baseline_artifact_hash": artifact, "overlay_hash": overlay or "NONE", "spec_slug": slug, "spec_version": version,
        "overrides_hash": digest({"kind": "cc_run_overrides", "overrides": {str(k): str(v) for k, v in (overrides or {}).items()}}),
        "formatter_version": FORMATTER_VERSION, "segmentation_policy_version": POLICY_VERSION, "optimizer_version": OPTIMIZER_VERSION, "engine_version": engine, "editorial_mode": mode,
    }

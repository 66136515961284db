"""Subtitle text of each timeline's cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.functions.timecode import to_srt, to_vtt


def _document(cues: DataFrame, block, head: str, between: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("seq", "start_ms", "end_ms", "text")))
    body = F.array_join(F.transform(listed, block), between)
    return cues.groupBy("timeline_id").agg(F.concat(F.regexp_replace(F.concat(F.lit(head), body), r"\s+$", ""), F.lit("\n")).alias("document"))


def _times(x: Column, time) -> Column:
    return F.concat(time(x["start_ms"]), F.lit(" --> "), time(x["end_ms"]), F.lit("\n"), x["text"])


def srt(cues: DataFrame) -> DataFrame:
    return _document(cues, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), _times(x, to_srt)), "", "\n\n")


def vtt(cues: DataFrame) -> DataFrame:
    return _document(cues, lambda x: _times(x, to_vtt), "WEBVTT\n\n", "\n\n")


def scc(cues: DataFrame) -> DataFrame:
    return _document(cues, lambda x: F.concat(x["start_ms"].cast("string"), F.lit(":"), x["end_ms"].cast("string"), F.lit("  "), x["text"]), "Scenarist_SCC V1.0\n\n", "\n")


def ttml(cues: DataFrame, rate: str = "30", multiplier: str = "1000 1001", base: str = "media", align: str = "center") -> DataFrame:
    """Timed text of cues with ``lines``: italic spans, line breaks, other tags dropped, no escaping."""
    # ---- fixed values: the document around the cues
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n'
        '<tt xml:lang="en" xmlns="http://www.w3.org/ns/ttml" xmlns:ttp="http://www.w3.org/ns/ttml#parameter" xmlns:tts="http://www.w3.org/ns/ttml#styling" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"'
        f' ttp:timeBase="{base}" ttp:frameRate="{rate}" ttp:frameRateMultiplier="{multiplier}">\n  <head>\n    <styling>\n'
        f'      <style xml:id="default" tts:textAlign="{align}" tts:fontFamily="proportionalSansSerif" tts:fontSize="80%"/>\n    </styling>\n    <layout>\n'
        '      <region xml:id="bottom" tts:origin="10% 80%" tts:extent="80% 20%" tts:displayAlign="after"/>\n    </layout>\n  </head>\n  <body>\n    <div>\n'
    )
    tail = "    </div>\n  </body>\n</tt>\n"
    # ----
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\{\\[^}]*\}", ""), "</?b>", "")
    span = lambda x: F.regexp_replace(F.regexp_replace(x, "<i>([^<]*)(?:</i>|$)", '<span tts:fontStyle="italic">$1</span>'), "</?i>", "")
    text = F.array_join(F.transform("lines", lambda x: span(plain(x))), "<br/>")
    rows = cues.withColumn("_text", text).where("_text != ''")
    row = lambda x: F.concat(F.lit('      <p begin="'), to_vtt(x["start_ms"]), F.lit('" end="'), to_vtt(x["end_ms"]), F.lit('" region="bottom" style="default">'), x["_text"], F.lit("</p>\n"))
    listed = F.sort_array(F.collect_list(F.struct("seq", "start_ms", "end_ms", "_text")))
    return rows.groupBy("timeline_id").agg(F.concat(F.lit(head), F.array_join(F.transform(listed, row), ""), F.lit(tail)).alias("document"))


def write_text(documents: DataFrame, path: str) -> None:
    """One folder for each timeline."""
    documents.select("timeline_id", F.col("document").alias("value")).write.partitionBy("timeline_id").text(path)

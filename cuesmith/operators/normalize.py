"""From provider words, utterances and events to tokens and sound cues: column functions and islands.

Cases: blank texts are dropped; values that are no number count as 0 seconds; tags that
no needle fits are no event; an utterance without a bracketed tag gives no sound token;
an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.functions.text import is_sound
from cuesmith.functions.timecode import parse, to_srt
from cuesmith.operators.cues import fold
from cuesmith.operators.events import classify, merge_adjacent
from cuesmith.operators.timing import interval_lookup

# ---- fixed values: forms of tags, limits in milliseconds
EVENT_WORD = r"[(\[]\s*([^)\]]+?)\s*[)\]]"
BRACKET_TAG = r"\[[^\]]+\]"
UTTERANCE_GAP_MS, UTTERANCE_MOST_MS = 300, 7000
SOUND_MS, EVENT_LEAST_MS = 250, 300
# ----


def seconds_to_ms(value: Column) -> Column:
    """Half to even, as floating point has it; 0 for what is no number."""
    seconds = value.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(seconds), F.rint(seconds * 1000).cast("long")), F.lit(0).cast("long"))


def is_event_word(text: Column, kind: Column, needles) -> Column:
    """A word that is marked as an audio event, or is one bracketed known tag."""
    whole = F.regexp_extract(F.trim(text), f"^{EVENT_WORD}$", 1)
    return F.coalesce(F.lower(kind) == "audio_event", F.lit(False)) | classify(whole, needles).isNotNull()


def word_events(words: DataFrame, needles) -> DataFrame:
    """Audio events of provider words (timeline_id, pos, text, type, start, end in seconds), merged."""
    marked = F.coalesce(F.lower("type") == "audio_event", F.lit(False))
    bare = F.trim(F.regexp_replace(F.trim("text"), r"^[()\[\]{}]+|[()\[\]{}]+$", ""))
    tag = F.when(marked, bare).otherwise(F.regexp_extract(F.trim("text"), EVENT_WORD, 1))
    events = words.select("timeline_id", "pos", classify(tag, needles).alias("event_type"), seconds_to_ms(F.col("start")).alias("start_ms"), seconds_to_ms(F.coalesce("end", "start")).alias("end_ms"))
    return merge_adjacent(events.where("event_type is not null"))


def _utterance_numbers(words: list[dict]) -> Iterator[dict]:
    utt, speaker, start, end = -1, None, 0, 0
    for w in words:
        if utt < 0 or w["speaker"] != speaker or w["start_ms"] - end > UTTERANCE_GAP_MS or w["end_ms"] - start > UTTERANCE_MOST_MS:
            utt, speaker, start = utt + 1, w["speaker"], w["start_ms"]
        end = w["end_ms"]
        yield {k: v for k, v in w.items() if k != "timeline_id"} | {"utt": utt}


def utterance_words(words: DataFrame) -> DataFrame:
    """Words with their utterance: one speaker, no gap over 300 ms, 7 s in all."""
    schema = "timeline_id long, seq long, pos long, text string, speaker string, start_ms long, end_ms long, confidence double, utt long"
    return fold(words.select("timeline_id", "pos", "text", "speaker", "start_ms", "end_ms", "confidence"), "pos", schema, lambda rows: list(_utterance_numbers(rows)))


def utterances(words: DataFrame) -> DataFrame:
    """One row an utterance (words with ``utt``): times of first and last word, text, mean of the
    confidences other than 0, half to even at four places (summed in millionths, so in any order)."""
    listed = F.sort_array(F.collect_list(F.struct("pos", F.trim("text").alias("text"), "start_ms", "end_ms")))
    u = words.where(F.trim("text") != "").groupBy("timeline_id", "utt").agg(F.first("speaker").alias("speaker"), listed.alias("l"), F.sum(F.rint(F.col("confidence") * 1_000_000).cast("long")).alias("points"), F.count_if(F.col("confidence") != 0).alias("n"))
    return u.select("timeline_id", "utt", "speaker", F.col("l")[0]["start_ms"].alias("start_ms"), F.element_at("l", -1)["end_ms"].alias("end_ms"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), F.coalesce(F.rint(F.col("points") / F.nullif("n", F.lit(0)) / 100) / 10000, F.lit(0.0)).alias("confidence"))


def _tags(utts: DataFrame) -> DataFrame:
    """Bracketed tags of utterances, which share its time evenly."""
    found = utts.select("timeline_id", "utt", "start_ms", "end_ms", F.regexp_extract_all("text", F.lit(f"({BRACKET_TAG})"), 1).alias("tags"))
    each = found.select("timeline_id", "utt", "start_ms", "end_ms", F.size("tags").alias("n"), F.posexplode("tags").alias("k", "tag"))
    share = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")) / F.col("n")))
    begin = F.col("start_ms") + F.col("k") * share
    return each.select("timeline_id", "utt", "k", "tag", begin.alias("start_ms"), F.least("end_ms", begin + share).alias("end_ms"))


def sound_tokens(utts: DataFrame) -> DataFrame:
    return _tags(utts).select("timeline_id", "utt", "k", F.upper(F.trim("tag")).alias("text"), "start_ms", F.greatest(F.col("start_ms") + 1, "end_ms").alias("end_ms"))


def tag_events(utts: DataFrame, needles) -> DataFrame:
    """Audio events of the known tags, at least 300 ms long, merged."""
    kind = classify(F.regexp_replace("tag", r"^\[+|\]+$", ""), needles)
    events = _tags(utts).select("timeline_id", (F.col("utt") * 100_000 + F.col("k")).alias("pos"), kind.alias("event_type"), "start_ms", F.greatest(F.col("start_ms") + EVENT_LEAST_MS, "end_ms").alias("end_ms"))
    return merge_adjacent(events.where("event_type is not null"))


def backbone(utts: DataFrame) -> DataFrame:
    """Subtitle text of a timeline's utterances."""
    u = utts.where(F.trim("text") != "")
    end = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms") + 1)
    listed = F.sort_array(F.collect_list(F.struct("utt", "start_ms", end.alias("until"), F.trim("text").alias("text"))))
    block = lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), to_srt(x["start_ms"]), F.lit(" --> "), to_srt(x["until"]), F.lit("\n"), x["text"])
    return u.groupBy("timeline_id").agg(F.concat(F.array_join(F.transform(listed, block), "\n\n"), F.lit("\n")).alias("document"))


def merge_tokens(spoken: DataFrame, sound: DataFrame) -> DataFrame:
    """Both kinds of tokens in order of time - untimed ones by their ``original_*`` times - without repetitions."""
    columns = ("timeline_id", "pos", "text", "start_ms", "end_ms", "speaker", "original_start_ms", "original_end_ms")
    both = spoken.select(*columns, F.lit(0).alias("kind")).unionByName(sound.select(*columns, F.lit(1).alias("kind")))
    begin = F.coalesce("start_ms", "original_start_ms", F.lit(0))
    order = [begin, F.coalesce("end_ms", "original_end_ms", begin), F.col("text"), F.col("kind"), F.col("pos")]
    first = Window.partitionBy("timeline_id", "text", "start_ms", "end_ms", "speaker").orderBy(*order)
    kept = both.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("timeline_id").orderBy(*order))
    return kept.select("timeline_id", place.cast("long").alias("seq"), "text", "start_ms", "end_ms", "speaker", "kind")


def back_filled(words: DataFrame, utts: DataFrame) -> DataFrame:
    """Flat words with the utterance whose time holds their middle, and its speaker where they have none."""
    spans = utts.where("speaker is not null").select("timeline_id", F.col("utt").alias("span"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    middle = F.when(F.col("end_ms") >= F.col("start_ms"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2)).otherwise(F.col("start_ms"))
    found = interval_lookup(words.where("start_ms is not null and end_ms is not null").select("timeline_id", "pos", middle.alias("mid")), spans)
    who = utts.select("timeline_id", F.col("utt").alias("span"), F.col("speaker").alias("_who"))
    joined = words.where(F.trim("text") != "").join(found, ["timeline_id", "pos"], "left").join(who, ["timeline_id", "span"], "left")
    return joined.select("timeline_id", "pos", F.trim("text").alias("text"), "start_ms", "end_ms", F.coalesce("speaker", "_who").alias("speaker"), F.col("span").alias("utt"))


def provenance(provider: Column, model: Column, version: Column, job: Column, source: Column) -> Column:
    clean = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.struct(F.lit(1).alias("provenance_version"), clean(provider).alias("provider"), clean(model).alias("model"), clean(version).alias("provider_version"), clean(job).alias("transcription_job_id"), clean(source).alias("confidence_source"))


def title_case(text: Column) -> Column:
    """A capital at the start of each run of letters, the others small."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def event_label(raw: Column, kind: Column, music: str = "bracketed_uppercase", effect: str = "bracketed_uppercase", note: str = "♪") -> Column:
    """What a sound cue shows, by the format of music and of other sounds; empty for ``none``."""
    label = F.trim(F.coalesce(F.nullif(raw, F.lit("")), kind, F.lit("")))
    upper = (label == F.upper(label)) & (label != F.lower(label))
    boxed, slanted = F.concat(F.lit("["), F.upper(label), F.lit("]")), F.concat(F.lit("<i>"), label, F.lit("</i>"))
    noted = F.concat(F.lit(note + " "), F.when(upper, title_case(label)).otherwise(label), F.lit(" " + note))
    round_ = F.concat(F.lit("("), F.lower(label), F.lit(")"))
    of_music = {"musical_note_prefix": noted, "italic": slanted, "none": F.lit("")}.get(music, boxed)
    of_effect = {"parenthetical": round_, "italic": slanted, "none": F.lit("")}.get(effect, boxed)
    return F.when(label == "", "").when(F.lower(F.coalesce(kind, F.lit(""))).contains("music"), of_music).otherwise(of_effect)


def sound_cues(tokens: DataFrame, **formats) -> DataFrame:
    """Cues of in-text sound tokens (bracketed text)."""
    inner = F.trim(F.regexp_replace(F.trim("text"), r"^[\[\]]+|[\[\]]+$", ""))
    kind = F.when(F.lower(inner).contains("music"), "music").otherwise("sound_effect")
    c = tokens.where(is_sound(F.col("text"))).select("timeline_id", "pos", "start_ms", F.greatest("end_ms", F.col("start_ms") + SOUND_MS).alias("end_ms"), event_label(inner, kind, **formats).alias("line"), kind.alias("type"))
    return c.where("line != ''")


def event_cues(events: DataFrame, **formats) -> DataFrame:
    """Cues of native audio events (event_type, start_ms, end_ms, text)."""
    kind = F.coalesce(F.nullif("event_type", F.lit("")), F.lit("sound"))
    label = F.replace(F.coalesce(F.nullif("text", F.lit("")), kind), F.lit("_"), F.lit(" "))
    end = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + SOUND_MS).otherwise(F.col("end_ms"))
    shown = F.when(F.lower(kind).contains("music"), "music").otherwise("sound_effect")
    c = events.where("start_ms is not null and end_ms is not null").select("timeline_id", "pos", "start_ms", F.greatest(end, F.col("start_ms") + SOUND_MS).alias("end_ms"), event_label(label, kind, **formats).alias("line"), shown.alias("type"))
    return c.where("line != ''")


def in_order(dialogue: DataFrame, sound: DataFrame) -> DataFrame:
    """All cues by start, dialogue first, numbered anew; both have timeline_id, pos, start_ms, end_ms, line, type."""
    both = dialogue.unionByName(sound)
    order = Window.partitionBy("timeline_id").orderBy("start_ms", F.col("type") != "dialogue", "pos", "end_ms", "line")
    return both.withColumn("seq", F.row_number().over(order).cast("long")).drop("pos")


def italicized(lines: Column, phrases: list[str]) -> Column:
    def marked(line: Column) -> Column:
        for p in phrases:
            line = F.replace(line, F.lit(p), F.lit(f"<i>{p}</i>"))
        return line

    return F.transform(lines, marked)


def aligned(cues: DataFrame, windows: list[tuple[int, int, str]], default: str = "none") -> DataFrame:
    """The alignment of the first window that holds the cue, else the default, once before its first line."""
    held = F.lit(None).cast("string")
    for a, b, align in reversed(windows):
        held = F.when((F.col("start_ms") >= a) & (F.col("end_ms") <= b), align).otherwise(held)
    align = F.coalesce(held, F.lit(default))
    marked = F.concat(F.array(F.concat(F.lit("{\\+"), align, F.lit("}"), F.col("lines")[0])), F.slice("lines", 2, F.greatest(F.lit(0), F.size("lines") - 1)))
    needs = (align != "none") & (F.size("lines") > 0) & ~F.startswith(F.col("lines")[0], F.lit("{\\+"))
    return cues.withColumn("lines", F.when(needs, marked).otherwise(F.col("lines")))


def exploded_cjk(tokens: DataFrame) -> DataFrame:
    """Timed tokens of several CJK sentences, one row a sentence, times by share of signs; others as they are."""
    ends = "。！？．!?."
    text = F.trim("text")
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"([^{ends}]*[{ends}]|[^{ends}]+$)"), 1), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.regexp_replace(text, r"\s", "")
    cjk = F.length(F.regexp_replace(bare, "[^㐀-䶿一-鿿぀-ヿ가-힯　-〿＀-￯]", "")) * 10 >= F.length(bare) * 3
    split = cjk & (bare != "") & (F.size(parts) > 1) & (F.col("end_ms") >= F.col("start_ms"))
    t = tokens.withColumn("_parts", F.when(F.coalesce(split, F.lit(False)), parts).otherwise(F.array(F.col("text"))))
    e = t.select("timeline_id", "pos", "speaker", "start_ms", "end_ms", F.size("_parts").alias("n"), "_parts", F.posexplode("_parts").alias("k", "part"))
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    span, total = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")), size(F.col("_parts"))
    at = lambda k: F.col("start_ms") + F.floor(span * size(F.slice("_parts", F.lit(1), k)) / total)
    a, b = at(F.col("k")), at(F.col("k") + 1)
    return e.select("timeline_id", "pos", "k", "speaker", F.col("part").alias("text"), F.when(F.col("n") > 1, a).otherwise(F.col("start_ms")).alias("start_ms"), F.when(F.col("n") > 1, F.greatest(b, a + 1)).otherwise(F.col("end_ms")).alias("end_ms"))


def parse_srt(documents: DataFrame) -> DataFrame:
    """timeline_id, seq, start_ms, end_ms, lines of subtitle documents: blocks between blank lines, an
    optional number, a line of times; other blocks go."""
    blocks = documents.select("timeline_id", F.posexplode(F.split(F.trim("document"), r"\n\s*\n")).alias("block", "body"))
    rows = blocks.select("timeline_id", "block", F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "").alias("l"))
    skip = F.when(F.col("l")[0].rlike(r"^\s*[+-]?\d+\s*$"), 1).otherwise(0)
    times = F.split(F.get("l", skip), "-->")
    kept = rows.where(F.size("l") >= 2).withColumns({"t": times, "lines": F.slice("l", skip + 2, F.greatest(F.lit(0), F.size("l") - skip - 1))}).where(F.size("t") == 2)
    seq = F.row_number().over(Window.partitionBy("timeline_id").orderBy("block"))
    return kept.select("timeline_id", seq.cast("long").alias("seq"), parse(F.col("t")[0]).alias("start_ms"), parse(F.col("t")[1]).alias("end_ms"), "lines")


def speaker_fields(cues: DataFrame, name) -> DataFrame:
    """Label of the first known speaker, segments (eight at most) of several, or a review flag."""
    known = F.array_distinct(F.filter(F.transform("runs", lambda r: r["speaker"]), lambda s: s.isNotNull()))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")

    def part(r, i):
        until = F.coalesce(F.get("runs", i + 1)["word_start"], F.size(words))
        return F.struct(r["speaker"].alias("speaker"), F.array_join(F.slice(words, r["word_start"] + 1, F.greatest(F.lit(0), until - r["word_start"])), " ").alias("text"))

    parts = F.filter(F.transform("runs", part), lambda p: p["speaker"].isNotNull() & (p["text"] != ""))
    open_ = F.col("review") | (F.size(known) == 0)
    dialogue = F.coalesce("type", F.lit("dialogue")) == "dialogue"
    return cues.withColumns({
        "speaker_review_required": dialogue & open_,
        "speaker_label": F.when(dialogue & ~open_, name(known[0])),
        "speaker_segments": F.when(dialogue & ~open_ & (F.size(known) > 1), F.slice(parts, 1, 8)),
    })


def srt_sound_tokens(cues: DataFrame) -> DataFrame:
    """Sound tokens of the bracketed tags in parsed subtitle cues (timeline_id, seq, start_ms, end_ms, lines)."""
    return sound_tokens(cues.select("timeline_id", F.col("seq").alias("utt"), "start_ms", "end_ms", F.array_join("lines", " ").alias("text")))


def caption_inputs(utts: DataFrame, spoken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subtitle text of the utterances, and spoken tokens merged with the sounds in their text."""
    sound = sound_tokens(utts).withColumns({"pos": (F.col("utt") * 100_000 + F.col("k")).cast("long"), "speaker": F.lit(None).cast("string"), "original_start_ms": F.lit(None).cast("long"), "original_end_ms": F.lit(None).cast("long")})
    known = [c for c in ("original_start_ms", "original_end_ms") if c not in spoken.columns]
    return backbone(utts), merge_tokens(spoken.withColumns({c: F.lit(None).cast("long") for c in known}), sound)


def proportional_words(texts: DataFrame) -> DataFrame:
    """Words of (timeline_id, start_ms, end_ms, text), each with its share of the time by its signs."""
    words = texts.select("timeline_id", "start_ms", "end_ms", F.posexplode(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("pos", "word"))
    order = Window.partitionBy("timeline_id").orderBy("pos")
    upto, total = F.sum(F.length("word")).over(order), F.sum(F.length("word")).over(Window.partitionBy("timeline_id"))
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda n: F.col("start_ms") + F.floor(span * n / total)
    return words.select("timeline_id", "pos", F.col("word").alias("text"), at(upto - F.length("word")).alias("start_ms"), at(upto).alias("end_ms"))


#: A provider's result: words in seconds.
PROVIDER = "transcription_id string, language_code string, text string, words array<struct<text string, start string, end string, type string, speaker_id string, confidence double, logprob double>>"


def provider_words(results: DataFrame) -> DataFrame:
    """Words of provider results (``PROVIDER``), in order."""
    w = results.select(F.col("transcription_id").alias("timeline_id"), F.posexplode("words").alias("pos", "w"))
    return w.select("timeline_id", F.col("pos").cast("long").alias("pos"), "w.text", "w.type", "w.start", "w.end", "w.speaker_id", "w.confidence", "w.logprob")


def normalized(results: DataFrame, needles) -> dict[str, DataFrame]:
    """Provider results as ``words`` (milliseconds, speaker letters), ``utterances``, ``audio_events``
    and ``transcripts`` (duration in seconds, text without event marks)."""
    from cuesmith.operators.segment import speaker_letters

    raw = provider_words(results)
    spoken = raw.where(~is_event_word(F.col("text"), F.col("type"), needles))
    letters = speaker_letters(spoken.select("timeline_id", "pos", F.col("speaker_id").alias("speaker"))).select("timeline_id", F.col("speaker").alias("speaker_id"), "letter")
    sure = F.when(F.coalesce("logprob", F.lit(0.0)) != 0, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    words = spoken.where(F.trim("text") != "").join(letters, ["timeline_id", "speaker_id"], "left").select(
        "timeline_id", "pos", F.trim("text").alias("text"), F.col("letter").alias("speaker"), seconds_to_ms(F.col("start")).alias("start_ms"), seconds_to_ms(F.coalesce("end", "start")).alias("end_ms"), sure.alias("confidence"),
    )
    lasts = raw.groupBy("timeline_id").agg((F.max(seconds_to_ms(F.col("end"))) / 1000).alias("audio_duration"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), EVENT_WORD, " "), r"\s+", " "))
    heads = results.select(F.col("transcription_id").alias("timeline_id"), "language_code", clean.alias("text")).join(lasts, "timeline_id", "left").fillna(0.0, ["audio_duration"])
    return {"words": words, "utterances": utterances(utterance_words(words)), "audio_events": word_events(raw, needles), "transcripts": heads}


def result_cues(cues: DataFrame, name) -> DataFrame:
    """Cues as a result shows them: number, times, lines, type, speaker fields."""
    fields = speaker_fields(cues, name)
    return fields.select("timeline_id", F.col("seq").alias("idx"), "start_ms", "end_ms", "lines", F.coalesce("type", F.lit("dialogue")).alias("type"), "speaker_label", "speaker_segments", "speaker_review_required")


def job_results(cues: DataFrame, documents: DataFrame, rollups: DataFrame) -> DataFrame:
    """One nested result a timeline: its cues in order, its subtitle text and its quality rollup, as JSON."""
    fields = [c for c in cues.columns if c != "timeline_id"]
    listed = cues.groupBy("timeline_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("cues"))
    qc = rollups.select("timeline_id", F.struct(*[c for c in rollups.columns if c != "timeline_id"]).alias("segmentation_qc"))
    joined = listed.join(documents.select("timeline_id", F.col("document").alias("srt")), "timeline_id", "left").join(qc, "timeline_id", "left")
    return joined.select("timeline_id", F.to_json(F.struct("cues", "segmentation_qc", "srt")).alias("result"))

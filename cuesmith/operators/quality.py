"""Quality of cues, with column functions: grades, segmentation issues, remedies, rollups.

Cues have ``timeline_id, seq, start_ms, end_ms, type, lines, speakers`` (distinct known
speakers). Nothing here changes a cue: an issue is ``resolved`` if a remedy would work.

Cases: no lines count as one empty line; null times make no issue; a null type is
dialogue; the last cue has no next one; an empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.functions import words as W
from cuesmith.functions.layout import Spec
from cuesmith.functions.timecode import from_frame, to_frame

# ---- fixed values
FLASH_MS, MICRO_MS, SPEED_RATIO, LOAD_RATIO = 400, 1000, 2.2, 3.0
SEVERITY = {
    "CPS_OVER_MAX": "fail", "DURATION_BELOW_MIN": "fail", "FRAME_GRID_MISALIGNMENT": "fail", "MIN_GAP_FRAMES": "fail", "UNRESOLVED_UNTIMED_CONTENT": "fail",
    "FLASH_CUE": "fail", "PROTECTED_PHRASE_SPLIT": "fail", "PROTECTED_PHRASE_GEOMETRY_CONFLICT": "fail", "SPEAKER_LABEL_CAUSED_CPS_FAILURE": "fail",
    "SPEAKER_LABEL_CAUSED_CPL_FAILURE": "fail", "SPEAKER_LABEL_UNRESOLVED": "fail", "MEANINGFUL_TEXT_REMOVED": "fail", "OPTIMIZER_BOUNDARY_VIOLATION": "fail",
    "MICRO_CUE": "warn", "AVOIDABLE_FRAGMENT": "warn", "READING_SPEED_IMBALANCE": "warn", "OVERLOADED_UNDERFILLED_ADJACENCY": "warn",
    "PROVENANCE_INCOMPLETE": "info", "TIMING_PROVENANCE_MISSING": "info", "SEGMENTATION_PROVENANCE_MISSING": "info",
}
RULES = {
    "CPS_OVER_MAX": "max_cps", "DURATION_BELOW_MIN": "min_caption_duration_ms", "FRAME_GRID_MISALIGNMENT": "frame_grid", "MIN_GAP_FRAMES": "min_gap_between_captions_frames",
    "SPEAKER_LABEL_CAUSED_CPS_FAILURE": "max_cps", "SPEAKER_LABEL_CAUSED_CPL_FAILURE": "max_chars_per_line", "PROTECTED_PHRASE_GEOMETRY_CONFLICT": "protected_phrase",
    "PROTECTED_PHRASE_SPLIT": "protected_phrase", "FLASH_CUE": "min_caption_duration_ms", "MEANINGFUL_TEXT_REMOVED": "text_conservation",
    "OPTIMIZER_BOUNDARY_VIOLATION": "segmentation_boundary", "UNRESOLVED_UNTIMED_CONTENT": "timing_completeness",
}
# ----

def order():
    return Window.partitionBy("timeline_id").orderBy("seq")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def plain_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"""[.,;:!?"'()\[\]]""", ""))


def spoken(text: Column) -> Column:
    """Without the dashes that open lines."""
    return F.regexp_replace(text, r"(?m)^-\s+", "")


def ends_on_function_word(line: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(line)), r"(?U)[^\w']+$", "")
    return F.coalesce(F.element_at(words_of(bare), -1).isin(*W.QC_FUNCTION_WORDS.split()), F.lit(False))


def is_one_word(lines: Column) -> Column:
    return F.regexp_count(F.array_join(lines, " "), F.lit(r"(?U)\b\w+\b")) == 1


def is_fragment(text: Column) -> Column:
    """One or two words that end no sentence."""
    said = F.trim(spoken(text))
    return F.size(words_of(said)).between(1, 2) & ~said.rlike("[.!?…][\"'”’)\\]]?\\s*$")


def _sound() -> Column:
    return F.coalesce(F.col("type").isin("sound", "music", "sound_effect"), F.lit(False))


def _dialogue(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("dialogue")) == "dialogue"


def phrase_splits(lines: Column, phrases: list[str]) -> Column:
    """How many phrases stand in the text and also across a line break."""
    across, whole = F.array_join(lines, "\n"), F.array_join(lines, " ")
    parts = [(F.contains(whole, F.lit(p)) & F.contains(across, F.lit(p.replace(" ", "\n")))).cast("long") for p in phrases if p]
    return sum(parts[1:], parts[0]) if parts else F.lit(0).cast("long")


# -------------------------------------------------------------------- grades


def graded(cues: DataFrame, spec: Spec = Spec(), min_sound_ms: int = 800) -> DataFrame:
    """Cues with ``violations``: rule, severity, actual value, limit and what to do."""
    chars, sound = F.length(F.trim(F.array_join("lines", " "))), _sound()
    lasts = F.col("end_ms") - F.col("start_ms")
    speed = F.round(chars / (F.greatest(F.lit(1), lasts) / 1000.0), 2)
    longest = F.coalesce(F.array_max(F.transform("lines", F.length)), F.lit(0))
    least = F.when(sound, min_sound_ms).otherwise(spec.min_display_ms)

    def violation(when, rule, severity, actual, limit, fix):
        body = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), actual.cast("double").alias("actual"), limit.cast("double").alias("limit"), F.lit(fix).alias("fix"))
        return F.when(when, body)

    none = F.lit(None)
    found = F.array(
        violation(longest > spec.max_chars, "max_chars_per_line", "fail", longest, F.lit(spec.max_chars), "rewrap_lines"),
        violation(F.size("lines") > spec.max_lines, "max_lines_per_caption", "fail", F.size("lines"), F.lit(spec.max_lines), "split_cue"),
        violation(~sound & (speed > spec.max_cps), "max_cps", "fail", speed, F.lit(spec.max_cps), "split_or_extend_cue"),
        violation(~sound & (speed < spec.min_cps) & (chars > 0), "min_cps", "warn", speed, F.lit(spec.min_cps), "trim_cue"),
        violation(~sound & is_one_word(F.col("lines")), "one_word_cue", "warn", F.lit(1), none, "merge_neighbor"),
        violation(~sound & F.exists("lines", ends_on_function_word), "weak_line_ending", "warn", none, none, "rewrap_lines"),
        violation(lasts < least, "min_caption_duration_ms", "warn", lasts, least, "extend_cue"),
    )
    return cues.withColumn("violations", F.array_compact(found))


def report(cues: DataFrame, phrases: list[str], spec: Spec = Spec(), min_sound_ms: int = 800) -> DataFrame:
    """One row a timeline: counts of what breaks a rule, and whether it blocks the export."""
    after = F.lead("start_ms").over(order())
    g = graded(cues, spec, min_sound_ms).withColumn("_over", F.col("end_ms") > after).withColumn("_next", F.lead("type").over(order()))
    sound, lasts = _sound(), F.col("end_ms") - F.col("start_ms")
    fails, warns = F.filter("violations", lambda v: v["severity"] == "fail"), F.filter("violations", lambda v: v["severity"] == "warn")
    return g.groupBy("timeline_id").agg(
        F.count("*").alias("cues_out"), F.count_if("_over").alias("overlaps"),
        F.count_if(F.col("_over") & ((F.col("type") == "sound") | (F.col("_next") == "sound"))).alias("sound_overlap_violations"),
        F.count_if(F.size("lines") > spec.max_lines).alias("max_lines_violation"),
        F.count_if(F.exists("lines", lambda x: F.length(x) > spec.max_chars)).alias("max_chars_violation"),
        F.count_if(lasts < F.when(sound, min_sound_ms).otherwise(spec.min_display_ms)).alias("short_duration_violations"),
        F.count_if(~sound & is_one_word(F.col("lines"))).alias("one_word_dialogue_cues"),
        F.sum(F.size(F.filter("lines", ends_on_function_word)).cast("long")).alias("function_word_endings"),
        F.sum(phrase_splits(F.col("lines"), phrases)).alias("protected_phrase_splits"),
        F.count_if((F.col("type") == "dialogue") & (F.size("speakers") >= 2)).alias("multi_speaker_dialogue_cues"),
        F.sum(F.size(fails).cast("long")).alias("total_fail"), F.sum(F.size(warns).cast("long")).alias("total_warn"),
        F.count_if(F.size(fails) > 0).alias("blocked_cue_count"), F.bool_or(F.size(fails) > 0).alias("export_blocked"),
    )


# ------------------------------------------------------- segmentation issues


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, though lambda functions in it refer to it often."""
    return F.transform(F.array(value), use)[0]


def broken_phrase(lines: Column, phrases: list[str]) -> Column:
    """The first phrase of two words or more that a line break cuts, else null."""
    plain = F.array_join(F.transform(lines, lambda x: F.array_join(F.transform(words_of(x), plain_word), " ")), "\n")
    found = F.lit(None).cast("string")
    for phrase in reversed(phrases):
        want = [re.escape(x) for x in ("".join(s for s in w if s not in ".,;:!?\"'()[]") for w in phrase.lower().split()) if x]
        if len(want) > 1:  # its words with blanks or line breaks between them, not blanks alone
            whole = rf"(?<![^ \n])(?!{' '.join(want)}(?![^ \n])){'[ \n]'.join(want)}(?![^ \n])"
            found = F.when(plain.rlike(whole), phrase).otherwise(found)
    return found


def phrase_safe(lines: Column, phrase: Column, max_cpl: int) -> Column:
    """Whether two lines of at most ``max_cpl`` signs hold the text without cutting ``phrase``."""
    want = F.filter(F.transform(words_of(F.lower(phrase)), plain_word), lambda w: w != "")

    def judged(x: Column) -> Column:
        flat, m = x["flat"], F.size(x["want"])
        starts = F.filter(F.sequence(F.lit(1), F.size(flat)), lambda i: F.slice(x["norm"], i, m) == x["want"])
        return F.when((F.size(flat) < 2) | (F.size(starts) == 0), True).otherwise(_let(F.element_at(starts, 1) - 1, lambda first: fits_around(flat, first, m)))

    def fits_around(flat: Column, first: Column, m: Column) -> Column:
        part = lambda a, n: F.length(F.array_join(F.slice(flat, a, n), " "))
        good = lambda b: ~((first < b) & (b < first + m)) & (part(F.lit(1), b) <= max_cpl) & (part(b + 1, F.size(flat) - b) <= max_cpl)
        return F.exists(F.sequence(F.lit(1), F.size(flat) - 1), good)

    flat = words_of(F.array_join(lines, " "))
    return F.when(phrase.isNotNull(), _let(F.struct(flat.alias("flat"), F.transform(flat, plain_word).alias("norm"), want.alias("want")), judged)).otherwise(False)


def issues(cues: DataFrame, phrases: list[str] = (), max_cps: int = 17, max_cpl: int = 42, min_ms: int = 800, gap_ms: int = 80, num: int = 25, den: int = 1, speaker: str | None = None, label: str | None = None) -> DataFrame:
    """timeline_id, seq, issue_code, severity, metric, attempted, result: a row for each issue.

    ``speaker`` names the column that adjacent cues are compared by, ``label`` the one that says that
    a cue's text opens with a label (none: those checks are off).
    """
    text = F.array_join("lines", "\n")
    cjk = text.rlike("[　-鿿가-힯＀-￯]")
    lasts = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    chars = F.length(F.replace(text, F.lit("\n"), F.lit("")))
    said = F.length(F.replace(spoken(text), F.lit("\n"), F.lit("")))
    speed = lambda n, ms: F.when(ms > 0, n / (ms / 1000.0)).otherwise(F.lit(float("inf")))
    on_grid = lambda ms: from_frame(to_frame(ms, num, den), num, den) == ms
    c = cues.withColumns({
        "_lasts": lasts, "_chars": chars, "_cps": speed(chars, lasts), "_said": said, "_saying": speed(said, lasts), "_cjk": cjk, "_text": text,
        "_from": F.lead("start_ms").over(order()), "_past": F.lag("end_ms").over(order()), "_kind": F.lead(F.coalesce("type", F.lit("dialogue"))).over(order()),
        "_phrase": F.when(~cjk, broken_phrase(F.col("lines"), list(phrases))),
    })
    if speaker:
        c = c.withColumns({"_same": F.col(speaker) == F.lead(speaker).over(order()), "_said2": F.lead("_said").over(order()), "_saying2": F.lead("_saying").over(order())})
    start, end, dialogue = F.col("start_ms"), F.col("end_ms"), _dialogue(F.col("type"))
    # remedies: a later end, then an earlier start
    flash_end = F.least(start + FLASH_MS, F.coalesce(F.col("_from") - gap_ms, start + FLASH_MS))
    need = F.floor(F.col("_chars") / max_cps * 1000) + 1
    late = F.greatest(F.least(start + need, F.coalesce(F.col("_from") - gap_ms, start + need)), end)
    early = F.least(F.greatest(late - need, F.coalesce(F.col("_past") + gap_ms, late - need)), start)
    longer = (need > F.greatest(F.lit(1), end - start)) & ((late - start >= need) | ((late - early >= need) & (early < start)))
    safe = phrase_safe(F.col("lines"), F.col("_phrase"), max_cpl)
    result = lambda ok: F.when(ok, "resolved").otherwise("unresolved")
    rows = [
        ("DURATION_BELOW_MIN", dialogue & (F.col("_lasts") < min_ms), F.col("_lasts"), True, F.lit("unresolved")),
        ("FRAME_GRID_MISALIGNMENT", ~on_grid(start) | ~on_grid(end), None, False, F.lit("unresolved")),
        ("MIN_GAP_FRAMES", dialogue & (F.col("_kind") == "dialogue") & (F.col("_from") - end < gap_ms), None, False, F.lit("unresolved")),
        ("FLASH_CUE", (F.col("_lasts") > 0) & (F.col("_lasts") < FLASH_MS), F.col("_lasts"), True, result(flash_end - start >= FLASH_MS)),
        ("MICRO_CUE", (F.col("_lasts") >= FLASH_MS) & (F.col("_lasts") < MICRO_MS), F.col("_lasts"), False, F.lit("flagged")),
        ("AVOIDABLE_FRAGMENT", ~F.col("_cjk") & is_fragment(F.col("_text")), F.size(words_of(spoken(F.col("_text")))), False, F.lit("flagged")),
        ("PROTECTED_PHRASE_SPLIT", F.col("_phrase").isNotNull() & safe, None, True, F.lit("resolved")),
        ("PROTECTED_PHRASE_GEOMETRY_CONFLICT", F.col("_phrase").isNotNull() & ~safe, None, True, F.lit("unresolved")),
        ("CPS_OVER_MAX", dialogue & (F.col("_cps") > max_cps), F.col("_cps"), True, result(longer)),
    ]
    if speaker:
        ratio = lambda a, b: F.greatest(a, b) / F.least(a, b)
        fast, load = ratio(F.col("_saying"), F.col("_saying2")), ratio(F.col("_said"), F.col("_said2"))
        finite = F.greatest("_saying", "_saying2") != float("inf")
        rows += [
            ("READING_SPEED_IMBALANCE", F.col("_same") & finite & (F.least("_saying", "_saying2") > 0) & (fast >= SPEED_RATIO), fast, False, F.lit("flagged")),
            ("OVERLOADED_UNDERFILLED_ADJACENCY", F.col("_same") & (F.least("_said", "_said2") > 0) & (load >= LOAD_RATIO), load, False, F.lit("flagged")),
        ]

    if label:
        tag = F.regexp_extract(F.col("_text"), r"^(?:\[[^\]]+:\]\s+|>>\s*[^:]+:\s+|\([^)]+\)\s+)", 0)
        body = F.col("_text").substr(F.length(tag) + 1, F.length("_text"))
        here = F.coalesce(F.col(label) != "", F.lit(False)) & (tag != "")
        bare = speed(F.length(F.replace(body, F.lit("\n"), F.lit(""))), F.col("_lasts"))
        longest = lambda x: F.array_max(F.transform(F.split(x, "\n"), lambda y: F.length(y)))
        wide = longest(F.col("_text"))
        flat = words_of(F.col("_text"))

        def splits(x: Column) -> Column:
            part = lambda a, n: F.length(F.array_join(F.slice(x, a, n), " "))
            return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x) - 1)), lambda b: (b < F.size(x)) & (part(F.lit(1), b) <= max_cpl) & (part(b + 1, F.size(x) - b) <= max_cpl))

        two = _let(flat, splits)
        later = F.least(start + need, F.coalesce(F.col("_from") - gap_ms, start + need))
        rows += [
            ("SPEAKER_LABEL_CAUSED_CPS_FAILURE", here & (bare <= max_cps) & (F.col("_cps") > max_cps), F.col("_cps"), True, result((later > end) & (F.col("_chars") / ((later - start) / 1000.0) <= max_cps))),
            ("SPEAKER_LABEL_CAUSED_CPL_FAILURE", here & (longest(body) <= max_cpl) & (wide > max_cpl), wide, True, result(two)),
        ]

    def issue(code, when, metric, attempted, outcome):
        value = F.lit(None).cast("double") if metric is None else metric.cast("double")
        return F.when(when, F.struct(F.lit(code).alias("issue_code"), F.lit(SEVERITY[code]).alias("severity"), value.alias("metric"), F.lit(attempted).alias("attempted"), outcome.alias("result")))

    listed = F.array_compact(F.array(*[issue(*r) for r in rows]))
    return c.select("timeline_id", "seq", F.inline(listed))


def unresolved_issues(groups: DataFrame) -> DataFrame:
    """An issue for each untimed sentence group, numbered ``ug#0`` on, with bounded evidence."""
    number = F.row_number().over(Window.partitionBy("timeline_id").orderBy("group_id")) - 1
    text = F.coalesce("text", F.array_join("words", " "))
    return groups.select(
        "timeline_id", F.concat(F.lit("ug#"), number.cast("string")).alias("unresolved_group_id"), F.lit("UNRESOLVED_UNTIMED_CONTENT").alias("issue_code"), F.lit("fail").alias("severity"),
        F.substring(text, 1, 2000).alias("text"), (F.length(text) > 2000).alias("text_truncated"), F.length(text).cast("long").alias("original_text_length"),
        F.slice("words", 1, 400).alias("words"), F.size("words").cast("long").alias("word_count"), F.nullif(F.substring("speaker", 1, 128), F.lit("")).alias("speaker"),
    )


def cue_summaries(found: DataFrame) -> DataFrame:
    """By cue: status, highest severity, codes in order, whether to review, outcome."""
    hard = F.col("severity") == "fail"
    s = found.groupBy("timeline_id", "seq").agg(
        F.bool_or(hard).alias("_hard"), F.bool_or(hard & (F.col("result") != "resolved")).alias("review_required"), F.bool_or(F.col("severity") == "warn").alias("_warn"),
        F.array_sort(F.collect_set("issue_code")).alias("issue_codes"),
    )
    open_, fixed = F.col("review_required"), F.col("_hard")
    return s.select(
        "timeline_id", "seq", F.when(open_, "fail").when(fixed, "corrected").otherwise("warn").alias("status"),
        F.when(F.col("_hard"), "fail").when(F.col("_warn"), "warn").otherwise("info").alias("highest_severity"), "issue_codes", "review_required",
        F.when(open_, "unresolved").when(fixed, "corrected").otherwise("flagged").alias("outcome"),
    )


def rollup(found: DataFrame) -> DataFrame:
    """By timeline: cues by status, attempts, rules broken, and whether the export is blocked."""
    rules = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    hard = F.col("severity") == "fail"
    cues = found.groupBy("timeline_id", "seq").agg(
        F.bool_or(hard).alias("hard"), F.bool_or(hard & (F.col("result") != "resolved")).alias("open"), F.count("*").alias("n"),
        F.count_if("attempted").alias("tried"), F.collect_set(F.when(hard, rules[F.col("issue_code")])).alias("rules"),
    )
    r = cues.groupBy("timeline_id").agg(
        F.count_if("open").alias("n_fail"), F.count_if(F.col("hard") & ~F.col("open")).alias("n_corrected"), F.count_if(~F.col("hard")).alias("n_warn"), F.count_if("open").alias("n_review"),
        F.sum("n").alias("n_issues"), F.sum("tried").alias("n_attempts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))).alias("technical_violations"),
    )
    state = F.when(F.col("n_fail") > 0, "has_unresolved").when(F.col("n_corrected") > 0, "corrected").otherwise("clean")
    return r.withColumn("completeness", state).withColumn("export_blocked", F.col("n_review") > 0)


def removed_words(original: DataFrame, cues: DataFrame) -> DataFrame:
    """Distinct words of a timeline's (pos, text) that no cue of it shows, function words apart, in order."""
    shown = cues.select("timeline_id", F.explode(words_of(spoken(F.array_join("lines", "\n")))).alias("w")).select("timeline_id", plain_word(F.col("w")).alias("word")).distinct()
    said = original.select("timeline_id", "pos", plain_word(F.col("text")).alias("word")).where((F.col("word") != "") & ~F.col("word").isin(*W.QC_STOPWORDS.split()))
    return said.groupBy("timeline_id", "word").agg(F.min("pos").alias("pos")).join(shown, ["timeline_id", "word"], "left_anti")

"""Passes over cue text and word times: repeated labels, letter case, condensing, word-timing repair.

Cases: as in :mod:`cuesmith.operators.cues`; words without times are kept and never
take part as evidence; transcripts of other providers are not repaired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.functions import speech as S
from cuesmith.functions.layout import Spec, fits, is_cjk, render, visible_chars, wrap
from cuesmith.operators.cues import Cue, fold, mergeable, merged

TURN_MODES = ("first_occurrence_per_scene", "named", "every_change", "alpha", "generic")


def suppress_labels(cues: list[Cue], spec: Spec, scenes: frozenset[int] = frozenset()) -> Iterator[Cue]:
    """A label stays only where the speaker is another than that of the last known dialogue cue,
    or a scene (0-based cue number) begins."""
    last = None
    for k, c in enumerate(cues):
        last = None if k in scenes else last
        if c.said and spec.label_mode in TURN_MODES and c.first_speaker is not None:
            bare = [S.strip_line_label(x) for x in c.lines]
            if c.first_speaker == last and bare != list(c.lines):
                c = replace(c, lines=tuple(wrap(" ".join(bare).strip(), spec)))
            last = c.first_speaker
        yield c


def capitalize(cues: list[Cue], spec: Spec) -> Iterator[Cue]:
    """A cue that opens a sentence, or follows a wall, begins with a capital; one that continues a
    sentence loses it where the timeline shows that the word has none."""
    proper, lower = S.case_evidence(c.text for c in cues if c.said)
    ended, word_before, before = True, "", None
    for c in cues:
        label, body = S.split_label(c.text.strip())
        if c.said and body.strip():
            first = body.split()[0]
            starts = ended or (before is not None and not mergeable(before, c))
            if starts:
                new = S.with_first(body, lambda w: S.set_case(w, True))
            else:
                new = S.with_first(body, lambda w: w[0].lower() + w[1:]) if S.may_lower(first, word_before, proper, lower) else body
            decided = next((x for x in new.split()[0] if x.isalpha()), "")
            if c.lines and decided:
                tag, said = S.split_label(c.lines[0])
                if S.core_of((said.split() or [""])[0]).lower() == S.core_of(first).lower():
                    c = replace(c, lines=(tag + S.with_first(said, lambda w: S.set_case(w, decided.isupper())), *c.lines[1:]))
            c = replace(c, text=(label + new).strip() if new != body else c.text)
            words = S.split_label(c.text.strip())[1].split()
            word_before, before = (words or [""])[-1], c
            ended = S.ends_sentence(word_before.rstrip(S.CLOSERS))
        yield c


def _speed(text: str, c: Cue, spec: Spec) -> float:
    return visible_chars(text, spec.measure) / (max(1, c.lasts) / 1000.0)


def _shown(c: Cue) -> str:
    return " ".join(c.lines).strip() or c.text.strip()


def _reworded(c: Cue, text: str, spec: Spec) -> Cue:
    """The cue with another text; a label in the text is not part of its lines."""
    return replace(c, text=text, lines=tuple(render(S.split_label(text)[1], c.runs, spec)))


def rejoin(cues: list[Cue], spec: Spec, gap_ms: int = 1200, passes: int = 4) -> list[Cue]:
    """Two cues of one sentence, one of them too fast, become one without fillers, if that can be
    shown long enough and fits."""
    for _ in range(passes):
        out, k = [], 0
        while k < len(cues):
            a, b = cues[k], cues[k + 1] if k + 1 < len(cues) else None
            one = _rejoined(a, b, cues[k + 2] if k + 2 < len(cues) else None, spec, gap_ms) if b else None
            out.append(one or a)
            k += 2 if one else 1
        if len(out) == len(cues):
            break
        cues = out
    return cues


def _rejoined(a: Cue, b: Cue, after: Cue | None, spec: Spec, gap_ms: int) -> Cue | None:
    text = a.text.strip()
    if not (a.said and b.said and text) or is_cjk(text) or S.ends_sentence(text.split()[-1].rstrip(S.CLOSERS)) or not mergeable(a, b):
        return None
    slow = max(_speed(text, a, spec), _speed(b.text, b, spec)) <= spec.max_cps
    if slow or b.start - a.end > gap_ms or b.end - a.start > spec.max_display_ms:
        return None
    one = merged(a, b, spec)
    short = S.remove_disfluencies(one.text)
    need = -(-visible_chars(short, spec.measure) * 1000 // max(1, spec.max_cps))
    latest = min(a.start + spec.max_display_ms, after.start - spec.gap_ms if after else a.start + spec.max_display_ms)
    one = replace(_reworded(one, short, spec), start=a.start, end=max(b.end, min(a.start + need, latest)))
    return one if _speed(_shown(one), one, spec) <= spec.max_cps and fits(one.text, one.runs, spec) else None


def fragments(cues: list[Cue]) -> list[bool]:
    """Whether each dialogue cue is part of a sentence that other cues share."""
    out, ended = [], True
    for c in cues:
        words = c.text.split()
        ends = bool(words) and S.ends_sentence(words[-1].rstrip(S.CLOSERS))
        out.append(c.said and not (ends and ended))
        ended = ends if c.said else ended
    return out


def condense(cues: list[Cue], spec: Spec, mode: str = "disfluency_only") -> list[Cue]:
    """Cues shown too fast lose fillers and repetitions; ``condense_to_cps`` first rejoins sentences."""
    if mode == "off":
        return list(cues)
    cues = rejoin(cues, spec) if mode == "condense_to_cps" else cues
    out = []
    for c in cues:
        if c.said and c.text.strip() and _speed(_shown(c), c, spec) > spec.max_cps:
            short = S.remove_disfluencies(c.text.strip())
            c = _reworded(c, short, spec) if short != c.text.strip() else c
        out.append(c)
    return out


# ------------------------------------------------------------ word timings

# ---- fixed values: milliseconds of the word-timing policy
LONGEST_WORD, USUAL_WORD, SHORTEST_WORD, WORD_GAP, EXCESS, SAMPLES = 2600, 1200, 200, 20, 2000, 5
REPAIRED_SOURCES = (("elevenlabs", "scribe_v2"),)
# ----
WORD = "timeline_id long, utt long, pos long, speaker string, text string, start_ms long, end_ms long"
REPAIRED = "timeline_id long, seq long, utt long, pos long, speaker string, text string, start_ms long, end_ms long, disposition string, evidence string, original_start_ms long, original_end_ms long"


def _timed(w: dict) -> bool:
    return w["start_ms"] is not None and w["end_ms"] is not None and w["end_ms"] >= w["start_ms"]


def _next_start(words: list[dict], k: int) -> int | None:
    """The start of the next timed word that begins no earlier, if the same speaker says it."""
    w = words[k]
    later = (x for x in words[k + 1 :] if _timed(x) and x["start_ms"] >= w["start_ms"])
    x = next(later, None)
    return x["start_ms"] if x and x["speaker"] == w["speaker"] else None


def _usual(words: list[dict], k: int) -> int | None:
    """The median duration of the utterance's other plausible words, if there are enough and it is plausible itself."""
    lasts = [x["end_ms"] - x["start_ms"] for j, x in enumerate(words) if j != k and x["utt"] == words[k]["utt"] and _timed(x)]
    lasts = [n for n in lasts if 0 < n <= LONGEST_WORD]
    middle = int(median(lasts)) if len(lasts) >= SAMPLES else 0
    return middle if middle >= SHORTEST_WORD else None


def repair_words(words: list[dict], provider: str, model: str) -> Iterator[dict]:
    """Words of implausible length end earlier - by the next word, else by the utterance's median -
    or lose their times where neither is to be trusted."""
    words = [dict(w, disposition=None, evidence=None, original_start_ms=None, original_end_ms=None) for w in words]
    covered = (provider.strip().lower(), model.strip().lower()) in REPAIRED_SOURCES
    for k, w in enumerate(words):
        lasts = w["end_ms"] - w["start_ms"] if _timed(w) else 0
        if not covered or lasts <= LONGEST_WORD:
            continue
        start, end, after = w["start_ms"], w["end_ms"], _next_start(words, k)
        if after is not None and abs(end - after) < EXCESS and lasts < LONGEST_WORD + EXCESS:
            continue  # the next word bears it out
        new, evidence, latest = None, None, start + USUAL_WORD
        if after is not None and after - WORD_GAP > start:
            new, evidence = min(latest, after - WORD_GAP), "neighbour"
            holder = next(x for x in words[k + 1 :] if _timed(x) and x["start_ms"] >= start)
            evidence = "neighbour" if holder["utt"] == w["utt"] else "cross_utterance_neighbour"
        elif (usual := _usual(words, k)) is not None:
            new, evidence = min(latest, start + usual), "interpolation"
        w |= {"original_start_ms": start, "original_end_ms": end}
        if new is None or new >= end:
            w |= {"start_ms": None, "end_ms": None, "disposition": "quarantined", "evidence": "quarantine"}
        else:
            bound = new if after is None else min(new, after - WORD_GAP)
            w |= {"end_ms": min(max(bound, start + SHORTEST_WORD), end - 1), "disposition": "repaired", "evidence": evidence}
    return iter(words)


def repair(tokens: DataFrame, provider: str = "elevenlabs", model: str = "scribe_v2") -> DataFrame:
    """Tokens (``WORD``) with repaired times, what was done and the original times."""
    names = [c.strip().split(" ")[0] for c in WORD.split(",")]

    def step(rows):
        return [{k: v for k, v in w.items() if k != "timeline_id"} for w in repair_words(rows, provider, model)]

    return fold(tokens.select(*names), "pos", REPAIRED, step)


def repair_summary(repaired: DataFrame) -> DataFrame:
    """By timeline: words found, repaired and quarantined, and whether someone has to look."""
    done = lambda k: F.count_if(F.col("disposition") == k)
    s = repaired.groupBy("timeline_id").agg(F.count("disposition").alias("detected"), done("repaired").alias("repaired"), done("quarantined").alias("quarantined"))
    return s.withColumn("review_required", F.col("quarantined") > 0)

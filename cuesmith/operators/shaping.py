"""Rhythm: cues shown for long, or with more text than fits, are cut where a phrase ends.

Cues are shaped one by one, each up to eight times over. Cut times come from the words
that lie in the cue where it has any, else from the share of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from cuesmith.functions import words as W
from cuesmith.functions.layout import Spec, cjk_count, fits, is_cjk, render, traits
from cuesmith.functions.speech import remove_disfluencies, split_label
from cuesmith.operators.cues import Cue, open_delimiter

PASSES = 8


def clause_ends(words: list[str]) -> list[int]:
    """Places after a punctuation mark, nearest to the middle first, with three words on both sides,
    no delimiter open and no function word behind."""
    n = len(words)
    good = [k for k in range(3, n - 2) if traits(words[k - 1]).close and not traits(words[k]).weak and not open_delimiter(" ".join(words[:k]))]
    return sorted(good, key=lambda k: (abs(2 * k - n), k))


def phrase_break(words: list[str]) -> int | None:
    """The best place between two words: before a function word, not behind one, near the middle."""
    n, least = len(words), 3 if len(words) > 5 else 1

    def gain(k: int) -> float:
        last, first = traits(words[k - 1]), traits(words[k])
        severed = (last.forward and not last.weak) + (first.particle and not first.leading)
        return 10 * first.weak - 12 * last.weak - 6 * severed - abs(k - n / 2)

    places = [k for k in range(max(1, least), n - max(1, least) + 1) if not open_delimiter(" ".join(words[:k]))]
    return max(places, key=lambda k: (gain(k), -k), default=None)


def cut_time(c: Cue, left: str, whole: str) -> int:
    """When the left part has been said."""
    cjk, span = is_cjk(whole), max(2, c.lasts)
    size = cjk_count if cjk else len
    said = 0
    for text, _, end in c.timings:
        said += size(text) + (not cjk)
        if said >= size(left):
            if c.start < end < c.end:
                return end
            break
    return c.start + (int(span * (size(left) / size(whole))) if size(whole) else span // 2)


def _windows(c: Cue, cut: int, spec: Spec) -> tuple[int, int, bool]:
    """End of the left part, start of the right one, and whether both are shown long enough."""
    end, start = min(cut - spec.gap_ms // 2, c.end - spec.min_display_ms), max(cut + spec.gap_ms // 2, c.start + spec.min_display_ms)
    return end, start, min(end - c.start, c.end - start) >= spec.min_display_ms


def _place(c: Cue, words: list[str], spec: Spec, strict: bool) -> int | None:
    readable = lambda k: _windows(c, cut_time(c, " ".join(words[:k]), " ".join(words)), spec)[2]
    ends = clause_ends(words)
    if ends:
        return next(filter(readable, ends), ends[0])
    k = phrase_break(words)
    return k if k is not None and (not strict or readable(k)) else None


def cut_once(c: Cue, spec: Spec, strict: bool = True) -> list[Cue] | None:
    """The cue in two; ``strict`` gives up where a part would be shown too briefly."""
    text = c.text.strip()
    if is_cjk(text):
        marks = [k for k, sign in enumerate(text[:-1], 1) if sign in W.CJK_CLAUSE_SIGNS or sign in W.CJK_SENTENCE_SIGNS]
        k = min(marks, key=lambda k: abs(2 * k - len(text)), default=None)
        left, right = (text[:k].strip(), text[k:].strip()) if k else ("", "")
    else:
        words = text.split()
        k = _place(c, words, spec, strict) if len(words) > 1 else None
        left, right = (" ".join(words[:k]), " ".join(words[k:])) if k else ("", "")
    if not left or not right:
        return None
    cut = cut_time(c, left, text)
    end, start, good = _windows(c, cut, spec)
    if not good and strict:
        return None
    if not good and c.lasts >= 2 * spec.min_display_ms + spec.gap_ms:
        half, least = spec.gap_ms // 2, spec.min_display_ms + spec.gap_ms // 2
        cut = max(c.start + least, min(cut, c.end - least))
        end, start = cut - half, cut + half
    elif not good:
        end = start = c.start + max(1, int(c.lasts * (len(left) / max(1, len(left) + len(right)))))
    runs = ((c.runs[0][0] if c.runs else None, 0),)
    part = lambda t, a, b, wall: Cue(a, b, t, runs, review=c.review, wall=wall, timings=c.timings).shown(spec)
    return [part(left, c.start, end, c.wall), part(right, start, c.end, False)]


def condensed(c: Cue, spec: Spec) -> Cue | None:
    """A cue that only needs room, without its fillers, if that is room enough."""
    text = c.text.strip()
    short = remove_disfluencies(text) if text else ""
    if c.lasts > int(_target(spec) * 1.5) or fits(text, c.runs, spec) or short in ("", text):
        return None
    runs = ((c.runs[0][0] if c.runs else None, 0),)
    one = replace(c, text=short, runs=runs, review=False, wall=False, lines=tuple(render(split_label(short)[1], runs, spec)))
    return one if fits(short, runs, spec) else None


def _target(spec: Spec) -> int:
    return max(spec.target_ms, 2 * spec.min_display_ms)


def shape(cues: list[Cue], spec: Spec, passes: int = PASSES, condense: bool = True) -> Iterator[Cue]:
    """Dialogue longer than one and a half times the target, or too much to fit, is condensed or cut."""
    for c in cues:
        needs = passes and c.said and (max(1, c.lasts) > int(_target(spec) * 1.5) or not fits(c.text.strip(), c.runs, spec))
        one = condensed(c, spec) if needs and condense else None
        parts = [one] if one else cut_once(c, spec) if needs else None
        yield from shape(parts, spec, passes - 1, condense) if parts else [c]


def fit_lines(cues: list[Cue], spec: Spec, passes: int = PASSES) -> Iterator[Cue]:
    """Dialogue that does not fit is cut, however briefly the parts are then shown."""
    for c in cues:
        parts = cut_once(c, spec, strict=False) if passes and c.said and not fits(c.text.strip(), c.runs, spec) else None
        yield from fit_lines(parts, spec, passes - 1) if parts else [c]

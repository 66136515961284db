"""Lines of a cue: where text breaks, how speakers are labelled, whether it fits.

These rules work word by word on short texts, so they are plain Python: folds call
them for each cue, and :func:`wrap_column` gives them as an Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesmith.functions import words as W

Run = tuple[str | None, int]  # speaker, first word


@dataclass(frozen=True)
class Spec:
    """The knobs of one job."""

    max_chars: int = 32
    max_lines: int = 2
    max_cps: int = 45
    target_cps: int = 27
    min_cps: int = 5
    measure: str = "characters"
    min_display_ms: int = 800
    max_display_ms: int = 7000
    gap_ms: int = 80
    pause_ms: int = 1200
    target_ms: int = 3000
    group_gap_ms: int = 600
    frame_num: int = 25
    frame_den: int = 1
    balanced: bool = True
    clauses: bool = True
    label_mode: str = "dash"
    label_case: str = "uppercase"
    label_format: str = "[{name}:]"
    off_camera_format: str = ""
    label_map: dict[str, str] = field(default_factory=dict, hash=False)
    role_map: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def budget(self) -> int:
        return self.max_chars * self.max_lines


# ------------------------------------------------------------------- scripts

_CJK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in W.CJK_RANGES) + "]")
_SPACE = re.compile(r"\s")


def cjk_count(text: str) -> int:
    """Signs that are not white space."""
    return len(_SPACE.sub("", text or ""))


def is_cjk(text: str) -> bool:
    """Whether three in ten signs or more are of a script without blanks."""
    n = cjk_count(text)
    return n > 0 and 10 * len(_CJK.findall(text)) >= 3 * n


def visible_chars(text: str, measure: str = "characters") -> int:
    text = (text or "").replace("\n", " ").strip()
    if is_cjk(text):
        return cjk_count(text)
    return {"characters_no_spaces": lambda: len(text.replace(" ", "")), "words": lambda: len(text.split())}.get(measure, lambda: len(text))()


# ----------------------------------------------------------- breaks by words

_LEADING, _WEAK = frozenset(W.LEADING.split()), frozenset(W.LEADING.split()) | frozenset(W.DETERMINERS.split())
_FORWARD, _PARTICLES = frozenset(W.FORWARD.split()), frozenset(W.PARTICLES.split())
_TAIL = re.compile(r"[^\w']+$")
#: What each trait of a break is worth, next to one point for each sign of imbalance.
SENTENCE, CLAUSE, LEADS, WEAK_END, SEVERED, NAME_CUT = 32, 28, 15, -25, -12, -18


class Traits(NamedTuple):
    size: int
    close: int  # points for a line that ends here
    leading: bool
    weak: bool  # leading or determiner
    forward: bool
    particle: bool
    name: bool  # capitalised, with lower-case letters, no function word


@lru_cache(1 << 16)
def traits(word: str) -> Traits:
    core = _TAIL.sub("", word).strip()
    low = core.lower()
    close = SENTENCE if word.endswith(W.SENTENCE_SIGNS) else CLAUSE if word.endswith(W.CLAUSE_SIGNS) else 0
    name = core[:1].isupper() and any(map(str.islower, core[1:])) and low not in _WEAK
    return Traits(len(word), close, low in _LEADING, low in _WEAK, low in _FORWARD, low in _PARTICLES, name)


def line_gain(last: Traits, first: Traits, clauses: bool = True) -> int:
    """What a line break between two words is worth."""
    gain = 0
    if clauses:
        gain += last.close + LEADS * first.leading + WEAK_END * last.weak
        gain += SEVERED * (last.forward and not last.weak) + SEVERED * (first.particle and not first.leading)
    return gain + NAME_CUT * (not last.close and last.name and first.name)


def cue_gain(last: Traits, first: Traits) -> int:
    """What a break between two cues is worth."""
    return last.close + LEADS * first.weak + WEAK_END * last.weak


def best_break(words: Sequence[str], limit: int, gain, balanced: bool = True, least: int = 1) -> int | None:
    """The earliest of the best places to cut ``words`` in two parts of at most ``limit`` signs and at least ``least`` words."""
    t = [traits(w) for w in words]
    until = list(accumulate((x.size + 1 for x in t), initial=0))  # signs with a blank after each word
    best = None
    for i in range(least, len(words) - least + 1):
        left, right = until[i] - 1, until[-1] - until[i] - 1
        if max(left, right) <= limit:
            score = gain(t[i - 1], t[i]) - balanced * abs(left - right)
            if best is None or score > best[0]:
                best = (score, i)
    return best and best[1]


def two_lines(text: str, spec: Spec) -> list[str] | None:
    words = text.split()
    at = best_break(words, spec.max_chars, lambda a, b: line_gain(a, b, spec.clauses), spec.balanced) if len(words) > 1 else None
    return at and [" ".join(words[:at]), " ".join(words[at:])]


def fill(words: Iterable[str], limit: int, most: int) -> list[str]:
    """Lines filled from the left; the last one takes what is left, however long."""
    lines: list[list[str]] = [[]]
    for w in words:
        if lines[-1] and len(lines) < most and len(" ".join([*lines[-1], w])) > limit:
            lines.append([])
        lines[-1].append(w)
    return [" ".join(x) for x in lines]


def _cjk_break(s: str, limit: int) -> int:
    """After the last clause sign that fits, else at the limit; signs that may not stand there move."""
    top = min(limit, len(s) - 1)
    if top < 1:
        return max(1, len(s) - 1)
    marks = [i + 1 for i in range(top) if s[i] in W.CJK_CLAUSE_SIGNS or s[i] in W.CJK_SENTENCE_SIGNS]
    at = marks[-1] if marks else top
    forward = re.match(f"[{re.escape(W.NO_LINE_START)}]{{0,8}}", s[at:])
    at += forward.end()
    back = re.search(f"[{re.escape(W.NO_LINE_END)}]{{0,8}}$", s[1:at]) if at > 1 else None
    at -= len(back.group()) if back else 0
    return max(1, min(at, len(s) - 1))


def wrap_cjk(text: str, limit: int, most: int) -> list[str]:
    rest, lines = text.strip(), []
    while cjk_count(text.strip()) > limit and rest and len(lines) < most - 1:
        at = _cjk_break(rest, limit)
        lines += [x for x in [rest[:at].strip()] if x]
        rest = rest[at:].strip()
    return ([*lines, rest] if rest or not lines else lines)[: max(1, most)]


def wrap(text: str, spec: Spec, most: int | None = None) -> list[str]:
    """``text`` in lines: one if it fits, the best two if they fit, else filled from the left."""
    text, most = (text or "").strip(), spec.max_lines if most is None else most
    if is_cjk(text):
        return wrap_cjk(text, spec.max_chars, most)
    if len(text) <= spec.max_chars:
        return [text]
    return (two_lines(text, spec) if most >= 2 else None) or fill(text.split(), spec.max_chars, most)


# -------------------------------------------------------------------- labels


def _mapped(table: dict[str, str], speaker: str) -> str:
    return next((table[k] for k in (speaker, f"aai-{speaker}", speaker.removeprefix("aai-")) if table.get(k)), "")


def speaker_name(speaker: str | None, spec: Spec) -> str:
    """The name that the label mode shows for a speaker id."""
    raw = (speaker or "").strip()
    if not raw:
        return ""
    mapped = _mapped(spec.label_map, raw)
    letter = lambda s: next(filter(str.isalpha, s.upper()), "A")
    digits = "".join(filter(str.isdigit, raw))
    match spec.label_mode:
        case "alpha":
            name = f"SPEAKER {letter(raw)}"
        case "generic":
            name = f"SPEAKER {int(digits) + (digits == '0') if digits else ord(letter(raw)) - 64}"
        case "named" if not mapped:
            name = f"SPEAKER {letter(raw.removeprefix('aai-'))}"
        case "named" | "first_occurrence_per_scene" | "every_change" | "always":
            name = mapped or raw
        case _:
            name = raw
    return {"uppercase": name.upper, "title": name.title}.get(spec.label_case, lambda: name)()


def speaker_tag(speaker: str | None, spec: Spec) -> str:
    name = "" if spec.label_mode in ("none", "dash") else speaker_name(speaker, spec)
    off = _mapped(spec.role_map, (speaker or "").strip()).lower() in ("off_camera", "narrator", "voiceover")
    form = (spec.off_camera_format.strip() if off else "") or spec.label_format.strip()
    return form.replace("{name}", name) if name else ""


def labelled(tag: str, text: str, spec: Spec) -> list[str]:
    """``text`` wrapped behind a tag that is never broken."""
    words = text.split()
    if not tag:
        return wrap(text, spec)
    if len(tag) > spec.max_chars:
        return [tag, *(wrap(text, spec, max(1, spec.max_lines - 1)) if words else [])]
    ends = accumulate((len(w) + 1 for w in words), initial=len(tag))
    fits = sum(n <= spec.max_chars for n in ends) - 1  # words beside the tag
    first, rest = " ".join([tag, *words[:fits]]), " ".join(words[fits:])
    if not rest:
        return [first]
    return [first, *wrap(rest, spec, spec.max_lines - 1)] if spec.max_lines > 1 else [f"{first} {rest}"]


def segments(words: Sequence[str], runs: Sequence[Run]) -> list[tuple[str | None, str]]:
    """(speaker, text) of each run that has words."""
    ends = [start for _, start in runs[1:]] + [len(words)]
    return [(who, " ".join(words[a:b])) for (who, a), b in zip(runs, ends) if words[a:b]] if runs else [(None, " ".join(words))]


def render(text: str, runs: Sequence[Run], spec: Spec) -> list[str]:
    """The lines of a cue: one speaker's wrapped, several speakers' one line each."""
    known = list(dict.fromkeys(who for who, _ in runs if who is not None))
    parts = segments(text.split(), runs)
    if len(known) <= 1 or len(parts) <= 1:
        return labelled(speaker_tag(known[0], spec) if known else "", text, spec)
    label = {"dash": lambda _: "-", "none": lambda _: ""}.get(spec.label_mode, lambda who: speaker_tag(who, spec))
    return [f"{label(who)} {said}".strip() for who, said in parts if said.strip()] or wrap(text, spec)


def fits(text: str, runs: Sequence[Run], spec: Spec) -> bool:
    """Whether the cue as shown, labels included, keeps to lines and signs."""
    return lines_fit(render(text.strip(), runs, spec), spec)


def lines_fit(lines: Sequence[str], spec: Spec) -> bool:
    return len(lines) <= spec.max_lines and all((cjk_count(x) if is_cjk(x) else len(x)) <= spec.max_chars for x in lines)


def wrap_column(text: Column, spec: Spec = Spec()) -> Column:
    """The wrapped lines of a text column (null: one empty line), batch by batch."""

    @F.arrow_udf("array<string>")
    def lines(column: pa.Array) -> pa.Array:
        return pa.array([wrap(x or "", spec) for x in column.to_pylist()], pa.list_(pa.string()))

    return lines(text)

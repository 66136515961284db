"""Cues: packing of sentence groups, and the passes that move, merge and split them.

Each pass is a fold - a step reads cues that the step before has changed - so it
runs over one timeline at a time: timelines are dealt by a hash of their id, sorted,
and streamed; a task holds one timeline's cues, never a partition's.

Cases: groups and cues without times are left out; null text counts as empty; a null
speaker is unknown, such cues are walls and are never merged; an empty table gives
no row; columns other than those named are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cuesmith.functions import words as W
from cuesmith.functions.layout import Run, Spec, best_break, cjk_count, cue_gain, fits, is_cjk, render, visible_chars
from cuesmith.session import ship

GROUP = "timeline_id long, group_id long, speaker string, start_ms long, end_ms long, words array<string>, hard_before boolean"
CUE = "timeline_id long, seq long, start_ms long, end_ms long, type string, text string, runs array<struct<speaker:string,word_start:int>>, review boolean, wall boolean, lines array<string>, timings array<struct<text:string,start_ms:long,end_ms:long>>"


@dataclass(frozen=True)
class Cue:
    start: int
    end: int
    text: str
    runs: tuple[Run, ...] = ()
    type: str = "dialogue"
    review: bool = False
    wall: bool = False  # a pause or an authored boundary stands before it
    lines: tuple[str, ...] = ()
    timings: tuple[tuple[str, int, int], ...] = ()  # words that lie in it as first packed; merges and halves lose them

    @property
    def said(self) -> bool:
        return self.type == "dialogue"

    @property
    def lasts(self) -> int:
        return self.end - self.start

    @property
    def speakers(self) -> frozenset[str]:
        return frozenset(who for who, _ in self.runs if who is not None)

    @property
    def first_speaker(self) -> str | None:
        return next((who for who, _ in self.runs if who is not None), None)

    def shown(self, spec: Spec) -> "Cue":
        return replace(self, lines=tuple(render(self.text, self.runs, spec)))

    def chars(self, spec: Spec) -> int:
        return visible_chars(" ".join(self.lines), spec.measure)

    def cps(self, spec: Spec) -> float:
        return self.chars(spec) / (max(1, self.lasts) / 1000.0)

    def at_speed(self, cps: int, spec: Spec) -> int:
        """Milliseconds it takes at so many signs a second."""
        return int(self.chars(spec) / max(1, cps) * 1000)


# ------------------------------------------------------------------- folding


def fold(df: DataFrame, order: str, schema: str, step: Callable[[list[dict]], Iterable[dict]], **arguments) -> DataFrame:
    """``step`` over the rows of each timeline in turn; its rows are numbered from 1 as ``seq``."""
    spark = ship(df.sparkSession)
    # a stated number: steps are slow for their bytes, so partitions must not be united by size
    rows = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "timeline_id").sortWithinPartitions("timeline_id", order)
    names = [c.split(" ", 1)[0] for c in _columns(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for timeline, mine in groupby(stream, key=lambda r: r["timeline_id"]):
            out += [{"timeline_id": timeline, "seq": k, **r} for k, r in enumerate(step(list(mine), **arguments), 1)]
            if len(out) > 5000:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    types = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


def _columns(schema: str) -> list[str]:
    """The top-level columns of a schema string."""
    out, depth = [""], 0
    for sign in schema:
        depth += (sign in "<(") - (sign in ">)")
        if sign == "," and not depth:
            out.append("")
        else:
            out[-1] += sign
    return [c.strip() for c in out]


def _batch(rows: list[dict], names: list[str], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.field(n).type) for n in names], names)


def read(r: dict) -> Cue:
    runs = tuple((x["speaker"], x["word_start"]) for x in r["runs"] or ())
    return Cue(r["start_ms"], r["end_ms"], r["text"] or "", runs, r["type"] or "dialogue", bool(r["review"]), bool(r["wall"]), tuple(r["lines"] or ()), tuple((x["text"], x["start_ms"], x["end_ms"]) for x in r["timings"] or ()))


def written(c: Cue) -> dict:
    runs = [{"speaker": who, "word_start": at} for who, at in c.runs]
    return {"start_ms": c.start, "end_ms": c.end, "type": c.type, "text": c.text, "runs": runs, "review": c.review, "wall": c.wall, "lines": list(c.lines), "timings": [{"text": t, "start_ms": a, "end_ms": b} for t, a, b in c.timings]}


def each(cues: DataFrame, change: Callable[[list[Cue], Spec], Iterable[Cue]], spec: Spec = Spec()) -> DataFrame:
    """A pass over the cues of each timeline."""
    wanted = cues.select(*[c.split(" ", 1)[0] for c in _columns(CUE)]).where("start_ms is not null and end_ms is not null")
    return fold(wanted, "seq", CUE, lambda rows: map(written, change([read(r) for r in rows], spec)))


# ------------------------------------------------------------------- packing


def _joined(words: list[str]) -> str:
    return ("" if len(words) > 1 and is_cjk(" ".join(words)) else " ").join(words)


def _length(words: list[str]) -> int:
    text = _joined(words)
    return cjk_count(text) if is_cjk(text) else len(text)


def chunks(words: list[str], spec: Spec) -> list[list[str]]:
    """A sentence over the budget in parts: two balanced ones, else filled from the left with a step
    back to the last clause end that leaves three words."""
    whole = len(" ".join(words))
    at = best_break(words, spec.budget, cue_gain, least=3) if spec.budget < whole <= 2 * spec.budget and len(words) >= 4 else None
    if at:
        return [words[:at], words[at:]]
    out: list[list[str]] = [[]]
    for w in words:
        if out[-1] and len(" ".join([*out[-1], w])) > spec.budget:
            ends = [k for k, x in enumerate(out[-1][:-1], 1) if k >= 3 and x.endswith(W.SENTENCE_SIGNS + W.CLAUSE_SIGNS)]
            if out[-1][-1].endswith(W.SENTENCE_SIGNS + W.CLAUSE_SIGNS) and len(out[-1]) >= 3:
                ends = []  # it ends on one already
            keep = ends[-1] if ends else len(out[-1])
            out[-1:] = [out[-1][:keep], out[-1][keep:]]
        out[-1].append(w)
    if len(out) > 1 and len(out[-1]) == 1 < len(out[-2]):
        out[-1].insert(0, out[-2].pop())
    return out


def cjk_chunks(text: str, spec: Spec) -> list[str]:
    rest, out = text.strip(), []
    while cjk_count(rest) > spec.budget:
        marks = [i for i, sign in enumerate(rest[: spec.budget], 1) if sign in W.CJK_CLAUSE_SIGNS or sign in W.CJK_SENTENCE_SIGNS]
        at = marks[-1] if marks else spec.budget
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [x for x in [*out, rest] if x]


def _spread(start: int, end: int, weights: list[int]) -> Iterator[tuple[int, int]]:
    """Times of parts in proportion to their weights, each at least 1 ms long."""
    span, total, done = end - start, sum(weights) or 1, 0
    for w in weights:
        a, done = start + span * done // total, done + w
        yield a, max(start + span * done // total, a + 1)


def pack_groups(groups: list[dict], spec: Spec = Spec()) -> Iterator[Cue]:
    """Cues of a timeline's sentence groups: short ones of one speaker share a cue as long as
    they fit its lines; walls, other speakers and unknown ones open a new cue; one over the
    budget is cut, with a short lead of the same speaker taken in."""
    held: list[dict] = []

    def close() -> Iterator[Cue]:
        if held:
            first, text = held[0], _joined([w for g in held for w in g["words"]])
            known = first["speaker"] is not None
            yield Cue(first["start_ms"], held[-1]["end_ms"], text, ((first["speaker"], 0),), review=not known, wall=bool(first["hard_before"])).shown(spec)
            held.clear()

    for g in groups:
        if g["start_ms"] is None:
            yield from close()
            continue
        words, who = g["words"], g["speaker"]
        before = [w for x in held for w in x["words"]]
        together = held and who is not None and held[0]["speaker"] == who and not g["hard_before"]
        if _length(words) > spec.budget:
            cjk = is_cjk(" ".join(words))
            start = g["start_ms"]
            if together and not cjk and len(" ".join(before)) <= spec.max_chars:
                words, start = before + words, held[0]["start_ms"]
                held.clear()
            yield from close()
            parts = cjk_chunks(_joined(words), spec) if cjk else [" ".join(c) for c in chunks(words, spec)]
            weights = [cjk_count(p) if cjk else len(p.split(" ")) for p in parts]
            for text, (a, b) in zip(parts, _spread(start, max(g["end_ms"], start + 1), weights)):
                yield Cue(a, b, text, ((who, 0),)).shown(spec)
            continue
        if not together or _length(before + words) > spec.budget:
            yield from close()
        held.append(g)
    yield from close()


def pack(groups: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Cues (``CUE``) of sentence groups (``GROUP``)."""
    wanted = groups.select(*[c.split(" ", 1)[0] for c in _columns(GROUP)])
    return fold(wanted, "group_id", CUE, lambda rows: map(written, pack_groups(rows, spec)))


# ------------------------------------------------------------ merges, walls


def mergeable(a: Cue, b: Cue) -> bool:
    """One known speaker, the same in both, and no wall between them."""
    return not (b.wall or a.review or b.review) and a.speakers == b.speakers and len(a.speakers) == 1


def boundary_reason(a: Cue, b: Cue, pause: bool = True) -> str | None:
    if b.wall:
        return "pause_boundary" if pause else "authored_hard_boundary"
    if a.review or b.review:
        return "unknown_speaker"
    return None if mergeable(a, b) else "speaker_change"


def merged(a: Cue, b: Cue, spec: Spec) -> Cue:
    """Both texts and speaker runs in one cue; walls and flags do not come along."""
    runs, shift = list(a.runs or ((None, 0),)), len(a.text.split())
    for who, at in b.runs or ((None, 0),):
        if who != runs[-1][0]:
            runs.append((who, at + shift))
    return Cue(min(a.start, b.start), b.end, f"{a.text} {b.text}".strip(), tuple(runs), a.type).shown(spec)


def is_orphan(c: Cue) -> bool:
    """A single word that is no brief response."""
    words = " ".join(c.lines).strip().removeprefix("- ").split()
    return c.said and len(words) == 1 and words[0].rstrip(".!?\"')]}").lower() not in W.BRIEF_RESPONSES.split()


def reflow_orphans(cues: list[Cue], spec: Spec) -> list[Cue]:
    """Orphans join the cue before, or else the one after, where the whole fits."""
    out: list[Cue] = []
    rest = list(reversed(cues))
    while rest:
        c = rest.pop()
        if is_orphan(c):
            for other, pair in ((out, lambda o: (o, c)), (rest, lambda o: (c, o))):
                if other and other[-1].said and mergeable(*pair(other[-1])):
                    whole = merged(*pair(other[-1]), spec)
                    if fits(whole.text, whole.runs, spec):
                        other[-1] = whole
                        break
            else:
                out.append(c)
        else:
            out.append(c)
    return out


def _pairwise(cues: list[Cue], join: Callable[[Cue, Cue], Cue | None]) -> Iterator[Cue]:
    """From left to right: two neighbours that ``join`` takes become one, which is not joined again."""
    k = 0
    while k < len(cues):
        one = join(cues[k], cues[k + 1]) if k + 1 < len(cues) else None
        yield one or cues[k]
        k += 2 if one else 1


def group_two_speakers(cues: list[Cue], spec: Spec) -> Iterator[Cue]:
    """Two short cues of different speakers in quick turn become one of two lines."""
    brief = max(1800, 2 * spec.min_display_ms)

    def join(a: Cue, b: Cue) -> Cue | None:
        if not (a.said and b.said and len(a.speakers) == len(b.speakers) == 1 and a.speakers != b.speakers) or b.wall or a.review or b.review:
            return None
        if not (0 <= b.start - a.end <= spec.group_gap_ms and max(a.lasts, b.lasts) <= brief):
            return None
        one = merged(a, b, spec)
        good = len(one.lines) == 2 and spec.min_display_ms <= one.lasts <= spec.max_display_ms
        return one if good and fits(one.text, one.runs, spec) and one.cps(spec) <= spec.max_cps else None

    return _pairwise(cues, join) if spec.max_lines >= 2 else iter(cues)


def merge_micro(cues: list[Cue], spec: Spec) -> Iterator[Cue]:
    """A cue that is shown too briefly joins the next one, if that helps and breaks no limit."""

    def join(a: Cue, b: Cue) -> Cue | None:
        if not (a.said and b.said and a.lasts < spec.min_display_ms and b.start - a.end <= spec.group_gap_ms):
            return None
        walled = b.wall or a.review or b.review
        if not mergeable(a, b) and (walled or spec.max_lines < 2 or spec.label_mode == "dash"):
            return None
        one = merged(a, b, spec)
        good = spec.min_display_ms <= one.lasts <= spec.max_display_ms and one.cps(spec) <= max(a.cps(spec), b.cps(spec)) + 0.01
        return one if good and fits(one.text, one.runs, spec) else None

    return _pairwise(cues, join)


# -------------------------------------------------------------- reading speed


def donate(cues: list[Cue], spec: Spec) -> list[Cue]:
    """Cues above the speed limit take time from slow neighbours of the same speaker: the next
    one starts later, then the one before ends earlier."""
    out = list(cues)
    keeps = lambda c: max(c.at_speed(spec.target_cps, spec), spec.min_display_ms)
    for k in range(len(out)):
        fast = lambda: out[k].said and out[k].cps(spec) > spec.max_cps  # noqa: E731, B023
        if fast() and k + 1 < len(out) and out[k + 1].said and mergeable(out[k], out[k + 1]):
            c, giver = out[k], out[k + 1]
            end = min(c.start + c.at_speed(spec.target_cps, spec), giver.end - keeps(giver) - spec.gap_ms)
            if end > c.end and end - c.start >= spec.min_display_ms:
                out[k], out[k + 1] = replace(c, end=end), replace(giver, start=end + spec.gap_ms)
        if fast() and k and out[k - 1].said and mergeable(out[k - 1], out[k]):
            c, giver = out[k], out[k - 1]
            start = max(c.end - c.at_speed(spec.target_cps, spec), giver.start + keeps(giver) + spec.gap_ms)
            if start < c.start and c.end - start >= spec.min_display_ms <= start - spec.gap_ms - giver.start:
                out[k], out[k - 1] = replace(c, start=start), replace(giver, end=start - spec.gap_ms)
    return out


def open_delimiter(text: str) -> bool:
    """Whether a quote or bracket is still open at the end: quotes by parity, pairs by nesting."""
    closers, stack = {b: a for a, b in W.PAIRS.items()}, []
    for sign in text:
        if sign in W.PAIRS:
            stack.append(sign)
        elif sign in closers and stack[-1:] == [closers[sign]]:
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1


def middle_cut(units: list[str] | str, marks: tuple[str, ...], least: int) -> int:
    """The place after a mark that is nearest to the middle, leaves ``least`` units on both sides
    and no delimiter open; else the middle."""
    n, words = len(units), not isinstance(units, str)
    good = [k for k in range(max(1, least), n - max(1, least) + 1) if units[k - 1].endswith(marks) and not (words and open_delimiter(" ".join(units[:k])))]
    return min(good, key=lambda k: (abs(k - n // 2), k), default=max(1, n // 2))


def _halves(c: Cue, spec: Spec) -> list[Cue] | None:
    """An overlong cue in two, cut near its middle, or nothing if one would be too brief."""
    cjk = is_cjk(c.text)
    if cjk:
        at = middle_cut(c.text, W.CJK_CLAUSE_SIGNS + W.CJK_SENTENCE_SIGNS, 1)
        left, right, share, whole = c.text[:at].strip(), c.text[at:].strip(), len(c.text[:at].strip()), len(c.text)
    else:
        words = c.text.split()
        at = middle_cut(words, W.CLAUSE_SIGNS + W.SENTENCE_SIGNS, 3)
        left, right, share, whole = " ".join(words[:at]), " ".join(words[at:]), at, len(words)
    if not left or not right:
        return None
    cut = c.start + max(2, c.lasts) * share // whole
    end, start = min(cut - spec.gap_ms // 2, c.end - spec.min_display_ms), max(cut + spec.gap_ms // 2, c.start + spec.min_display_ms)
    if min(end - c.start, c.end - start) < spec.min_display_ms:
        return None
    runs = ((c.runs[0][0] if c.runs else None, 0),)
    return [Cue(c.start, end, left, runs, review=c.review, wall=c.wall).shown(spec), Cue(start, c.end, right, runs, review=c.review).shown(spec)]


def split_long(cues: list[Cue], spec: Spec, passes: int = 8) -> Iterator[Cue]:
    """Cues shown for too long are halved, and their halves, up to eight times."""
    for c in cues:
        two = _halves(c, spec) if passes and c.said and c.lasts > spec.max_display_ms else None
        yield from split_long(two, spec, passes - 1) if two else [c]


def absorb_slivers(cues: list[Cue], spec: Spec) -> list[Cue]:
    """Cues shown too briefly last longer where there is room, else join the next or the last one."""
    out: list[Cue] = []
    rest = list(reversed(cues))

    def join(a: Cue, b: Cue, of: Cue) -> Cue | None:
        if not (a.said and b.said and mergeable(a, b) and b.end - a.start <= spec.max_display_ms):
            return None
        text = f"{a.text.strip()}{'' if is_cjk(of.text.strip()) else ' '}{b.text.strip()}".strip()
        runs = ((a.runs[0][0] if a.runs else None, 0),)
        return Cue(a.start, b.end, text, runs).shown(spec) if fits(text, runs, spec) else None

    while rest:
        c = rest.pop()
        if not c.said or max(1, c.lasts) >= spec.min_display_ms:
            out.append(c)
            continue
        room = min(c.start + spec.max_display_ms, rest[-1].start - spec.gap_ms if rest else c.start + spec.max_display_ms)
        if c.start + spec.min_display_ms <= room:
            out.append(replace(c, end=max(c.end, c.start + spec.min_display_ms)))
        elif rest and (one := join(c, rest[-1], c)):
            rest.pop()
            out.append(one)
        elif out and (one := join(out[-1], c, c)):
            out[-1] = one
        else:
            out.append(c)
    return out


def extend_fast(cues: list[Cue], spec: Spec) -> Iterator[Cue]:
    for c, after in zip(cues, [*cues[1:], None]):
        if c.said and c.cps(spec) > spec.max_cps:
            end = c.start + min(c.at_speed(spec.target_cps, spec), spec.max_display_ms)
            c = replace(c, end=max(c.end, min(end, after.start - spec.gap_ms) if after else end))
        yield c


def trim_slow(cues: list[Cue], spec: Spec) -> Iterator[Cue]:
    for c in cues:
        if c.said and c.cps(spec) < spec.min_cps and c.chars(spec):
            c = replace(c, end=min(c.end, c.start + max(c.at_speed(spec.target_cps, spec), spec.min_display_ms)))
        yield c


def least_duration(cues: list[Cue], spec: Spec) -> Iterator[Cue]:
    for c, after in zip(cues, [*cues[1:], None]):
        need = spec.min_display_ms - c.lasts
        yield replace(c, end=c.end + need) if need > 0 and after and after.start - c.end >= need else c


def speed_rules(cues: list[Cue], spec: Spec) -> list[Cue]:
    for change in (split_long, extend_fast, donate, absorb_slivers, trim_slow):
        cues = list(change(cues, spec))
    return cues


def readability(cues: list[Cue], spec: Spec) -> list[Cue]:
    for change in (reflow_orphans, group_two_speakers, least_duration, merge_micro, speed_rules):
        cues = list(change(cues, spec))
    return cues


# ----------------------------------------------------------------- frame grid


def frame_of(ms: int, spec: Spec, mode: str = "nearest") -> int:
    top, below = ms * spec.frame_num, 1000 * spec.frame_den
    return {"floor": top // below, "ceil": -(-top // below)}.get(mode, (2 * top + below) // (2 * below))


def ms_of(frame: int, spec: Spec) -> int:
    return (2 * frame * 1000 * spec.frame_den + spec.frame_num) // (2 * spec.frame_num)


def to_grid(cues: list[Cue], spec: Spec) -> list[Cue]:
    """Cues on whole frames, in order and with the least gap between dialogue cues, as near to
    their times as that allows: isotonic regression of the starts less what must precede them,
    in half frames so that means stay exact, and no start before its measured one."""
    gap = frame_of(spec.gap_ms, spec)
    first, size = [], []
    for c in cues:
        a, b = frame_of(c.start, spec), frame_of(c.end, spec)
        size.append(max(1, b - a))
        first.append(a + b - size[-1])  # twice the start that keeps the middle
    space = [n + gap * (a.said and b.said) for n, a, b in zip(size, cues, cues[1:])]
    before = [0]
    for n in space:
        before.append(before[-1] + n)
    blocks: list[tuple[int, int]] = []  # sum of twice the wish, cues
    for wish, shift in zip(first, before):
        blocks.append((wish - 2 * shift, 1))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            (s, n), (t, m) = blocks[-2:]
            blocks[-2:] = [(s + t, n + m)]
    starts = [x for s, n in blocks for x in [((abs(s) + n) // (2 * n)) * (1 if s >= 0 else -1)] * n]
    starts = [x + shift for x, shift in zip(starts, before)]
    late = -min(0, starts[0]) if starts else 0
    out, free = [], None
    for k, c in enumerate(cues):
        at = max(starts[k] + late, frame_of(c.start, spec, "ceil"), free if free is not None else 0)
        free = at + (space[k] if k < len(space) else size[k])
        out.append(replace(c, start=ms_of(at, spec), end=ms_of(at + size[k], spec)))
    return out

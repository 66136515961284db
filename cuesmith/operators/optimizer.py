"""Sequence optimizer: a run of one speaker's cues is cut anew where that reads better.

A run between walls (:func:`runs`) is one stream of words with times. Candidates are
the cuts it has, none, one or two clean ones, and the best complete path over all
clean places (:func:`best_path`, a shortest-path recurrence over cut points). What
breaks a limit is vetoed, the rest is scored, and the best arrangement replaces the
run's cues; text is never changed. Each run is decided on its own.

Cases: runs in scripts without blanks, and runs without a candidate that keeps all
limits, stay as they are; cues that are no dialogue stay; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import accumulate, combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.functions import words as W
from cuesmith.functions.layout import Spec, is_cjk, lines_fit, render, traits
from cuesmith.functions.text import canonical
from cuesmith.operators.cues import CUE, Cue, fold, open_delimiter, read, _columns

# ---- fixed values
OPTIMIZER_VERSION, POLICY_VERSION = 2, 2
DANGLING = frozenset("so and but or nor for yet because since while although though if when as that then well".split())
MOST_SINGLES, MOST_WORDS = 24, 200
# ----


def digest(value) -> str:
    """Versioned digest of the canonical JSON of plain values."""
    return hashlib.sha256(("cchash/v1\n" + canonical(json.dumps(value))).encode()).hexdigest()


@dataclass(frozen=True)
class Stream:
    """The words of a run with their times and whether those were measured."""

    cues: tuple[Cue, ...]

    @cached_property
    def words(self) -> list[str]:
        return [w for c in self.cues for w in c.text.split()]

    @cached_property
    def times(self) -> list[tuple[int, int, bool]]:
        out = []
        for c in self.cues:
            words = c.text.split()
            if words and len(c.timings) == len(words):
                out += [(a, b, True) for _, a, b in c.timings]
                continue
            span, size = max(1, c.lasts), [len(w) for w in words]
            edge = [c.start + span * n // (sum(size) or 1) for n in accumulate(size, initial=0)]
            out += [(a, max(b, a + 1), False) for a, b in zip(edge, edge[1:])]
        return out

    @cached_property
    def own_cuts(self) -> tuple[int, ...]:
        ends = accumulate(len(c.text.split()) for c in self.cues[:-1])
        return tuple(k for k in ends if 0 < k < len(self.words))

    @cached_property
    def _upto(self) -> list[int]:
        return list(accumulate((len(w) + 1 for w in self.words), initial=0))

    def length(self, a: int, b: int) -> int:
        """Signs of the words from ``a`` to before ``b``."""
        return self._upto[b] - self._upto[a] - 1

    @property
    def speaker(self) -> str | None:
        return self.cues[0].first_speaker

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Times of the words from ``a`` to before ``b``; the run's own at its ends."""
        return self.cues[0].start if a == 0 else self.times[a][0], self.cues[-1].end if b == len(self.words) else self.times[b - 1][1]

    @cached_property
    def loose(self) -> bool:
        """Whether its own cuts break quotes or brackets already."""
        return any(open_delimiter(" ".join(self.words[:k])) for k in self.own_cuts)

    def clean(self, k: int) -> bool:
        return not traits(self.words[k]).weak and (self.loose or not open_delimiter(" ".join(self.words[:k])))


# ------------------------------------------------------------------ candidates


def attempt(s: Stream, cuts: tuple[int, ...], spec: Spec, deferred: bool = False) -> tuple[list[Cue], str | None]:
    """The cues of an arrangement, the least gap between them, or the first limit it breaks. Times
    and lengths are looked at before a part is laid out, and no part after the first that fails."""
    edges, spans, end = [0, *cuts, len(s.words)], [], None
    for a, b in zip(edges, edges[1:]):
        start, until = s.span(a, b) if a < b else (0, 0)
        start, end = (start if end is None else max(start, end + spec.gap_ms)), until
        if end <= start:
            return [], "EMPTY_CANDIDATE"
        spans.append((a, b, start, end))
    out, runs = [], ((s.speaker, 0),)
    for a, b, start, end in spans:
        broken = _limits(end - start, "", spec, deferred)
        if broken or s.length(a, b) >= spec.budget + spec.max_lines:
            return [], broken or "LINE_OR_CPL_FAIL"
        timings = tuple((w, x, y) for w, (x, y, _) in zip(s.words[a:b], s.times[a:b]))
        c = Cue(start, end, " ".join(s.words[a:b]), runs, timings=timings).shown(spec)
        broken = _limits(c.lasts, _body(c), spec, deferred) if lines_fit(c.lines, spec) else "LINE_OR_CPL_FAIL"
        if broken:
            return [], broken
        out.append(c)
    return (out, None) if out else ([], "EMPTY_CANDIDATE")


def _limits(lasts: int, text: str, spec: Spec, deferred: bool) -> str | None:
    if lasts < spec.min_display_ms and not deferred:
        return "DURATION_BELOW_MIN"
    if lasts > spec.max_display_ms:
        return "DURATION_ABOVE_MAX"
    return "CPS_OVER_MAX" if len(text) / max(0.001, lasts / 1000.0) > spec.max_cps and not deferred else None


def _body(c: Cue) -> str:
    return " ".join(c.lines).strip() or c.text


def cut_sets(s: Stream) -> list[tuple[str, tuple[int, ...]]]:
    """(operation, cuts): as it is, all in one, one clean cut, two clean cuts three words apart."""
    out, n = [("no_change", s.own_cuts)], len(s.words)
    if s.own_cuts:
        out.append(("merge_all", ()))
    singles = [k for k in range(3, n - 2) if s.clean(k)] if n >= 4 else []
    if len(singles) > MOST_SINGLES:
        last = MOST_SINGLES - 1
        singles = [singles[k] for k in sorted({round(i * (len(singles) - 1) / last) for i in range(MOST_SINGLES)})]
    return out + [("resegment_2", (k,)) for k in singles] + [("resegment_3", p) for p in combinations(singles, 2) if p[1] - p[0] >= 3]


def best_path(s: Stream, spec: Spec, as_shown: bool, deferred: bool = False) -> tuple[tuple[int, ...] | None, list[str]]:
    """The cuts of the best way through all clean places, and the limits met on the way. Edges are
    scored by how far they are from the target time and by how they end; ties go to fewer, then
    earlier cuts."""
    n, target = len(s.words), max(spec.target_ms, 2 * spec.min_display_ms)
    places = [0, *(k for k in range(1, n) if s.clean(k)), n]
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    met: dict[str, None] = {}
    for here, i in enumerate(places[:-1]):
        if i not in best:
            continue
        for j in places[here + 1 :]:
            if s.length(i, j) > spec.budget and j > i + 1:
                break
            text = " ".join(s.words[i:j])
            start, end = s.span(i, j)
            lines = render(text, ((s.speaker, 0),), spec) if as_shown else [text]
            wide = len(lines) > spec.max_lines or max(map(len, lines)) > spec.max_chars if as_shown else len(text) > spec.budget
            broken = _limits(end - start, " ".join(lines), spec, deferred)
            broken = "LINE_OR_CPL_FAIL" if wide and broken in (None, "CPS_OVER_MAX") else broken
            if broken:
                met[broken] = None
                continue
            gain = -abs(end - start - target) / 1000.0 * 1.5 - 2.0
            if j < n:
                last = traits(s.words[j - 1])
                gain += _ending(last.close) - 16.0 * (last.weak or _plain(s.words[j - 1]) in DANGLING)
            score, cuts = best[i][0] + gain, best[i][1] + ((j,) if j < n else ())
            old = best.get(j)
            if old is None or score > old[0] + 1e-9 or (abs(score - old[0]) < 1e-9 and (len(cuts), cuts) < (len(old[1]), old[1])):
                best[j] = score, cuts
    return best[n][1] if n in best and n else None, list(met)


def _plain(word: str) -> str:
    return word.rstrip("".join(W.SENTENCE_SIGNS + W.CLAUSE_SIGNS) + "\"'()[]").lower()


def _ending(close: int) -> float:
    """What the end of a cue is worth: a sentence, a clause, or the middle of a phrase."""
    return 14.0 if close == 32 else 8.0 if close else -8.0


def score(parts: list[Cue], op: str, spec: Spec) -> float:
    """Phrase ends, rhythm, speed and evenness of an arrangement."""
    target = max(spec.target_ms, 2 * spec.min_display_ms)
    ceiling, flash = int(target * 1.5), min(1200, int(spec.min_display_ms * 1.4))
    total = 5.0 * (op == "no_change") - 2.0 * (len(parts) - 1)
    for a, b in zip(parts, parts[1:]):
        last, first = a.text.split()[-1], b.text.split()[0]
        total += _ending(traits(last).close) - 16.0 * (_plain(last) in DANGLING) - 10.0 * (_plain(first) in DANGLING)
    for p in parts:
        total -= abs(p.lasts - target) / 1000.0 * 1.5 + 20.0 * (p.lasts < flash)
        total -= 15.0 + (p.lasts - ceiling) / 1000.0 * 6.0 if p.lasts > ceiling else 0.0
    size, lasts = [len(_body(p)) for p in parts], [p.lasts for p in parts]
    speed = [n / max(0.001, ms / 1000.0) for n, ms in zip(size, lasts)]
    total -= max(0.0, max(speed) - spec.target_cps) * 1.2
    if len(parts) > 1:
        total -= (max(speed) - min(speed)) * 0.4 + (max(lasts) - min(lasts)) / 1000.0 * 0.8 + (max(size) / max(1, min(size)) - 1.0) * 5.0
    return total


# -------------------------------------------------------------------- decisions


@dataclass(frozen=True)
class Decision:
    stream: Stream
    op: str
    cuts: tuple[int, ...]
    parts: tuple[Cue, ...]
    candidates: tuple[tuple[str, tuple[int, ...]], ...] = ()
    rejected: tuple[str, ...] = ()
    reasons: tuple[str, ...] = ()
    passthrough: str | None = None

    def provenance(self) -> tuple[str, int, int]:
        """How the boundaries are known: kind, measured, interpolated."""
        if self.op == "no_change" or not self.cuts:
            return "inherited", 0, 0
        measured = sum(self.stream.times[k][2] for k in self.cuts)
        other = len(self.cuts) - measured
        return "mixed" if measured and other else "measured" if measured else "interpolated", measured, other

    def moved_words(self) -> int:
        owner = lambda cues: [k for k, c in enumerate(cues) for _ in c.text.split()]
        old, new = owner(self.stream.cues), owner(self.parts)
        return len(old) if len(old) != len(new) else sum(a != b for a, b in zip(old, new))

    def hashes(self, number: int, run_id: str = "") -> tuple[str, str, str, str]:
        """Digests of input, candidates and output, and the key of the decision."""
        source = digest({"kind": "seg_input", "words": self.stream.words, "boundaries": [c.start for c in self.stream.cues]})
        options = digest({"kind": "seg_candidates", "candidates": [[op, list(cuts)] for op, cuts in self.candidates]})
        output = digest({"kind": "seg_output", "parts": [[p.start, p.end, p.text] for p in self.parts]})
        key = digest({
            "kind": "seg_decision_key", "format_run_id": run_id, "transformation_sequence": number, "optimizer_version": OPTIMIZER_VERSION, "segmentation_policy_version": POLICY_VERSION,
            "input_hash": source, "candidate_set_hash": options, "operation": "passthrough" if self.passthrough else self.op, "selected_cuts": list(self.cuts),
        })
        return source, options, output, key


def decide(s: Stream, spec: Spec, deferred: bool = False) -> Decision:
    """The arrangement of a run."""
    if is_cjk(" ".join(s.words)):
        return Decision(s, "no_change", (), s.cues, passthrough="cjk_window_deferred")
    options = cut_sets(s) if len(s.words) <= MOST_WORDS else []
    path, met = best_path(s, spec, False, deferred)
    if path is not None and attempt(s, path, spec, deferred)[1] in ("LINE_OR_CPL_FAIL", "CPS_OVER_MAX"):
        shown, met_shown = best_path(s, spec, True, deferred)
        path, met = (shown, met_shown) if shown is not None else (path, met)
    if path is not None and path not in [cuts for _, cuts in options]:
        options.append(("resegment_2" if len(path) == 1 else "resegment_3", path))
    tried = [(op, cuts, *attempt(s, cuts, spec, deferred)) for op, cuts in options]
    rejected = tuple(dict.fromkeys([v for *_, v in tried if v] + (met if path is not None else [])))
    ranked = sorted(((-score(parts, op, spec), len(parts), cuts, op != "no_change", op, parts) for op, cuts, parts, v in tried if v is None), key=lambda x: x[:4])
    if not ranked:
        return Decision(s, "no_change", (), s.cues, tuple(options), rejected, passthrough="no_compliant_candidate")
    top, _, cuts, _, op, parts = ranked[0]
    reasons = ["only_compliant"] if len(ranked) == 1 else ["highest_score"]
    if sum(abs(r[0] - top) < 1e-9 for r in ranked) > 1:
        reasons += ["tie_fewest_parts", "tie_earliest_cuts"]
    reasons.append({"no_change": "stability_preferred", "merge_all": "merged_reads_best"}.get(op, "resegmented_for_rhythm"))
    if len(parts) > 3:
        reasons.append("variable_length_complete_path")
    parts[0] = replace(parts[0], wall=s.cues[0].wall)
    return Decision(s, op, cuts, tuple(parts), tuple(options), rejected, tuple(reasons))


# ------------------------------------------------------------------------- runs


def runs(cues: list[Cue]) -> list[tuple[int, int]]:
    """Maximal runs of dialogue of one first speaker with no wall inside, half open."""
    out: list[tuple[int, int]] = []
    for k, c in enumerate(cues):
        if not c.said:
            continue
        before = cues[k - 1] if k else None
        joins = before is not None and before.said and before.first_speaker == c.first_speaker and not (c.wall or c.review)
        if joins and out:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


def failing_runs(cues: list[Cue], spec: Spec, around: int = 2) -> list[tuple[int, int]]:
    """Cues whose lines do not keep the limits, with two neighbours of their run on both sides, united within it."""
    out: list[tuple[int, int]] = []
    for a, b in runs(cues):
        mine: list[tuple[int, int]] = []
        for k in range(a, b):
            if len(cues[k].lines) > spec.max_lines or any(len(x) > spec.max_chars for x in cues[k].lines):
                span = max(a, k - around), min(b, k + around + 1)
                if mine and span[0] <= mine[-1][1]:
                    span = mine.pop()[0], span[1]  # spans of a run end in order
                mine.append(span)
        out += mine
    return out


def decisions(cues: list[Cue], spec: Spec, repair_only: bool = False, deferred: bool = False) -> Iterator[Cue | Decision]:
    """Cues that are in no run, and the decision on each run, in order."""
    at = 0
    for a, b in failing_runs(cues, spec) if repair_only else runs(cues):
        yield from cues[at:a]
        yield decide(Stream(tuple(cues[a:b])), spec, deferred)
        at = b
    yield from cues[at:]


def optimize(cues: list[Cue], spec: Spec, repair_only: bool = False, deferred: bool = False) -> Iterator[Cue]:
    for x in decisions(cues, spec, repair_only, deferred):
        yield from x.parts if isinstance(x, Decision) else [x]


DECISION = (
    "timeline_id long, seq long, operation string, cuts array<int>, source_cue_count int, result_cue_count int, candidate_count int, moved_word_count int, speaker string, reason_codes array<string>, "
    "rejected_reason_categories array<string>, passthrough_reason string, condensation_allowed boolean, timing_provenance string, measured_boundary_count int, interpolated_boundary_count int, "
    "original_boundaries_ms array<long>, original_text string, input_hash string, candidate_set_hash string, output_hash string, decision_key string"
)


def _row(d: Decision, number: int) -> dict:
    kind, measured, other = d.provenance()
    source, options, output, key = d.hashes(number)
    return {
        "operation": d.op, "cuts": list(d.cuts), "source_cue_count": len(d.stream.cues), "result_cue_count": len(d.parts), "candidate_count": len(d.candidates),
        "moved_word_count": d.moved_words() if d.op != "no_change" else 0, "speaker": d.stream.speaker, "reason_codes": list(d.reasons)[:12], "rejected_reason_categories": list(d.rejected)[:12],
        "passthrough_reason": d.passthrough, "condensation_allowed": d.passthrough == "no_compliant_candidate", "timing_provenance": kind, "measured_boundary_count": measured, "interpolated_boundary_count": other,
        "original_boundaries_ms": [c.start for c in d.stream.cues][:10], "original_text": " ".join(d.stream.words)[:2000], "input_hash": source, "candidate_set_hash": options, "output_hash": output, "decision_key": key,
    }


def decision_table(cues: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """A row for each run of each timeline: what was chosen, why, and its digests."""

    def step(rows):
        made = [x for x in decisions([read(r) for r in rows], spec) if isinstance(x, Decision)]
        return [_row(d, k) for k, d in enumerate(made)]

    wanted = cues.select(*[c.split(" ", 1)[0] for c in _columns(CUE)]).where("start_ms is not null and end_ms is not null")
    return fold(wanted, "seq", DECISION, step)


def key_summary(decided: DataFrame) -> DataFrame:
    """By timeline: decisions, distinct keys and operations, and whether all keys differ."""
    s = decided.groupBy("timeline_id").agg(F.count("*").alias("n_decisions"), F.countDistinct("decision_key").alias("n_keys"), F.array_sort(F.collect_set("operation")).alias("operations"))
    return s.withColumn("unique", F.col("n_decisions") == F.col("n_keys"))

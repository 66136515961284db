"""Optimizer, chain, hashes: brute force on small runs, frozen digests, what must hold."""

import random
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import text as T
from cuesmith.functions.layout import Spec, fits
from cuesmith.operators import chain, identity
from cuesmith.operators import optimizer as O
from cuesmith.operators import windows
from cuesmith.operators.cues import Cue
from cuesmith.session import ship

SPEC = Spec()
VOCABULARY = "we the river went down and it was late so they stayed at home, then left. again (all of them) but".split()


def run(seed, n=8, measured=True, **more):
    rng, out, at = random.Random(seed), [], 0
    for _ in range(rng.randrange(1, 4)):
        words = rng.choices(VOCABULARY, k=rng.randrange(2, n))
        times, start = [], at
        for w in words:
            times.append((w, at, at + 200 + rng.randrange(300)))
            at = times[-1][2] + 20
        out.append(Cue(start, times[-1][2], " ".join(words), (("A", 0),), timings=tuple(times) if measured else (), **more).shown(SPEC))
        at += 100
    return out


def path_score(s, cuts, spec):
    edges, total = [0, *cuts, len(s.words)], 0.0
    target = max(spec.target_ms, 2 * spec.min_display_ms)
    for i, j in zip(edges, edges[1:]):
        start, end = s.span(i, j)
        text = " ".join(s.words[i:j])
        if len(text) > spec.budget or O._limits(end - start, text, spec, False):
            return None
        total += -abs(end - start - target) / 1000.0 * 1.5 - 2.0
        if j < len(s.words):
            last = s.words[j - 1]
            total += 14 if last.endswith(".") else 8 if last.endswith(",") else -8
            total -= 16 if last.strip(".,()") in O.DANGLING or O.traits(last).weak else 0
    return total


@pytest.mark.parametrize("seed", range(25))
def test_best_path_equals_brute_force(seed):
    s = O.Stream(tuple(run(seed, 6)))
    places = [k for k in range(1, len(s.words)) if s.clean(k)]
    scored = [(path_score(s, c, SPEC), c) for n in range(len(places) + 1) for c in combinations(places, n)]
    scored = [(x, c) for x, c in scored if x is not None]
    cuts, _ = O.best_path(s, SPEC, False)
    if not scored:
        assert cuts is None
    else:
        top = max(x for x, _ in scored)
        assert cuts == min((c for x, c in scored if abs(x - top) < 1e-9), key=lambda c: (len(c), c))


@pytest.mark.parametrize("seed", range(40))
def test_decisions_keep_text_and_limits(seed):
    cues = run(seed, 14, measured=seed % 2 == 0)
    d = O.decide(O.Stream(tuple(cues)), SPEC)
    assert [w for p in d.parts for w in p.text.split()] == [w for c in cues for w in c.text.split()]
    assert len({d.hashes(k)[3] for k in range(3)}) == 3 and d.hashes(0) == d.hashes(0)
    if not d.passthrough:
        assert all(fits(p.text, p.runs, SPEC) and SPEC.min_display_ms <= p.lasts <= SPEC.max_display_ms for p in d.parts)
        best = [O.score(parts, op, SPEC) for op, cuts in d.candidates for parts, broken in [O.attempt(d.stream, cuts, SPEC)] if not broken]
        assert O.score(list(d.parts), d.op, SPEC) == pytest.approx(max(best))
        kind, measured, other = d.provenance()
        assert measured + other == (0 if d.op == "no_change" else len(d.cuts)) and (kind == "inherited") == (measured + other == 0)


def test_runs_and_repairs():
    a, b = (("A", 0),), (("B", 0),)
    cues = [Cue(k * 1000, k * 1000 + 900, "x", r, **m) for k, (r, m) in enumerate([(a, {}), (a, {}), (b, {}), (b, {"wall": True}), (b, {"type": "music"}), (b, {}), (b, {"review": True})])]
    assert O.runs(cues) == [(0, 2), (2, 3), (3, 4), (5, 6), (6, 7)]
    wide = [replace(c, lines=("y" * 40,)) if k in (1, 8) else replace(c, lines=("y",)) for k, c in enumerate([Cue(k, k + 1, "x", a) for k in range(10)])]
    assert O.failing_runs(wide, SPEC) == [(0, 4), (6, 10)]
    kept = list(O.optimize(wide, SPEC, repair_only=True, deferred=True))
    assert sum(len(c.text.split()) for c in kept) == 10
    cjk = [Cue(0, 3000, "今日はいい天気ですね。", a), Cue(3100, 5000, "そうですね。", a)]
    assert list(O.optimize(cjk, SPEC)) == cjk


def test_two_flashes_become_one_cue():
    cues = [Cue(0, 700, "We went home,", (("A", 0),)).shown(SPEC), Cue(800, 3000, "and then it rained.", (("A", 0),)).shown(SPEC)]
    (d,) = O.decisions(cues, SPEC)
    assert d.op == "merge_all" and [p.text for p in d.parts] == ["We went home, and then it rained."] and d.moved_words() == 4


def test_chain_and_mandatory_stages():
    cues = [c for k in range(4) for c in run(k, 20)]
    out = chain.format_cues(sorted(cues, key=lambda c: c.start), SPEC)
    assert out and all(x.start < x.end for x in out) and all(len(line) <= 32 for x in out for line in x.lines)
    assert chain.format_cues(cues, SPEC, [("shaping", lambda c, s: 1 / 0)], []) == cues
    with pytest.raises(chain.MandatoryStageError) as e:
        chain.format_cues(cues, SPEC, [], [("frame_grid", lambda c, s: 1 / 0)])
    assert e.value.code == "MANDATORY_STAGE_FRAME_GRID_FAILED"
    assert chain.format_cues([], SPEC) == []


# ---- fixed values: frozen keys and digests
KEYS = [
    (dict(project_id="proj_1", format="srt", actor_id="u1", actor_email="a@x.com"), "ccexp:cbeaf53abdebbebca25bff1e820515a5b73ae68bec1ff9772fec609003e61a51"),
    (dict(project_id="proj_1", format_run_id="run_1", format="srt", spec_slug="netflix-ttal", spec_version=3, actor_id="u1", actor_email="a@x.com"), "ccexp:d0a366335ea1276c5a889d0b3240f8d2d63c53d01c7feac9587c9fd8ef28a367"),
    (dict(project_id="proj_9", format_run_id="run_9", format="  SCC ", spec_slug="fcc", spec_version=2, override=True, override_reason="  Client-critical; label-CPS cue reviewed.  ", issue_codes=["FLASH_CUE", "SPEAKER_LABEL_CAUSED_CPS_FAILURE", "FLASH_CUE"], actor_id="u9", actor_email="  admin@x.com  ", client_action_id=" act-123 "), "ccexp:23c3f77fabb138de911d3ab5ce7bfe56e6348eea453ea393194fa50d2d813ae9"),
    (dict(project_id="proj_9", format_run_id="run_9", format="scc", spec_slug="fcc", spec_version=2, override=True, override_reason="Client-critical; label-CPS cue reviewed.", issue_codes=["SPEAKER_LABEL_CAUSED_CPS_FAILURE", "FLASH_CUE"], actor_id="u9", actor_email="admin@x.com", client_action_id="act-456"), "ccexp:9676fcb1e559ed0902fe30cb25d5e0ee613a29a1450959ddb8321abb9176bbf1"),
]
DELIVERED = [
    (0, "dialogue", 0, 1400, ["- Now, today's story", "is about a father"], "A", "bottom", ("pass", "info", [], False)),
    (1, "dialogue", 9200, 11500, ["That's not fair."], "B", "top", ("warn", "warn", ["MICRO_CUE"], False)),
    (2, "music", 18000, 21000, ["[GENTLE MUSIC]"], "", "bottom", None),
]
DELIVERED_HASH = "a9b418607c9166025f2b00ce3c3ee36a92660f80b11c592af095f613f25b6123"
# ----


@pytest.mark.parametrize("fields, key", KEYS)
def test_frozen_export_keys(spark, fields, key):
    ship(spark)
    kinds = dict(spec_version="long", override="boolean", issue_codes="array<string>")
    names = ("project_id", "format_run_id", "format", "spec_slug", "spec_version", "override", "override_reason", "issue_codes", "actor_id", "actor_email", "client_action_id")
    row = spark.createDataFrame([tuple(fields.get(n) for n in names)], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    assert row.select(T.export_action_key(**{n: F.col(n) for n in names})).first()[0] == key


def test_frozen_output_hash(spark):
    ship(spark)
    schema = "seq long, type string, start_ms long, end_ms long, lines array<string>, speaker_label string, position string, qc struct<status:string,severity:string,codes:array<string>,review:boolean>"
    cues = spark.createDataFrame(DELIVERED[::-1], schema).withColumns({"timeline_id": F.lit(1), "speaker_segments": F.lit(None).cast("array<struct<speaker:string,text:string>>"), "speaker_review_required": F.lit(None).cast("boolean")})
    assert identity.output_hash(cues).first().output_hash == DELIVERED_HASH
    assert identity.output_hash(cues.withColumn("lines", F.array(F.array_join("lines", " ")))).first().output_hash != DELIVERED_HASH


def test_canonical_form():
    assert T.canonical('{"b": 2.0, "a": [1.5, null, true], "c": "é"}') == '{"a":[1.5,null,true],"b":2,"c":"é"}'
    with pytest.raises(ValueError):
        T.canonical('{"x": NaN}')
    assert O.digest({"x": 2.0}) == O.digest({"x": 2})


def test_baseline_hash(spark, tmp_path):
    from cuesmith.sources import transcripts

    ship(spark)
    body = '"transcript_id": "t", "language_code": "en", "audio_duration": 2.5, "utterances": [{"speaker": "A", "start": 0, "end": 900, "text": "Hi  there", "words": [{"text": "Hi", "start": 0, "end": 400}, {"text": " ", "start": 400, "end": 410}, {"text": "there", "start": 500, "end": 900, "speaker": "B"}]}]'
    (tmp_path / "a.json").write_text("{" + body + "}")
    (tmp_path / "b.json").write_text('{ "extra": 1,\n ' + body + "}")
    (tmp_path / "c.json").write_text("{" + body.replace("900", "901") + "}")
    (tmp_path / "d.json").write_text('{"transcript_id": "none", "utterances": []}')
    read = transcripts.baseline(spark, str(tmp_path))
    assert read.count() == 3 and {r.audio_duration for r in read.collect()} == {2.5}
    hashes = [r.baseline_hash for r in identity.baseline_hash(read).collect()]
    assert len(hashes) == 3 and len(set(hashes)) == 2
    tokens = transcripts.tokens_of(read.limit(1)).orderBy("pos").collect()
    assert [(r.text, r.speaker) for r in tokens] == [("Hi", "A"), ("there", "B")]
    made = identity.input_tuple("h", None, None, "s", 3, {"B": 1, "A": 2}, "deterministic", "e")
    assert made["overlay_hash"] == "NONE" and made["overrides_hash"] == identity.input_tuple("x", None, None, "s", 3, {"A": "2", "B": "1"}, "d", "e")["overrides_hash"]


def test_boundary_reasons(spark):
    rows = [(1, 1, False, False, ["A"]), (1, 2, False, False, ["A"]), (1, 3, True, False, ["A"]), (1, 4, False, True, ["A"]), (1, 5, False, False, ["A", "B"]), (1, 6, None, None, ["A", "B"])]
    cues = spark.createDataFrame(rows, "timeline_id long, seq long, wall boolean, review boolean, speakers array<string>")
    got = {r.seq: (r.immutable, r.reason) for r in windows.boundaries(cues).collect()}
    assert got == {2: (False, None), 3: (True, "pause_boundary"), 4: (True, "unknown_speaker"), 5: (True, "unknown_speaker"), 6: (True, "speaker_change")}

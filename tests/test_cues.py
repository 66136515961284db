"""Folds over cues: worked cases, and what must hold for any timeline."""

import random

import pytest

from cuesmith.functions import layout as L
from cuesmith.functions import speech as S
from cuesmith.operators import cues as Q
from cuesmith.operators import shaping, speech as P
from cuesmith.operators.cues import Cue

SPEC = L.Spec()
A, B = (("A", 0),), (("B", 0),)


def cue(start, end, text, runs=A, **more):
    return Cue(start, end, text, runs, **more).shown(SPEC)


def group(start, end, text, speaker="A", hard=False):
    return {"start_ms": start, "end_ms": end, "words": text.split(), "speaker": speaker, "hard_before": hard}


# --------------------------------------------------------------------- layout


@pytest.mark.parametrize("text, lines", [
    ("Good work today, Hart. You've helped a lot around here.", ["Good work today, Hart.", "You've helped a lot around here."]),
    ("I went to the store because I needed milk", ["I went to the store", "because I needed milk"]),
    ("The United States government said", ["The United States", "government said"]),
    ("short", ["short"]), ("", [""]), ("  two   words ", ["two   words"]),
    ("x" * 40 + " y z", ["x" * 40, "y z"]),
    ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen", ["one two three four five six", "seven eight nine ten eleven twelve thirteen fourteen"]),
])
def test_wrap(text, lines):
    assert L.wrap(text, SPEC) == lines


def test_wrap_never_loses_a_word():
    rng = random.Random(1)
    for _ in range(500):
        text = " ".join("".join(rng.choices("abc,.", k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 20)))
        spec = L.Spec(max_chars=rng.choice([5, 16, 32]), max_lines=rng.choice([1, 2, 3]))
        lines = L.wrap(text, spec)
        assert " ".join(lines).split() == text.split() and len(lines) <= max(1, spec.max_lines)


def test_cjk_lines():
    text = "今日はとても天気がいいですね、明日も晴れるといいなと思います。"
    lines = L.wrap(text, L.Spec(max_chars=16))
    assert lines == ["今日はとても天気がいいですね、", "明日も晴れるといいなと思います。"]
    assert "".join(L.wrap(text, L.Spec(max_chars=6, max_lines=4))) == text
    assert L.is_cjk(text) and not L.is_cjk("hello 今") and not L.is_cjk("") and L.cjk_count("今 日\n") == 2


@pytest.mark.parametrize("mode, speaker, name", [
    ("alpha", "speaker_b", "SPEAKER S"), ("alpha", "B", "SPEAKER B"), ("generic", "SPEAKER_01", "SPEAKER 1"), ("generic", "0", "SPEAKER 1"), ("generic", "C", "SPEAKER 3"),
    ("named", "aai-B", "SPEAKER B"), ("every_change", "John", "JOHN"), ("always", "  ", ""),
])
def test_speaker_names(mode, speaker, name):
    assert L.speaker_name(speaker, L.Spec(label_mode=mode)) == name


def test_labels_are_not_broken():
    named = L.Spec(label_mode="named", label_map={"A": "Ann", "B": "Bob"}, role_map={"B": "narrator"}, off_camera_format="({name}):", label_case="title")
    assert L.speaker_name("aai-A", L.Spec(label_mode="named", label_map={"A": "Ann"})) == "ANN"
    assert L.render("hello there friend of mine you are", A, named) == ["[Ann:] hello there friend of", "mine you are"]
    assert L.render("hello", B, named) == ["(Bob): hello"]
    assert L.render("hi you there", (("A", 0), ("B", 1)), SPEC) == ["- hi", "- you there"]
    assert L.render("hi you there", (("A", 0), ("B", 1)), L.Spec(label_mode="none")) == ["hi", "you there"]
    tight = L.Spec(label_mode="named", label_map={"A": "Bartholomew"}, max_chars=8)
    assert L.render("hi", A, tight) == ["[BARTHOLOMEW:]", "hi"] and not L.fits("hi", A, tight)


# -------------------------------------------------------------------- packing


def test_short_sentences_share_a_cue_until_it_is_full():
    out = list(Q.pack_groups([group(0, 500, "Yes."), group(600, 900, "I know."), group(1000, 4000, "It is a long way to the station from here.")]))
    assert [(c.start, c.end, c.text) for c in out] == [(0, 4000, "Yes. I know. It is a long way to the station from here.")]
    out = list(Q.pack_groups([group(0, 500, "Yes."), group(600, 900, "No.", "B"), group(1000, 1400, "Why?", "B", hard=True), group(1500, 1600, "Who?", None), group(1700, 1800, "Me.", None)]))
    assert [(c.text, c.wall, c.review) for c in out] == [("Yes.", False, False), ("No.", False, False), ("Why?", True, False), ("Who?", False, True), ("Me.", False, True)]


def test_a_long_sentence_is_cut_and_takes_a_short_lead_in():
    long = "I went to the store because I needed milk, and then I came back home to find that everything was gone."
    out = list(Q.pack_groups([group(0, 900, "Well, I think so."), group(1000, 9000, long)]))
    assert " ".join(c.text for c in out) == "Well, I think so. " + long and out[0].start == 0 and out[-1].end == 9000
    assert all(len(c.text) <= SPEC.budget and L.fits(c.text, c.runs, SPEC) for c in out)
    untimed = list(Q.pack_groups([group(0, 900, "One."), group(None, None, "Two."), group(1000, 1900, "Three.")]))
    assert [c.text for c in untimed] == ["One.", "Three."]


def test_balanced_split_prefers_a_sentence_end():
    words = "We were there for the whole of the day. They had never seen anything quite like it before".split()
    at = L.best_break(words, 64, L.cue_gain, least=3)
    assert words[at - 1] == "day."
    assert L.best_break("a b c".split(), 64, L.cue_gain, least=3) is None


def uncondensed(cues, spec):
    return shaping.shape(cues, spec, condense=False)


@pytest.mark.parametrize("seed", range(30))
def test_packing_keeps_every_word_and_time(seed):
    rng = random.Random(seed)
    groups, at = [], 0
    for _ in range(rng.randrange(1, 25)):
        words = ["".join(rng.choices("abcdefg", k=rng.randrange(1, 12))) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(1, 40))]
        lasts = 100 * len(words) + rng.randrange(500)
        groups.append({"start_ms": at, "end_ms": at + lasts, "words": words, "speaker": rng.choice(["A", "A", "B", None]), "hard_before": rng.random() < 0.1})
        at += lasts + rng.randrange(0, 2000)
    out = list(Q.pack_groups(groups))
    assert " ".join(c.text for c in out).split() == [w for g in groups for w in g["words"]]
    assert all(c.start < c.end for c in out) and all(a.start <= b.start for a, b in zip(out, out[1:]))
    for passes in ([Q.readability], [Q.speed_rules], [uncondensed], [shaping.fit_lines], [Q.to_grid], [P.capitalize], [uncondensed, Q.readability, shaping.fit_lines, Q.to_grid]):
        cues = out
        for change in passes:
            cues = list(change(cues, SPEC))
        assert " ".join(c.text for c in cues).lower().split() == " ".join(c.text for c in out).lower().split()
        assert all(c.start < c.end for c in cues)


# ------------------------------------------------------------- time and merges


def test_donation_moves_the_boundary_only():
    fast, slow = cue(0, 400, "Twenty-seven signs in all, yes."), cue(480, 6000, "Slow.")
    out = Q.donate([fast, slow], SPEC)
    assert out[0].end > 400 and out[1].start == out[0].end + SPEC.gap_ms and out[1].end == 6000
    assert out[0].cps(SPEC) <= SPEC.max_cps and out[1].lasts >= SPEC.min_display_ms
    for other in (cue(480, 6000, "Slow.", B), cue(480, 6000, "Slow.", wall=True), cue(480, 6000, "Slow.", review=True)):
        assert Q.donate([fast, other], SPEC) == [fast, other]
    before = Q.donate([cue(0, 5000, "Slow."), cue(5080, 5480, "Twenty-seven signs in all, yes.")], SPEC)
    assert before[1].start < 5080 and before[0].end == before[1].start - SPEC.gap_ms


def test_slivers():
    alone = Q.absorb_slivers([cue(0, 200, "Hi.")], SPEC)
    assert [(c.start, c.end) for c in alone] == [(0, 800)]
    joined = Q.absorb_slivers([cue(0, 200, "So"), cue(300, 3000, "we left at once.")], SPEC)
    assert [(c.start, c.end, c.text) for c in joined] == [(0, 3000, "So we left at once.")]
    back = Q.absorb_slivers([cue(0, 2000, "we left"), cue(2100, 2300, "early."), cue(2350, 5000, "Right.", B)], SPEC)
    assert [c.text for c in back] == ["we left early.", "Right."]
    walled = [cue(0, 200, "So"), cue(300, 3000, "we left.", wall=True)]
    assert Q.absorb_slivers(walled, SPEC) == walled


def test_orphans_and_rapid_speakers():
    out = Q.reflow_orphans([cue(0, 1000, "we went"), cue(1100, 1500, "home."), cue(1600, 2000, "Yes.")], SPEC)
    assert [c.text for c in out] == ["we went home.", "Yes."]
    forward = Q.reflow_orphans([cue(0, 400, "Suddenly", B), cue(500, 2000, "it rained.", B)], SPEC)
    assert [c.text for c in forward] == ["Suddenly it rained."]
    two = list(Q.group_two_speakers([cue(0, 900, "You did?"), cue(1000, 1900, "I did.", B), cue(5000, 6000, "Oh.")], SPEC))
    assert [c.lines for c in two] == [("- You did?", "- I did."), ("Oh.",)] and two[0].runs == (("A", 0), ("B", 2))
    micro = list(Q.merge_micro([cue(0, 300, "Oh,"), cue(400, 2000, "I see.")], SPEC))
    assert [(c.start, c.end, c.text) for c in micro] == [(0, 2000, "Oh, I see.")]


def test_long_cues_are_halved_at_a_mark():
    long = cue(0, 12000, "He said that it was late, and then we all went home again.", wall=True)
    out = list(Q.split_long([long], SPEC))
    assert [c.text for c in out] == ["He said that it was late,", "and then we all went home again."]
    assert [c.wall for c in out] == [True, False] and out[1].start - out[0].end == SPEC.gap_ms and all(c.lasts <= 7000 for c in out)
    assert Q.middle_cut('She said "wait, no" and then she left'.split(), (",",), 3) == 4  # inside the quotes is no place


@pytest.mark.parametrize("num, den", [(25, 1), (24000, 1001), (30000, 1001)])
def test_grid(num, den):
    spec = L.Spec(frame_num=num, frame_den=den)
    rng, at, cues = random.Random(num), 0, []
    for _ in range(200):
        start = at + rng.randrange(-50, 300)
        cues.append(cue(max(0, start), max(0, start) + rng.randrange(300, 3000), "x"))
        at = cues[-1].end
    out = Q.to_grid(cues, spec)
    gap = Q.frame_of(spec.gap_ms, spec)
    for a, b in zip(out, out[1:]):
        assert Q.frame_of(b.start, spec) - Q.frame_of(a.end, spec) >= gap
    assert all(Q.ms_of(Q.frame_of(t, spec), spec) == t for c in out for t in (c.start, c.end))
    assert all(n.start >= c.start - 1 for c, n in zip(cues, out))
    still = Q.to_grid([cue(0, 1000, "x"), cue(1200, 2000, "y")], L.Spec())
    assert [(c.start, c.end) for c in still] == [(0, 1000), (1200, 2000)]


# ----------------------------------------------------------------------- speech


@pytest.mark.parametrize("text, clean", [
    ("Um, I think, you know, it works.", "I think, it works."), ("I I went home", "I went home"), ("like, I like it", "like, I like it"), ("So, like, I went", "So, I went"),
    ("[ANN:] uh yes", "[ANN:] yes"), ("um uh", "um uh"), ("", ""), ("Uh, we left.", "We left."), ("No, no.", "No,"),
])
def test_disfluencies(text, clean):
    assert S.remove_disfluencies(text) == clean


@pytest.mark.parametrize("word, ends", [("end.", True), ("Dr.", False), ("J.", False), ("e.g.", False), ("wait...", False), ("what?", True), ("Mr).", False), ('J".', False), ("。", True), ("", False), ("ok", False), ("Inc.", False)])
def test_sentence_ends(word, ends, spark):
    from pyspark.sql import functions as F

    from cuesmith.functions.text import is_sentence_end

    assert S.ends_sentence(word) is ends
    assert spark.range(1).select(is_sentence_end(F.lit(word))).first()[0] is ends


def test_capitalization():
    cues = [cue(0, 1, "we saw New York and"), cue(2, 3, "The town of Paris."), cue(4, 5, "then it"), cue(6, 7, "Paris was"), cue(8, 9, "And more", B), cue(9, 10, "NASA said", B)]
    out = [c.text for c in P.capitalize(cues, SPEC)]
    assert out == ["We saw New York and", "the town of Paris.", "Then it", "Paris was", "And more", "NASA said"]
    lines = [c.lines for c in P.capitalize(cues, SPEC)]
    assert lines[1] == ("the town of Paris.",)


def test_label_suppression():
    spec = L.Spec(label_mode="alpha")
    cues = [Cue(k, k + 1, t, r).shown(spec) for k, (t, r) in enumerate([("one", A), ("two", A), ("three", B), ("four", ()), ("five", B), ("six", A)])]
    assert [c.lines[0] for c in P.suppress_labels(cues, spec)] == ["[SPEAKER A:] one", "two", "[SPEAKER B:] three", "four", "five", "[SPEAKER A:] six"]
    assert [c.lines[0] for c in P.suppress_labels(cues, spec, frozenset({1}))][1] == "[SPEAKER A:] two"


def word(pos, start, end, speaker="A", utt=0):
    return {"timeline_id": 1, "utt": utt, "pos": pos, "speaker": speaker, "text": f"w{pos}", "start_ms": start, "end_ms": end}


def repaired(words, model="scribe_v2"):
    return [(w["start_ms"], w["end_ms"], w["disposition"], w["evidence"]) for w in P.repair_words(words, "ElevenLabs", model)]


def test_word_timing_repair():
    assert repaired([word(1, 0, 9000), word(2, 1000, 1400)]) == [(0, 980, "repaired", "neighbour"), (1000, 1400, None, None)]
    assert repaired([word(1, 0, 9000), word(2, 5000, 5400, utt=1)])[0] == (0, 1200, "repaired", "cross_utterance_neighbour")
    assert repaired([word(1, 0, 3000), word(2, 3100, 3400)])[0] == (0, 3000, None, None)  # the next word bears it out
    assert repaired([word(1, 0, 9000), word(2, 5000, 5400, "B")])[0] == (None, None, "quarantined", "quarantine")
    usual = [word(k, 100 * k, 100 * k + 300) for k in range(1, 6)]
    assert repaired([*usual, word(9, 700, 9000)])[-1] == (700, 1000, "repaired", "interpolation")
    assert repaired([word(1, 0, 9000), word(2, 1000, 1400)], "other")[0] == (0, 9000, None, None)
    assert repaired([word(1, 0, 9000), word(2, 50, 400)])[0] == (0, 200, "repaired", "neighbour")  # the floor holds after the bound
    assert repaired([word(1, None, None), word(2, 5, 4)]) == [(None, None, None, None), (5, 4, None, None)]


def test_condensing():
    fast = cue(0, 1000, "Um, I I think that it is, like, really good.")
    out = P.condense([fast], L.Spec(max_cps=30))
    assert out[0].text == "I think that it is, really good." and " ".join(out[0].lines) == out[0].text
    assert P.condense([fast], L.Spec(max_cps=90)) == [fast] and P.condense([fast], L.Spec(max_cps=30), "off") == [fast]
    two = [cue(0, 400, "we went all the way"), cue(450, 3000, "to the sea.")]
    assert [c.text for c in P.condense(two, SPEC, "condense_to_cps")] == ["we went all the way to the sea."]
    assert P.fragments(two) == [True, True]


def test_shaping_cuts_where_a_phrase_ends():
    long = cue(0, 6000, "He said that it was late, and we went home to sleep.")
    out = list(shaping.shape([long], SPEC))
    assert " ".join(c.text for c in out) == long.text and len(out) > 1 and all(c.lasts <= 4500 for c in out)
    timed = Cue(0, 6000, "He went away. They all stayed here.", A, timings=(("He", 0, 200), ("went", 300, 500), ("away.", 600, 1400), ("They", 3000, 3300))).shown(SPEC)
    two = shaping.cut_once(timed, SPEC)
    assert [c.text for c in two] == ["He went away.", "They all stayed here."] and two[0].end == 1400 - SPEC.gap_ms // 2
    tight = L.Spec(max_chars=10, max_lines=1)
    assert all(L.fits(c.text, c.runs, tight) for c in shaping.fit_lines([cue(0, 500, "one two three four five six")], tight))


def test_empty_and_odd_rows(spark):
    empty = spark.createDataFrame([], Q.CUE)
    assert Q.each(empty, Q.readability).count() == 0
    rows = [(1, 1, 0, 1000, None, None, None, None, None, None, None), (1, 2, None, None, "dialogue", "x", None, None, None, None, None), (None, 1, 0, 500, "dialogue", "Hello there", None, None, None, None, None)]
    from pyspark.sql import functions as F

    odd = spark.createDataFrame(rows, Q.CUE).withColumn("words", F.lit("x"))
    got = Q.each(odd, Q.speed_rules).collect()
    assert sorted((r.timeline_id is None, r.seq, r.text) for r in got) == [(False, 1, ""), (True, 1, "Hello there")]

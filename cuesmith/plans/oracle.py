"""The queries again in DuckDB's SQL, written on their own."""

from __future__ import annotations

from cuesmith.functions.text import ABBREVIATIONS
from cuesmith.plans.queries import SAMPLES, TAGS

_LIST = ", ".join(f"'{a}'" for a in ABBREVIATIONS)


def _ends(w: str) -> str:
    bare = f"trim(regexp_replace({w}, '[.!?\"'')\\]}}»”’]+$', ''))"
    return (
        f"(regexp_matches({w}, '[。！？．]$') OR (regexp_matches({w}, '[.!?]$') AND NOT ends_with({w}, '...') AND NOT (ends_with({w}, '.') AND "
        f"(contains({bare}, '.') OR lower({bare}) IN ({_LIST}) OR regexp_matches({bare}, '^[A-Z]$')))))"
    )


TOKENS = """
WITH raw AS (
  SELECT conv_id AS timeline_id, CAST(turn AS BIGINT) AS utt, role AS speaker, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM conversations
), wrd AS (SELECT timeline_id, utt, speaker, unnest(ws) AS text, unnest(range(len(ws))) AS k FROM raw),
plc AS (
  SELECT *, 60 + 45 * length(text) AS lasts, row_number() OVER o AS pos,
         CAST(sum(100 + 45 * length(text) + CASE WHEN k = 0 THEN 400 + (timeline_id * 7 + utt * 397) % 1600 ELSE 0 END) OVER o AS BIGINT) - 40 AS until
  FROM wrd WINDOW o AS (PARTITION BY timeline_id ORDER BY utt, k)
), tok AS (
  SELECT timeline_id, utt, speaker, pos, text, CASE WHEN pos % 50 <> 0 THEN until - lasts END AS start_ms, CASE WHEN pos % 50 <> 0 THEN until END AS end_ms FROM plc
)"""
GROUPS = TOKENS + f""", fl AS (
  SELECT *, start_ms IS NOT NULL AS timed,
    last_value(end_ms IGNORE NULLS) OVER (PARTITION BY timeline_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    lag(utt) OVER o AS utt0, lag(speaker) OVER o AS speaker0, lag(pos) OVER o AS pos0, coalesce(lag({_ends('text')}) OVER o, false) AS ended
  FROM tok WINDOW o AS (PARTITION BY timeline_id ORDER BY pos)
), hd AS (SELECT *, coalesce(utt <> utt0 AND timed AND start_ms - before >= 1200, false) AS hard FROM fl),
gt AS (
  SELECT *, CAST(sum(CASE WHEN pos0 IS NULL OR hard OR speaker IS DISTINCT FROM speaker0 OR ended THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY pos) AS BIGINT) AS group_id FROM hd
), grp AS (
  SELECT timeline_id, group_id, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, count(*) FILTER (timed) AS n_timed,
         arg_min(hard, pos) AS hard_before, string_agg(text, ' ' ORDER BY pos) AS text
  FROM gt GROUP BY timeline_id, group_id
), cue AS (SELECT timeline_id, group_id AS seq, start_ms, end_ms, text FROM grp WHERE start_ms IS NOT NULL)"""
EVENTS = """
WITH ev AS (SELECT user_id AS timeline_id, event_id AS pos, event_type, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 1000 AS end_ms FROM events)"""


def _srt(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


_CPS = "(length(text) / (greatest(1, end_ms - start_ms) / 1000.0))"
_IDEAL = "CAST(floor(length(text) / 27 * 1000) AS BIGINT)"
_BLOCK = f"{_srt('start_ms')} || ' --> ' || {_srt('end_ms')} || chr(10) || text"

ORACLE_SQL = {
    "speaker_totals": GROUPS + " SELECT timeline_id, speaker, count(*) AS n_groups, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM grp GROUP BY ALL",
    "seg1_groups": GROUPS + " SELECT * FROM grp",
    "seg3_sentence_ends": f"SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_filter(ws, lambda w: {_ends('w')})) AS BIGINT) AS n_ends FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM documents)",
    "seg5_unresolved": GROUPS + " SELECT timeline_id, group_id, n_words, text FROM grp WHERE start_ms IS NULL",
    "flt1_timing": TOKENS + " SELECT timeline_id, count(*) AS n_tokens, count(start_ms) AS n_timed, max(end_ms) AS until_ms FROM tok GROUP BY timeline_id",
    "flt3_density": "WITH RECURSIVE " + EVENTS.strip().removeprefix("WITH") + """, w AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY start_ms, end_ms, pos) AS n FROM ev),
k AS (SELECT timeline_id, n, pos, true AS kept, end_ms AS until FROM w WHERE n = 1 UNION ALL SELECT w.timeline_id, w.n, w.pos, w.start_ms - k.until >= 86400000, CASE WHEN w.start_ms - k.until >= 86400000 THEN w.end_ms ELSE k.until END FROM k JOIN w ON w.timeline_id = k.timeline_id AND w.n = k.n + 1)
SELECT timeline_id, count(*) AS n_kept, CAST(sum(pos) AS BIGINT) AS sum_pos FROM k WHERE kept GROUP BY timeline_id""",
    "nrm2_event_types": "SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(t, '{a}') THEN '{b}'" for a, b in TAGS) + f" END AS kind FROM (SELECT lower(regexp_replace({SAMPLES!r}[event_id % {len(SAMPLES)} + 1], '\\s+', ' ', 'g')) AS t FROM events)) GROUP BY kind",
    "nrm5_speaker_letters": TOKENS + ", f AS (SELECT timeline_id, speaker, min(pos) AS first_pos FROM tok WHERE speaker IS NOT NULL GROUP BY ALL) SELECT *, chr(CAST(64 + row_number() OVER (PARTITION BY timeline_id ORDER BY first_pos) AS INT)) AS letter FROM f",
    "nrm7_utterances": TOKENS + " SELECT timeline_id, utt, min(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, pos) AS end_ms, string_agg(text, ' ' ORDER BY pos) AS text, coalesce(round_even(sum(length(text) * 37 % 100) * 10000 / nullif(count(*) FILTER (length(text) * 37 % 100 > 0), 0) / 100, 0) / 10000, 0) AS confidence FROM tok WHERE start_ms IS NOT NULL GROUP BY timeline_id, utt",
    "nrm14_distinct_tokens": TOKENS + " SELECT timeline_id, min(pos) AS pos, speaker, text FROM tok GROUP BY timeline_id, speaker, text",
    "evt1_merged_events": EVENTS + """, a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER o THEN 0 ELSE 1 END AS turned FROM ev WINDOW o AS (PARTITION BY timeline_id ORDER BY start_ms, end_ms, pos)),
b AS (SELECT *, sum(turned) OVER (PARTITION BY timeline_id ORDER BY start_ms, end_ms, pos) AS run FROM a),
c AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY timeline_id, run ORDER BY start_ms, end_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600000 THEN 0 ELSE 1 END AS fresh FROM b),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY timeline_id, run ORDER BY start_ms, end_ms, pos) AS isle FROM c)
SELECT timeline_id, min(event_type) AS event_type, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_events FROM d GROUP BY timeline_id, run, isle HAVING max(end_ms) - min(start_ms) >= 300""",
    "jn1_interval_lookup": TOKENS + """, t AS (SELECT * FROM tok WHERE start_ms IS NOT NULL), s AS (SELECT timeline_id, utt, min(start_ms) - 500 AS a, max(end_ms) + 500 AS b FROM t GROUP BY ALL)
SELECT t.timeline_id, t.pos, min(s.utt) AS span FROM t LEFT JOIN s ON s.timeline_id = t.timeline_id AND (t.start_ms + t.end_ms) // 2 BETWEEN s.a AND s.b GROUP BY ALL""",
    "jn7_previous_speaker": "SELECT conv_id AS timeline_id, CAST(turn AS BIGINT) AS turn, last_value(nullif(role, 'assistant') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations",
    "cps1_extended": GROUPS + f", c AS (SELECT timeline_id, seq, start_ms, start_ms + length(text) * 20 AS end_ms, text FROM cue), n AS (SELECT *, lead(start_ms) OVER (PARTITION BY timeline_id ORDER BY seq) AS later FROM c) SELECT timeline_id, seq, start_ms, CASE WHEN {_CPS} > 45 THEN greatest(end_ms, least(start_ms + least({_IDEAL}, 7000), coalesce(later - 80, 9223372036854775807))) ELSE end_ms END AS end_ms FROM n",
    "cps3_trimmed": GROUPS + f", c AS (SELECT timeline_id, seq, start_ms, start_ms + length(text) * 250 AS end_ms, text FROM cue) SELECT timeline_id, seq, start_ms, CASE WHEN {_CPS} < 5 THEN least(end_ms, start_ms + greatest({_IDEAL}, 800)) ELSE end_ms END AS end_ms FROM c",
    "rdb3_min_duration": GROUPS + ", n AS (SELECT *, 800 - (end_ms - start_ms) AS need, lead(start_ms) OVER (PARTITION BY timeline_id ORDER BY seq) AS later FROM cue) SELECT timeline_id, seq, start_ms, CASE WHEN need > 0 AND later - end_ms >= need THEN end_ms + need ELSE end_ms END AS end_ms FROM n",
    "agg1_grades": GROUPS + f" SELECT timeline_id, count(*) AS n_cues, count(*) FILTER (round({_CPS}, 2) > 45) AS n_fast, count(*) FILTER (round({_CPS}, 2) < 5) AS n_slow, count(*) FILTER (end_ms - start_ms < 800) AS n_short, count(*) FILTER (end_ms - start_ms > 7000) AS n_long, count(*) FILTER (NOT contains(text, ' ')) AS n_one_word FROM cue GROUP BY timeline_id",
    "agg3_overlaps": GROUPS + ", n AS (SELECT timeline_id, end_ms + length(text) * 3 AS e, lead(start_ms) OVER (PARTITION BY timeline_id ORDER BY seq) AS later FROM cue) SELECT timeline_id, count(*) AS n_cues, count(*) FILTER (e > later) AS n_overlaps FROM n GROUP BY timeline_id",
    "agg7_rollup": GROUPS + " SELECT timeline_id, speaker, count(*) AS n_groups, count(*) FILTER (hard_before) AS n_hard, CAST(sum(n_words) AS BIGINT) AS n_words FROM grp GROUP BY ROLLUP (timeline_id, speaker)",
    "tim_timecodes": GROUPS + f" SELECT timeline_id, seq, {_srt('(start_ms * 40)')} AS srt_time, replace({_srt('end_ms')}, ',', '.') AS vtt_time, start_ms * 40 AS ms FROM cue",
    "grd2_frames": GROUPS + ', f AS (SELECT timeline_id, seq, (2 * start_ms * 25 + 1000) // 2000 AS nearest, start_ms * 30000 // 1001000 AS "floor", (start_ms * 30000 + 1000999) // 1001000 AS "ceil" FROM cue) SELECT *, (2 * "ceil" * 1001000 + 30000) // 60000 AS back_ms FROM f',
    "hsh1_group_hash": GROUPS + """ SELECT timeline_id, group_id, sha256('cchash/v1' || chr(10) || '{"end_ms":' || coalesce(CAST(end_ms AS VARCHAR), 'null') || ',"speaker":"' || speaker || '","start_ms":' || coalesce(CAST(start_ms AS VARCHAR), 'null') || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}') AS digest FROM grp""",
    "hsh4_fnv": GROUPS + " SELECT timeline_id, seq, printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(start_ms || '|' || end_ms || '|' || text, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295)) AS state FROM cue",
    "txt16_visible": GROUPS + " SELECT timeline_id, seq, length(text) AS characters, length(regexp_replace(text, '\\s+', '', 'g')) AS characters_no_spaces, CAST(len(string_split(text, ' ')) AS BIGINT) AS words FROM cue",
    "set4_new_words": TOKENS + """, d AS (SELECT DISTINCT timeline_id, utt, text FROM tok), q AS (SELECT conv_id AS timeline_id, CAST(turn AS BIGINT) AS turn, lag(CAST(turn AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS past FROM conversations)
SELECT q.timeline_id, q.turn, count(d.text) FILTER (o.text IS NULL) AS n_new FROM q LEFT JOIN d ON d.timeline_id = q.timeline_id AND d.utt = q.turn LEFT JOIN d o ON o.timeline_id = q.timeline_id AND o.utt = q.past AND o.text = d.text GROUP BY ALL""",
    "snk1_srt": GROUPS + f", n AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY seq) AS i FROM cue) SELECT timeline_id, string_agg(i || chr(10) || {_BLOCK}, chr(10) || chr(10) ORDER BY seq) || chr(10) AS document FROM n GROUP BY timeline_id",
    "snk2_vtt": GROUPS + f" SELECT timeline_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(replace({_srt('start_ms')}, ',', '.') || ' --> ' || replace({_srt('end_ms')}, ',', '.') || chr(10) || text, chr(10) || chr(10) ORDER BY seq) || chr(10) AS document FROM cue GROUP BY timeline_id",
    "snk3_scc": GROUPS + " SELECT timeline_id, 'Scenarist_SCC V1.0' || chr(10) || chr(10) || string_agg(start_ms || ':' || end_ms || '  ' || text, chr(10) ORDER BY seq) || chr(10) AS document FROM cue GROUP BY timeline_id",
}

"""Queries of cues, labels, events and quality, each with its SQL beside it.

Dialogue turns stand for transcripts; their sentence groups are laid out five words to
a line (``_lined``) where a rule needs lines that SQL can make as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesmith.functions import speech, words as W
from cuesmith.functions import text as T
from cuesmith.functions import timecode as C
from cuesmith.functions.layout import Spec, best_break, cue_gain, wrap_column
from cuesmith.operators import cues as Q
from cuesmith.operators import normalize as N
from cuesmith.operators import chain, optimizer, quality, shaping, sinks
from cuesmith.operators import segment as S
from cuesmith.operators import speech as P
from cuesmith.operators import windows as O
from cuesmith.plans.oracle import EVENTS, GROUPS, TOKENS, _srt
from cuesmith.plans.queries import TAGS, _events, _groups, _tokens
from cuesmith.session import ship

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sql_list(words: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words.split())


def _case(pairs, value: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({value}, '{a}') THEN '{b}'" for a, b in pairs) + " END"


# ------------------------------------------------------------------- tables

LINED = GROUPS + """, lin AS (
  SELECT timeline_id, group_id AS seq, start_ms, end_ms, text, speaker, hard_before AS wall,
    list_transform(range(0, len(string_split(text, ' ')), 5), lambda i: array_to_string(list_slice(string_split(text, ' '), i + 1, i + 5), ' ')) AS lines,
    CASE WHEN group_id % 7 = 0 THEN 'music' WHEN group_id % 11 = 0 THEN 'sound' ELSE 'dialogue' END AS type,
    CASE WHEN group_id % 5 = 0 THEN [speaker, 'other'] ELSE [speaker] END AS speakers
  FROM grp WHERE start_ms IS NOT NULL)"""


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, seq = _groups(spark, sf_dir).where("start_ms is not null"), F.col("group_id")
    words = F.split("text", " ")
    lines = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(5)), lambda i: F.array_join(F.slice(words, i + 1, 5), " "))
    kind = F.when(seq % 7 == 0, "music").when(seq % 11 == 0, "sound").otherwise("dialogue")
    who = F.when(seq % 5 == 0, F.array("speaker", F.lit("other"))).otherwise(F.array("speaker"))
    return g.select("timeline_id", seq.alias("seq"), "start_ms", "end_ms", "text", "speaker", F.col("hard_before").alias("wall"), lines.alias("lines"), kind.alias("type"), who.alias("speakers"))


#: Utterances: turns with bracketed tags put in.
UTTS = TOKENS + """, utts AS (
  SELECT timeline_id, utt, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
    CASE WHEN utt % 3 = 0 THEN '[music playing] ' ELSE '' END || string_agg(text, ' ' ORDER BY pos) || CASE WHEN utt % 2 = 0 THEN ' [applause] [door]' ELSE '' END AS text
  FROM tok GROUP BY timeline_id, utt HAVING min(start_ms) IS NOT NULL)"""


def _utts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    u = _tokens(spark, sf_dir).groupBy("timeline_id", "utt").agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), listed.alias("text"))
    before, after = F.when(F.col("utt") % 3 == 0, "[music playing] ").otherwise(""), F.when(F.col("utt") % 2 == 0, " [applause] [door]").otherwise("")
    return u.where("start_ms is not null").withColumn("text", F.concat(before, "text", after))


def _packed(spark: SparkSession, sf_dir: str, spec: Spec = Spec()) -> DataFrame:
    g = _groups(spark, sf_dir).withColumn("words", F.split("text", " "))
    return Q.pack(g, spec)


def _written(cues: DataFrame) -> DataFrame:
    """What a query of cues shows."""
    return cues.select("timeline_id", "seq", "start_ms", "end_ms", "type", F.array_join("lines", "|").alias("shown"), F.to_json("runs").alias("runs"), "review", "wall")


# ------------------------------------------------------- sources, normalizing


@query("SELECT event_id, CAST(coalesce(round_even(TRY_CAST(v AS DOUBLE) * 1000, 0), 0) AS BIGINT) AS ms FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) || '.' || CAST(event_id % 7 AS VARCHAR) || '125' END AS v FROM events)")
def nrm1_seconds(spark, sf_dir):
    v = F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.concat(F.col("event_id").cast("string"), F.lit("."), (F.col("event_id") % 7).cast("string"), F.lit("125")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", N.seconds_to_ms(v).alias("ms"))


# ---- fixed values: sample words
MARKS = ["[music]", "(crowd cheering)", "music", "[door]", "( Applause )", "say [rain]", "hello"]
# ----
_MARK = f"{MARKS!r}[CAST(event_id % {len(MARKS)} AS INT) + 1]"
_MARK_TAG = "lower(regexp_replace(regexp_extract(w, '^[(\\[]\\s*([^)\\]]+?)\\s*[)\\]]$', 1), '\\s+', ' ', 'g'))"


def _marks(spark, sf_dir):
    w = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("event_id") % len(MARKS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("timeline_id"), F.col("event_id").alias("pos"), w.alias("text"), F.when(F.col("event_id") % 10 == 0, "audio_event").alias("type"), (F.col("event_id") * 0.5).alias("start"), (F.col("event_id") * 0.5 + F.col("event_id") % 3).alias("end"))


@query(f"SELECT event_id, event_id % 10 = 0 OR ({_case(TAGS, _MARK_TAG)}) IS NOT NULL AS marker FROM (SELECT event_id, {_MARK} AS w FROM events)")
def nrm4_event_words(spark, sf_dir):
    return _marks(spark, sf_dir).select(F.col("pos").alias("event_id"), N.is_event_word(F.col("text"), F.col("type"), TAGS).alias("marker"))


_ISLES = """, a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER o THEN 0 ELSE 1 END AS turned FROM ev WINDOW o AS (PARTITION BY timeline_id ORDER BY start_ms, end_ms, pos)),
b AS (SELECT *, sum(turned) OVER (PARTITION BY timeline_id ORDER BY start_ms, end_ms, pos) AS run FROM a),
c AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY timeline_id, run ORDER BY start_ms, end_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2000 THEN 0 ELSE 1 END AS fresh FROM b),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY timeline_id, run ORDER BY start_ms, end_ms, pos) AS isle FROM c)
SELECT timeline_id, min(event_type) AS event_type, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_events FROM d GROUP BY timeline_id, run, isle HAVING max(end_ms) - min(start_ms) >= 300"""


@query(
    f"WITH w AS (SELECT user_id AS timeline_id, event_id AS pos, event_id % 10 = 0 AS marked, {_MARK} AS w, event_id FROM events), "
    f"t AS (SELECT *, lower(regexp_replace(CASE WHEN marked THEN trim(trim(w, '()[]{{}}')) ELSE regexp_extract(w, '[(\\[]\\s*([^)\\]]+?)\\s*[)\\]]', 1) END, '\\s+', ' ', 'g')) AS tag FROM w), "
    f"ev AS (SELECT timeline_id, pos, {_case(TAGS, 'tag')} AS event_type, CAST(event_id * 500 AS BIGINT) AS start_ms, CAST(event_id * 500 + event_id % 3 * 1000 AS BIGINT) AS end_ms FROM t WHERE {_case(TAGS, 'tag')} IS NOT NULL)" + _ISLES
)
def nrm3_word_events(spark, sf_dir):
    return N.word_events(_marks(spark, sf_dir), TAGS)


@query(
    f"WITH RECURSIVE {TOKENS.strip().removeprefix('WITH')}, w AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY pos) AS n FROM tok WHERE start_ms IS NOT NULL), "
    "u AS (SELECT timeline_id, n, speaker, start_ms AS since, end_ms, CAST(0 AS BIGINT) AS utt FROM w WHERE n = 1 UNION ALL "
    "SELECT w.timeline_id, w.n, w.speaker, CASE WHEN w.speaker = u.speaker AND w.start_ms - u.end_ms <= 300 AND w.end_ms - u.since <= 7000 THEN u.since ELSE w.start_ms END, w.end_ms, "
    "CASE WHEN w.speaker = u.speaker AND w.start_ms - u.end_ms <= 300 AND w.end_ms - u.since <= 7000 THEN u.utt ELSE u.utt + 1 END FROM u JOIN w ON w.timeline_id = u.timeline_id AND w.n = u.n + 1) "
    "SELECT timeline_id, utt, count(*) AS n_words, min(since) AS start_ms, max(end_ms) AS end_ms FROM u GROUP BY timeline_id, utt"
)
def nrm6_utterances(spark, sf_dir):
    t = _tokens(spark, sf_dir).where("start_ms is not null").withColumn("confidence", F.lit(1.0))
    return N.utterance_words(t).groupBy("timeline_id", "utt").agg(F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(UTTS + """, f AS (SELECT *, regexp_extract_all(text, '\\[[^\\]]+\\]') AS tags FROM utts), x AS (SELECT timeline_id, utt, start_ms, end_ms, greatest(1, greatest(1, end_ms - start_ms) // len(tags)) AS share, unnest(tags) AS tag, unnest(range(len(tags))) AS k FROM f WHERE len(tags) > 0)
SELECT timeline_id, utt, CAST(k AS INT) AS k, upper(trim(tag)) AS text, start_ms + k * share AS start_ms, greatest(start_ms + k * share + 1, least(end_ms, start_ms + k * share + share)) AS end_ms FROM x""")
def nrm11_sound_tokens(spark, sf_dir):
    return N.sound_tokens(_utts(spark, sf_dir))


@query(UTTS + f""", f AS (SELECT *, regexp_extract_all(text, '\\[[^\\]]+\\]') AS tags FROM utts), x AS (SELECT timeline_id, utt, start_ms, end_ms, greatest(1, greatest(1, end_ms - start_ms) // len(tags)) AS share, unnest(tags) AS tag, unnest(range(len(tags))) AS k FROM f WHERE len(tags) > 0),
y AS (SELECT timeline_id, utt * 100000 + k AS pos, lower(trim(tag, '[]')) AS t, start_ms + k * share AS start_ms, least(end_ms, start_ms + k * share + share) AS until FROM x),
ev AS (SELECT timeline_id, pos, {_case(TAGS, 't')} AS event_type, start_ms, greatest(start_ms + 300, until) AS end_ms FROM y WHERE {_case(TAGS, 't')} IS NOT NULL)""" + _ISLES)
def nrm13_tag_events(spark, sf_dir):
    return N.tag_events(_utts(spark, sf_dir), TAGS)


_UNTIL = "CASE WHEN end_ms > start_ms THEN end_ms ELSE start_ms + 1 END"


@query(UTTS + f", n AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY utt) AS i FROM utts WHERE trim(text) <> '') SELECT timeline_id, string_agg(i || chr(10) || {_srt('start_ms')} || ' --> ' || {_srt('(' + _UNTIL + ')')} || chr(10) || trim(text), chr(10) || chr(10) ORDER BY utt) || chr(10) AS document FROM n GROUP BY timeline_id")
def nrm16_backbone(spark, sf_dir):
    return N.backbone(_utts(spark, sf_dir))


@query(UTTS + f" SELECT timeline_id, row_number() OVER (PARTITION BY timeline_id ORDER BY utt) AS seq, start_ms, {_UNTIL} AS end_ms, trim(text) AS text FROM utts WHERE trim(text) <> ''")
def src6_srt(spark, sf_dir):
    """Subtitle text written and read again."""
    return N.parse_srt(N.backbone(_utts(spark, sf_dir))).select("timeline_id", "seq", "start_ms", "end_ms", F.array_join("lines", "\n").alias("text"))


@query("SELECT conv_id, count(DISTINCT text) AS n FROM conversations GROUP BY conv_id")
def src9_tokens(spark, sf_dir):
    """Words of a transcript: its own, else those of its utterances, else none."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.collect_set("text").alias("texts"))
    own = F.when(F.col("conv_id") % 2 == 0, F.col("texts"))
    nested = F.when(F.col("conv_id") % 2 == 1, F.transform("texts", lambda t: F.array(t)))
    return turns.select("conv_id", F.size(F.coalesce(own, F.flatten(nested), F.array().cast("array<string>"))).cast("long").alias("n"))


@query("SELECT conv_id, nullif(trim(CASE WHEN turn % 2 = 0 THEN ' ' || role || ' ' ELSE '  ' END), '') AS provider, nullif(trim(CAST(turn AS VARCHAR)), '') AS job, turn FROM conversations")
def nrm18_provenance(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    provider = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "role", F.lit(" "))).otherwise("  ")
    p = N.provenance(provider, F.col("role"), F.lit(None), F.col("turn"), F.lit(""))
    return t.select("conv_id", p["provider"].alias("provider"), p["transcription_job_id"].alias("job"), "turn")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) WHEN event_id % 3 = 1 THEN event_type || ' it''s 2nd' ELSE '' END AS raw, CASE WHEN event_id % 2 = 0 THEN 'music_note' ELSE event_type END AS kind FROM events),
l AS (SELECT event_id, kind LIKE '%music%' AS m, CASE WHEN raw = '' THEN kind ELSE raw END AS label FROM e)
SELECT event_id, '[' || upper(label) || ']' AS plain, CASE WHEN m THEN '<i>' || label || '</i>' ELSE '(' || lower(label) || ')' END AS other,
  CASE WHEN m THEN '♪ ' || CASE WHEN label = upper(label) AND label <> lower(label) THEN array_to_string(list_transform(regexp_extract_all(lower(label), '(\\p{L}+|\\P{L}+)'), lambda r: upper(r[1]) || r[2:]), '') ELSE label END || ' ♪' ELSE '<i>' || label || '</i>' END AS noted,
  CASE WHEN m THEN '' ELSE '[' || upper(label) || ']' END AS quiet FROM l""")
def nrm19_event_labels(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit(" it's 2nd"))).otherwise("")
    kind = F.when(F.col("event_id") % 2 == 0, "music_note").otherwise(F.col("event_type"))
    label = lambda *a: N.event_label(raw, kind, *a)
    return e.select("event_id", label().alias("plain"), label("italic", "parenthetical").alias("other"), label("musical_note_prefix", "italic").alias("noted"), label("none").alias("quiet"))


_SOUND_TOKENS = ORACLE_SQL["nrm11_sound_tokens"].replace("SELECT timeline_id, utt, CAST(k AS INT) AS k, upper", ", st AS (SELECT timeline_id, utt, CAST(k AS INT) AS k, upper") + ")"
_INNER = "trim(trim(text, '[]'))"


@query(_SOUND_TOKENS + f" SELECT timeline_id, utt * 100 + k AS pos, start_ms, greatest(end_ms, start_ms + 250) AS end_ms, '[' || upper({_INNER}) || ']' AS line, CASE WHEN contains(lower({_INNER}), 'music') THEN 'music' ELSE 'sound_effect' END AS type FROM st")
def nrm20_sound_cues(spark, sf_dir):
    return N.sound_cues(N.sound_tokens(_utts(spark, sf_dir)).withColumn("pos", F.col("utt") * 100 + F.col("k")))


@query(EVENTS + " SELECT timeline_id, pos, start_ms, CASE WHEN pos % 4 = 0 THEN start_ms + 250 ELSE end_ms END AS end_ms, '[' || upper(replace(event_type, '_', ' ')) || ']' AS line, 'sound_effect' AS type FROM ev")
def nrm21_event_cues(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("end_ms", F.when(F.col("pos") % 4 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))).withColumn("text", F.lit(None).cast("string"))
    return N.event_cues(e)


@query(LINED + """, both_ AS (SELECT timeline_id, seq AS pos, start_ms, end_ms, text AS line, 'dialogue' AS type FROM lin UNION ALL SELECT timeline_id, seq, start_ms, start_ms + 250, '[X]', 'music' FROM lin WHERE seq % 3 = 0)
SELECT timeline_id, start_ms, end_ms, line, type, row_number() OVER (PARTITION BY timeline_id ORDER BY start_ms, type <> 'dialogue', pos, end_ms, line) AS seq FROM both_""")
def nrm22_all_cues(spark, sf_dir):
    c = _lined(spark, sf_dir).select("timeline_id", F.col("seq").alias("pos"), "start_ms", "end_ms", F.col("text").alias("line"), F.lit("dialogue").alias("type"))
    s = c.where("pos % 3 = 0").withColumns({"end_ms": F.col("start_ms") + 250, "line": F.lit("[X]"), "type": F.lit("music")})
    return N.in_order(c, s)


@query(LINED + " SELECT timeline_id, seq, start_ms + 3600000 AS start_ms, end_ms + 3600000 AS end_ms, array_to_string(list_transform(lines, lambda x: replace(replace(x, 'the', '<i>the</i>'), 'and', '<i>and</i>')), '|') AS shown, array_to_string(lines, '|') AS plain FROM lin")
def nrm24_italics(spark, sf_dir):
    """Offset, italic phrases, and the tags taken off again."""
    c = _lined(spark, sf_dir).withColumns({"start_ms": F.col("start_ms") + 3_600_000, "end_ms": F.col("end_ms") + 3_600_000, "lines": N.italicized(F.col("lines"), ["the", "and"])})
    return c.select("timeline_id", "seq", "start_ms", "end_ms", F.array_join("lines", "|").alias("shown"), F.array_join(F.transform("lines", T.strip_tags), "|").alias("plain"))


@query(LINED + " SELECT timeline_id, seq, CASE WHEN end_ms <= 20000 THEN '{\\+an8}' WHEN start_ms >= 10000 AND end_ms <= 60000 THEN '{\\+an5}' ELSE '{\\+an2}' END || array_to_string(lines, '|') AS shown FROM lin")
def nrm26_alignment(spark, sf_dir):
    c = N.aligned(_lined(spark, sf_dir), [(0, 20_000, "an8"), (10_000, 60_000, "an5")], "an2")
    return c.select("timeline_id", "seq", F.array_join("lines", "|").alias("shown"))


@query(TOKENS + """, b AS (SELECT timeline_id, pos, text, start_ms, end_ms, speaker, coalesce(start_ms, pos * 10) AS s, coalesce(end_ms, pos * 10 + 5) AS e, 0 AS kind FROM tok
 UNION ALL SELECT timeline_id, pos, CASE WHEN pos % 2 = 0 THEN text ELSE '[X]' END, start_ms, end_ms, CASE WHEN pos % 2 = 0 THEN speaker END, coalesce(start_ms, pos * 10), coalesce(end_ms, pos * 10 + 5), 1 FROM tok WHERE pos % 5 < 2),
d AS (SELECT *, row_number() OVER (PARTITION BY timeline_id, text, start_ms, end_ms, speaker ORDER BY s, e, text, kind, pos) AS n FROM b)
SELECT timeline_id, row_number() OVER (PARTITION BY timeline_id ORDER BY s, e, text, kind, pos) AS seq, text, start_ms, end_ms, speaker, kind FROM d WHERE n = 1""")
def nrm14_merged_tokens(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumns({"original_start_ms": F.col("pos") * 10, "original_end_ms": F.col("pos") * 10 + 5})
    s = t.where("pos % 5 < 2").withColumns({"text": F.when(F.col("pos") % 2 == 0, F.col("text")).otherwise("[X]"), "speaker": F.when(F.col("pos") % 2 == 0, F.col("speaker"))})
    return N.merge_tokens(t, s)


@query(TOKENS + """, u AS (SELECT timeline_id, utt, min(speaker) AS who, min(start_ms) AS a, max(end_ms) AS b FROM tok GROUP BY timeline_id, utt),
m AS (SELECT t.timeline_id, t.pos, t.text, t.start_ms, t.end_ms, CASE WHEN t.pos % 3 > 0 THEN t.speaker END AS speaker, min(u.utt) AS utt FROM tok t LEFT JOIN u ON u.timeline_id = t.timeline_id AND (t.start_ms + t.end_ms) // 2 BETWEEN u.a AND u.b GROUP BY ALL)
SELECT m.timeline_id, m.pos, m.text, m.start_ms, m.end_ms, coalesce(m.speaker, u.who) AS speaker, m.utt FROM m LEFT JOIN u USING (timeline_id, utt)""")
def nrm10_back_filled(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    utts = t.groupBy("timeline_id", "utt").agg(F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).where("start_ms is not null")
    return N.back_filled(t.withColumn("speaker", F.when(F.col("pos") % 3 > 0, F.col("speaker"))).drop("utt"), utts)


@query(TOKENS + " SELECT timeline_id, utt * 1000 + k AS pos, CAST(k AS INT) AS k, speaker, text, start_ms, end_ms FROM (SELECT timeline_id, utt, speaker, start_ms, end_ms, text, 0 AS k FROM tok LIMIT 0)")
def seg4_no_cjk(spark, sf_dir):
    """Tokens that the CJK split cuts: none in these tables."""
    return N.exploded_cjk(_tokens(spark, sf_dir)).where("k > 0")


# ----------------------------------------------------------------- predicates

_WALL = "coalesce(wall OR speaker <> lag(speaker) OVER o, false)"


@query(LINED + """, p AS (SELECT *, lag(speaker) OVER o AS before, lag(seq) OVER o AS last FROM lin WINDOW o AS (PARTITION BY timeline_id ORDER BY seq))
SELECT timeline_id, seq, wall OR before <> speaker AS immutable, CASE WHEN wall THEN 'pause_boundary' WHEN before <> speaker THEN 'speaker_change' END AS reason FROM p WHERE last IS NOT NULL""")
def flt4_boundaries(spark, sf_dir):
    return O.boundaries(_lined(spark, sf_dir).withColumn("review", F.lit(False)).withColumn("speakers", F.array("speaker")))


@query(TOKENS + " SELECT timeline_id, count(*) FILTER (NOT s) AS n_spoken, count(*) FILTER (s) AS n_sound FROM (SELECT timeline_id, starts_with(text, '[') AND ends_with(text, ']') AS s FROM (SELECT timeline_id, CASE WHEN pos % 4 = 0 THEN '[' || text || ']' ELSE text END AS text FROM tok)) GROUP BY timeline_id")
def flt2_split(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumn("text", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text")))
    return t.groupBy("timeline_id").agg(F.count_if(~T.is_sound(F.col("text"))).alias("n_spoken"), F.count_if(T.is_sound(F.col("text"))).alias("n_sound"))


_FRAME = "((2 * start_ms * 25 + 1000) // 2000)"


@query(LINED + f" SELECT timeline_id, seq, (2 * {_FRAME} * 1000 + 25) // 50 = start_ms AS on_grid FROM lin")
def flt9_on_grid(spark, sf_dir):
    return _lined(spark, sf_dir).select("timeline_id", "seq", (C.from_frame(C.to_frame(F.col("start_ms"))) == F.col("start_ms")).alias("on_grid"))


_PLAIN_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(LINED + f""" SELECT timeline_id, seq, len({_PLAIN_WORDS}) = 1 AND lower(regexp_replace(text, '[.!?"'')\\]}}]+$', '')) NOT IN ({_sql_list(W.BRIEF_RESPONSES)}) AS orphan,
 len({_PLAIN_WORDS}) BETWEEN 1 AND 2 AND NOT regexp_matches(text, '[.!?…]["''”’)\\]]?\\s*$') AS fragment, len(regexp_extract_all(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '[^ ]+')) = 1 AS one_word,
 coalesce(list_last(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_'']+$', ''), '\\s+'), lambda w: w <> '')) IN ({_sql_list(W.QC_FUNCTION_WORDS)}), false) AS weak FROM lin""")
def flt10_words(spark, sf_dir):
    """Orphans, fragments, single words and weak ends."""
    text = F.col("text")
    bare = F.lower(F.regexp_replace(text, r"""[.!?"')\]}]+$""", ""))
    orphan = (F.size(quality.words_of(text)) == 1) & ~bare.isin(*W.BRIEF_RESPONSES.split())
    return _lined(spark, sf_dir).select("timeline_id", "seq", orphan.alias("orphan"), quality.is_fragment(text).alias("fragment"), quality.is_one_word(F.array(text)).alias("one_word"), quality.ends_on_function_word(text).alias("weak"))


# ---------------------------------------------------------------------- joins


@query(TOKENS + """, s AS (SELECT timeline_id, utt, min(start_ms) - 700 AS a, max(end_ms) + 700 AS b FROM tok GROUP BY ALL)
SELECT s.timeline_id, s.utt AS span, string_agg(t.text, ' ' ORDER BY t.pos) AS words FROM s JOIN tok t ON t.timeline_id = s.timeline_id AND (t.start_ms + t.end_ms) // 2 BETWEEN s.a AND s.b GROUP BY ALL""")
def jn2_words_in_window(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    spans = t.groupBy("timeline_id", F.col("utt").alias("span")).agg((F.min("start_ms") - 700).alias("from_ms"), (F.max("end_ms") + 700).alias("to_ms")).where("from_ms is not null")
    return O.words_in(spans, t).select("timeline_id", "span", F.array_join(F.transform("timings", lambda x: x["text"]), " ").alias("words"))


# ----------------------------------------------------------------- aggregates

_CHARS = "length(trim(array_to_string(lines, ' ')))"
_SPEED = f"round({_CHARS} / (greatest(1, end_ms - start_ms) / 1000.0), 2)"
_SND = "type IN ('sound', 'music', 'sound_effect')"
_FW = f"coalesce(list_last(list_filter(string_split_regex(regexp_replace(lower(trim(l)), '[^\\p{{L}}\\p{{N}}_'']+$', ''), '\\s+'), lambda w: w <> '')) IN ({_sql_list(W.QC_FUNCTION_WORDS)}), false)"
_ONE = "len(regexp_extract_all(regexp_replace(array_to_string(lines, ' '), '[^\\p{L}\\p{N}_]+', ' ', 'g'), '[^ ]+')) = 1"
_VIOLATIONS = f"""list_filter([CASE WHEN list_max(list_transform(lines, lambda l: length(l))) > 32 THEN 'fail:max_chars_per_line' END, CASE WHEN len(lines) > 2 THEN 'fail:max_lines_per_caption' END,
 CASE WHEN NOT {_SND} AND {_SPEED} > 45 THEN 'fail:max_cps' END, CASE WHEN NOT {_SND} AND {_SPEED} < 5 AND {_CHARS} > 0 THEN 'warn:min_cps' END, CASE WHEN NOT {_SND} AND {_ONE} THEN 'warn:one_word_cue' END,
 CASE WHEN NOT {_SND} AND len(list_filter(lines, lambda l: {_FW})) > 0 THEN 'warn:weak_line_ending' END, CASE WHEN end_ms - start_ms < 800 THEN 'warn:min_caption_duration_ms' END], lambda v: v IS NOT NULL)"""


@query(LINED + f" SELECT timeline_id, seq, array_to_string({_VIOLATIONS}, ',') AS violations FROM lin")
def agg2_cue_grades(spark, sf_dir):
    g = quality.graded(_lined(spark, sf_dir))
    return g.select("timeline_id", "seq", F.array_join(F.transform("violations", lambda v: F.concat(v["severity"], F.lit(":"), v["rule"])), ",").alias("violations"))


PHRASES = ["of the", "in the", "to the"]
_SPLITS = " + ".join(f"CASE WHEN contains(array_to_string(lines, ' '), '{p}') AND contains(array_to_string(lines, chr(10)), replace('{p}', ' ', chr(10))) THEN 1 ELSE 0 END" for p in PHRASES)


@query(LINED + f""", g AS (SELECT *, end_ms + 900 > lead(start_ms) OVER o AS over_, lead(type) OVER o AS next, {_VIOLATIONS.replace('end_ms', '(end_ms + 900)')} AS v FROM lin WINDOW o AS (PARTITION BY timeline_id ORDER BY seq))
SELECT timeline_id, count(*) AS cues_out, count(*) FILTER (over_) AS overlaps, count(*) FILTER (over_ AND (type = 'sound' OR next = 'sound')) AS sound_overlap_violations, count(*) FILTER (len(lines) > 2) AS max_lines_violation,
 count(*) FILTER (list_max(list_transform(lines, lambda l: length(l))) > 32) AS max_chars_violation, count(*) FILTER (end_ms + 900 - start_ms < 800) AS short_duration_violations, count(*) FILTER (NOT {_SND} AND {_ONE}) AS one_word_dialogue_cues,
 CAST(sum(len(list_filter(lines, lambda l: {_FW}))) AS BIGINT) AS function_word_endings, CAST(sum({_SPLITS}) AS BIGINT) AS protected_phrase_splits, count(*) FILTER (type = 'dialogue' AND len(list_distinct(speakers)) >= 2) AS multi_speaker_dialogue_cues,
 CAST(sum(len(list_filter(v, lambda x: starts_with(x, 'fail')))) AS BIGINT) AS total_fail, CAST(sum(len(list_filter(v, lambda x: starts_with(x, 'warn')))) AS BIGINT) AS total_warn,
 count(*) FILTER (len(list_filter(v, lambda x: starts_with(x, 'fail'))) > 0) AS blocked_cue_count, bool_or(len(list_filter(v, lambda x: starts_with(x, 'fail'))) > 0) AS export_blocked FROM g GROUP BY timeline_id""")
def agg1_report(spark, sf_dir):
    return quality.report(_lined(spark, sf_dir).withColumn("end_ms", F.col("end_ms") + 900), PHRASES)


_GRID = "((2 * ((2 * {0} * 25 + 1000) // 2000) * 1000 + 25) // 50 <> {0})"
_PW = "list_filter(list_transform(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '[.,;:!?\"''()\\[\\]]', '', 'g'))), lambda w: true)"
ISSUES = LINED + f""", q0 AS (SELECT timeline_id, seq, start_ms, start_ms + (end_ms - start_ms) // 2 AS end_ms, lines, type, speaker FROM lin),
q1 AS (SELECT *, array_to_string(lines, chr(10)) AS txt, greatest(0, end_ms - start_ms) AS lasts, lead(start_ms) OVER o AS after, lag(end_ms) OVER o AS past, lead(type) OVER o AS kind, lead(speaker) OVER o AS who,
  CAST(floor(length(replace(array_to_string(lines, chr(10)), chr(10), '')) / 17 * 1000) AS BIGINT) + 1 AS need FROM q0 WINDOW o AS (PARTITION BY timeline_id ORDER BY seq)),
q2 AS (SELECT *, length(replace(txt, chr(10), '')) AS chars, CASE WHEN lasts > 0 THEN length(replace(txt, chr(10), '')) / (lasts / 1000.0) ELSE 'inf'::DOUBLE END AS cps,
  greatest(least(start_ms + need, coalesce(after - 80, start_ms + need)), end_ms) AS late, {_PW.format("replace(txt, chr(10), ' ')")} AS ws FROM q1),
q3 AS (SELECT *, least(greatest(late - need, coalesce(past + 80, late - need)), start_ms) AS early, list_filter(['of the', 'in the'], lambda p: len(list_filter(range(1, len(ws)), lambda i: i % 5 = 0 AND ws[i] || ' ' || ws[i + 1] = p)) > 0)[1] AS phrase,
  lead(chars) OVER o AS chars2, lead(cps) OVER o AS cps2 FROM q2 WINDOW o AS (PARTITION BY timeline_id ORDER BY seq)),
q4 AS (SELECT *, list_filter(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1] = phrase)[1] AS at_, list_filter(string_split_regex(replace(txt, chr(10), ' '), '\\s+'), lambda w: w <> '') AS flat FROM q3),
q5 AS (SELECT *, at_ IS NULL OR len(list_filter(range(1, len(flat)), lambda b: b <> at_ AND length(array_to_string(list_slice(flat, 1, b), ' ')) <= 42 AND length(array_to_string(list_slice(flat, b + 1, len(flat)), ' ')) <= 42)) > 0 AS safe FROM q4),
iss AS (
 SELECT timeline_id, seq, 'DURATION_BELOW_MIN' AS issue_code, 'fail' AS severity, CAST(lasts AS DOUBLE) AS metric, true AS attempted, 'unresolved' AS result FROM q5 WHERE type = 'dialogue' AND lasts < 800
 UNION ALL SELECT timeline_id, seq, 'FRAME_GRID_MISALIGNMENT', 'fail', NULL, false, 'unresolved' FROM q5 WHERE {_GRID.format('start_ms')} OR {_GRID.format('end_ms')}
 UNION ALL SELECT timeline_id, seq, 'MIN_GAP_FRAMES', 'fail', NULL, false, 'unresolved' FROM q5 WHERE type = 'dialogue' AND kind = 'dialogue' AND after - end_ms < 80
 UNION ALL SELECT timeline_id, seq, 'FLASH_CUE', 'fail', lasts, true, CASE WHEN least(start_ms + 400, coalesce(after - 80, start_ms + 400)) - start_ms >= 400 THEN 'resolved' ELSE 'unresolved' END FROM q5 WHERE lasts > 0 AND lasts < 400
 UNION ALL SELECT timeline_id, seq, 'MICRO_CUE', 'warn', lasts, false, 'flagged' FROM q5 WHERE lasts >= 400 AND lasts < 1000
 UNION ALL SELECT timeline_id, seq, 'AVOIDABLE_FRAGMENT', 'warn', len(flat), false, 'flagged' FROM q5 WHERE len(flat) BETWEEN 1 AND 2 AND NOT regexp_matches(txt, '[.!?…]["''”’)\\]]?\\s*$')
 UNION ALL SELECT timeline_id, seq, CASE WHEN safe THEN 'PROTECTED_PHRASE_SPLIT' ELSE 'PROTECTED_PHRASE_GEOMETRY_CONFLICT' END, 'fail', NULL, true, CASE WHEN safe THEN 'resolved' ELSE 'unresolved' END FROM q5 WHERE phrase IS NOT NULL
 UNION ALL SELECT timeline_id, seq, 'CPS_OVER_MAX', 'fail', cps, true, CASE WHEN need > greatest(1, end_ms - start_ms) AND (late - start_ms >= need OR (late - early >= need AND early < start_ms)) THEN 'resolved' ELSE 'unresolved' END FROM q5 WHERE type = 'dialogue' AND cps > 17
 UNION ALL SELECT timeline_id, seq, 'READING_SPEED_IMBALANCE', 'warn', greatest(cps, cps2) / least(cps, cps2), false, 'flagged' FROM q5 WHERE speaker = who AND least(cps, cps2) > 0 AND greatest(cps, cps2) <> 'inf'::DOUBLE AND greatest(cps, cps2) / least(cps, cps2) >= 2.2
 UNION ALL SELECT timeline_id, seq, 'OVERLOADED_UNDERFILLED_ADJACENCY', 'warn', greatest(chars, chars2) / least(chars, chars2), false, 'flagged' FROM q5 WHERE speaker = who AND least(chars, chars2) > 0 AND greatest(chars, chars2) / least(chars, chars2) >= 3)"""


def _issues(spark, sf_dir):
    half = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2)
    return quality.issues(_lined(spark, sf_dir).withColumn("end_ms", half), PHRASES[:2], speaker="speaker")


@query(ISSUES + " SELECT timeline_id, seq, issue_code, severity, round(metric, 6) AS metric, attempted, result FROM iss")
def qcs1_issues(spark, sf_dir):
    return _issues(spark, sf_dir).withColumn("metric", F.round("metric", 6))


_SUMMARY = """, s AS (SELECT timeline_id, seq, bool_or(severity = 'fail') AS hard, bool_or(severity = 'fail' AND result <> 'resolved') AS review_required, bool_or(severity = 'warn') AS warns, list_sort(list(DISTINCT issue_code)) AS codes FROM iss GROUP BY ALL)"""


@query(ISSUES + _SUMMARY + " SELECT timeline_id, seq, CASE WHEN review_required THEN 'fail' WHEN hard THEN 'corrected' ELSE 'warn' END AS status, CASE WHEN hard THEN 'fail' WHEN warns THEN 'warn' ELSE 'info' END AS highest_severity, array_to_string(codes, ',') AS issue_codes, review_required, CASE WHEN review_required THEN 'unresolved' WHEN hard THEN 'corrected' ELSE 'flagged' END AS outcome FROM s")
def agg6_cue_summaries(spark, sf_dir):
    return quality.cue_summaries(_issues(spark, sf_dir)).withColumn("issue_codes", F.array_join("issue_codes", ","))


_RULE_CASE = "CASE issue_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quality.RULES.items()) + " END"


@query(ISSUES + _SUMMARY + f""", t AS (SELECT timeline_id, count(*) FILTER (review_required) AS n_fail, count(*) FILTER (hard AND NOT review_required) AS n_corrected, count(*) FILTER (NOT hard) AS n_warn FROM s GROUP BY timeline_id),
i AS (SELECT timeline_id, count(*) AS n_issues, count(*) FILTER (attempted) AS n_attempts, array_to_string(coalesce(list_sort(list(DISTINCT {_RULE_CASE}) FILTER (severity = 'fail')), []), ',') AS technical_violations FROM iss GROUP BY timeline_id)
SELECT *, n_fail AS n_review, CASE WHEN n_fail > 0 THEN 'has_unresolved' WHEN n_corrected > 0 THEN 'corrected' ELSE 'clean' END AS completeness, n_fail > 0 AS export_blocked FROM t JOIN i USING (timeline_id)""")
def agg7_qc_rollup(spark, sf_dir):
    return quality.rollup(_issues(spark, sf_dir)).withColumn("technical_violations", F.array_join("technical_violations", ","))


@query(GROUPS + """, u AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY group_id) - 1 AS k FROM grp WHERE start_ms IS NULL)
SELECT timeline_id, 'ug#' || k AS unresolved_group_id, 'UNRESOLVED_UNTIMED_CONTENT' AS issue_code, 'fail' AS severity, text, false AS text_truncated, length(text) AS original_text_length, n_words AS word_count, speaker FROM u""")
def qcs6_unresolved(spark, sf_dir):
    g = _groups(spark, sf_dir).where("start_ms is null").withColumn("words", F.split("text", " "))
    return quality.unresolved_issues(g).drop("words")


@query(TOKENS + f""", p AS (SELECT timeline_id, pos, lower(regexp_replace(text, '[.,;:!?"''()\\[\\]]', '', 'g')) AS word FROM tok), k AS (SELECT DISTINCT timeline_id, word FROM p WHERE pos % 3 > 0)
SELECT timeline_id, word, min(pos) AS pos FROM p ANTI JOIN k USING (timeline_id, word) WHERE word <> '' AND word NOT IN ({_sql_list(W.QC_STOPWORDS)}) GROUP BY ALL""")
def jn5_removed_words(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return quality.removed_words(t, t.where("pos % 3 > 0").select("timeline_id", F.array("text").alias("lines")))


# --------------------------------------------------------------------- layout

_WB = f"lower(regexp_replace({{0}}, '[^\\p{{{{L}}}}\\p{{{{N}}}}_'']+$', ''))"
_WEAK = _sql_list(W.LEADING + " " + W.DETERMINERS)


def _close(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '[.!?]$') THEN 32 WHEN regexp_matches({w}, '[,;:—–]$') THEN 28 ELSE 0 END"


def _name(w: str) -> str:
    return f"(regexp_matches(regexp_replace({w}, '[^\\p{{L}}\\p{{N}}_'']+$', ''), '^\\p{{Lu}}.*\\p{{Ll}}') AND {_WB.format(w)} NOT IN ({_WEAK}))"


#: Sentence groups of 33 to 65 signs, and each place where they may break.
BREAKS = LINED + f""", sh AS (SELECT timeline_id, seq, text, string_split(text, ' ') AS ws FROM lin WHERE length(text) BETWEEN 33 AND 65),
br AS (SELECT timeline_id, seq, text, array_to_string(list_slice(ws, 1, i), ' ') AS l1, array_to_string(list_slice(ws, i + 1, len(ws)), ' ') AS l2, ws[i] AS la, ws[i + 1] AS fi, i FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM sh)),
sc AS (SELECT *, -abs(length(l1) - length(l2)) + {_close('la')} + CASE WHEN {_WB.format('fi')} IN ({_sql_list(W.LEADING)}) THEN 15 ELSE 0 END - CASE WHEN {_WB.format('la')} IN ({_WEAK}) THEN 25 ELSE 0 END
  - CASE WHEN {_WB.format('la')} NOT IN ({_WEAK}) AND {_WB.format('la')} IN ({_sql_list(W.FORWARD)}) THEN 12 ELSE 0 END - CASE WHEN {_WB.format('fi')} NOT IN ({_sql_list(W.LEADING)}) AND {_WB.format('fi')} IN ({_sql_list(W.PARTICLES)}) THEN 12 ELSE 0 END
  - CASE WHEN {_close('la')} = 0 AND {_name('la')} AND {_name('fi')} THEN 18 ELSE 0 END AS gain FROM br WHERE length(l1) <= 32 AND length(l2) <= 32)"""


@query(BREAKS + " SELECT timeline_id, seq, arg_max(l1 || '|' || l2, gain * 1000 - i) AS shown FROM sc GROUP BY timeline_id, seq")
def txt2_two_lines(spark, sf_dir):
    c = _lined(spark, sf_dir).where(F.length("text").between(33, 65)).select("timeline_id", "seq", wrap_column(F.col("text")).alias("l"))
    two = c.where((F.size("l") == 2) & (F.array_max(F.transform("l", F.length)) <= 32))
    return two.select("timeline_id", "seq", F.array_join("l", "|").alias("shown"))


@query(LINED + """, c AS (SELECT timeline_id, seq, text, string_split(text, ' ') AS ws FROM lin WHERE length(text) BETWEEN 65 AND 128 AND len(string_split(text, ' ')) >= 6),
b AS (SELECT timeline_id, seq, array_to_string(list_slice(ws, 1, i), ' ') AS l1, array_to_string(list_slice(ws, i + 1, len(ws)), ' ') AS l2, ws[i] AS la, ws[i + 1] AS fi, i FROM (SELECT *, unnest(range(3, len(ws) - 2)) AS i FROM c)),
s AS (SELECT *, -abs(length(l1) - length(l2)) + """ + _close("la") + f" + CASE WHEN {_WB.format('fi')} IN ({_WEAK}) THEN 15 ELSE 0 END - CASE WHEN {_WB.format('la')} IN ({_WEAK}) THEN 25 ELSE 0 END AS gain FROM b WHERE greatest(length(l1), length(l2)) <= 64) SELECT timeline_id, seq, CAST(arg_max(i, gain * 1000 - i) AS BIGINT) AS cut FROM s GROUP BY ALL")
def pck3_balanced_split(spark, sf_dir):
    from pyspark.sql.types import LongType

    @F.udf(LongType(), useArrow=True)
    def cut(text):
        return best_break(text.split(" "), 64, cue_gain, least=3)

    c = _lined(spark, sf_dir).where(F.length("text").between(65, 128) & (F.size(F.split("text", " ")) >= 6))
    return c.select("timeline_id", "seq", cut("text").alias("cut")).where("cut is not null")


_CJK_RE = "[一-鿿㐀-䶿぀-ヿ가-힯　-〿＀-￯]"


@query(f"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS n_signs, len(regexp_extract_all(coalesce(text, ''), '{_CJK_RE}')) AS n_cjk FROM documents")
def txt15_cjk_signs(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length(F.regexp_replace(text, r"\s", "")).cast("long").alias("n_signs"), F.regexp_count(text, F.lit(_CJK_RE)).cast("long").alias("n_cjk"))


@query(LINED + " SELECT timeline_id, seq, regexp_extract(t, '^\\s*(-\\s+|\\[[^\\]]*\\]:?\\s*|[^\\s:]{1,24}:\\s+)') AS label, array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: w), ' ') AS fingerprint, list_sort(list_distinct(regexp_extract_all(text, '\\d[\\d.,:/-]*\\d|\\d'))) AS numbers FROM (SELECT *, CASE seq % 3 WHEN 0 THEN '- ' || text WHEN 1 THEN '[Ann:] ' || text ELSE 'Bob: ' || text END AS t FROM lin)")
def txt12_labels(spark, sf_dir):
    """Leading label, word fingerprint and numbers."""
    t = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("- "), "text")).when(F.col("seq") % 3 == 1, F.concat(F.lit("[Ann:] "), "text")).otherwise(F.concat(F.lit("Bob: "), "text"))
    label = F.regexp_extract(t, r"^\s*(?:-\s+|\[[^\]]*\]:?\s*|[^\s:]{1,24}:\s+)", 0)
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d[\d.,:/-]*\d|\d)"), 1)))
    return _lined(spark, sf_dir).select("timeline_id", "seq", label.alias("label"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1), " ").alias("fingerprint"), numbers.alias("numbers"))


# ------------------------------------------------------------ hashes and sinks


@query(LINED + """ SELECT timeline_id, seq, sha256('cchash/v1' || chr(10) || j) AS digest, substr(sha256('cchash/v1' || chr(10) || j), 1, 8) AS bucket FROM (SELECT timeline_id, seq, '{"end_ms":' || end_ms || ',"lines":' || CAST(to_json(lines) AS VARCHAR) || ',"speed":' || CASE WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) ELSE seq || '.5' END || ',"start_ms":' || start_ms || ',"wall":' || wall || '}' AS j FROM lin)""")
def hsh2_canonical(spark, sf_dir):
    """Canonical JSON of a cue: sorted keys, whole floats as integers, NFC."""
    speed = F.when(F.col("seq") % 2 == 0, F.col("seq").cast("double")).otherwise(F.col("seq") + F.lit(0.5))
    body = F.struct(F.col("wall"), speed.alias("speed"), "lines", "start_ms", "end_ms")
    c = _lined(spark, sf_dir).select("timeline_id", "seq", T.canonical_sha256(T.canonical_json(body)).alias("digest"))
    return c.withColumn("bucket", F.substring("digest", 1, 8))


@query("""SELECT conv_id, turn, 'ccexp:' || sha256('cchash/v1' || chr(10) || '{"actor_email":"a@b.co","actor_id":"' || conv_id || '","client_action_id":"' || turn || '","format":"srt","format_run_id":"","issue_codes":["A","B"],"override":' || (turn % 2 = 0) || ',"override_reason":"' || lower(role) || '","project_id":"' || conv_id || '","schema":"ccexp","spec_slug":"x","spec_version":' || turn || ',"v":1}') AS key FROM conversations""")
def hsh9_export_key(spark, sf_dir):
    key = T.export_action_key(
        project_id=F.col("conv_id"), format_run_id=F.lit(None), format=F.lit(" SRT "), spec_slug=F.lit("x"), spec_version=F.col("turn"), override=F.col("turn") % 2 == 0, override_reason=F.concat(F.lit(" "), F.upper("role")),
        issue_codes=F.array(F.lit("B"), F.lit("A"), F.lit("B")), actor_id=F.col("conv_id"), actor_email=F.lit("A@b.co "), client_action_id=F.col("turn"),
    )
    return ship(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", key.alias("key"))


_TT = "replace({0}, ',', '.')"


@query(LINED + f""" SELECT timeline_id, '<tt>' || string_agg('<p begin="' || {_TT.format(_srt('start_ms'))} || '" end="' || {_TT.format(_srt('end_ms'))} || '" region="bottom" style="default">' || array_to_string(list_transform(lines, lambda x: replace(x, 'the', '<span tts:fontStyle="italic">the</span>')), '<br/>') || '</p>', '' ORDER BY seq) AS body FROM lin GROUP BY timeline_id""")
def snk4_ttml(spark, sf_dir):
    c = _lined(spark, sf_dir).withColumn("lines", N.italicized(F.col("lines"), ["the"]))
    rows = F.regexp_extract_all("document", F.lit("(?m)^      (<p .*</p>)$"), 1)
    return sinks.ttml(c).select("timeline_id", F.concat(F.lit("<tt>"), F.array_join(rows, "")).alias("body"))


# ------------------------------------------------------------------- windows


@query(LINED + """, w AS (SELECT *, coalesce(wall OR speaker <> lag(speaker) OVER o OR type <> 'dialogue' OR lag(type) OVER o <> 'dialogue', true) AS opens FROM lin WINDOW o AS (PARTITION BY timeline_id ORDER BY seq)),
x AS (SELECT *, sum(opens::INT) OVER (PARTITION BY timeline_id ORDER BY seq) AS win FROM w)
SELECT timeline_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_cues FROM x WHERE type = 'dialogue' GROUP BY timeline_id, win""")
def opt1_windows(spark, sf_dir):
    return O.speaker_windows(_lined(spark, sf_dir)).groupBy("timeline_id", "window_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_cues")).drop("window_id")


@query(LINED + """, r AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY timeline_id) AS n FROM lin), f AS (SELECT timeline_id, greatest(0, i - 2) AS a, least(n, i + 3) AS b FROM r WHERE end_ms - start_ms < 800),
g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY timeline_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM f),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY timeline_id ORDER BY a, b) AS isle FROM g) SELECT timeline_id, min(a) AS from_cue, max(b) AS to_cue FROM h GROUP BY timeline_id, isle""")
def opt2_repair_windows(spark, sf_dir):
    c = _lined(spark, sf_dir)
    return O.repair_windows(c.withColumn("failed", F.col("end_ms") - F.col("start_ms") < 800))


# ---------------------------------------------------- folds: golden cases in tests


@query()
def pck1_cues(spark, sf_dir):
    return _written(_packed(spark, sf_dir))


@query()
def rdb5_readable(spark, sf_dir):
    return _written(Q.each(_packed(spark, sf_dir), Q.readability))


@query()
def cps6_speed_rules(spark, sf_dir):
    return _written(Q.each(_packed(spark, sf_dir), Q.speed_rules))


@query()
def shp1_shaped(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return _written(Q.each(O.with_timings(_packed(spark, sf_dir), t), shaping.shape))


@query()
def shp2_fitted(spark, sf_dir):
    return _written(Q.each(_packed(spark, sf_dir, Spec(max_chars=42)), shaping.fit_lines, Spec(max_chars=20)))


@query()
def grd1_on_grid(spark, sf_dir):
    return _written(Q.each(_packed(spark, sf_dir), Q.to_grid, Spec(frame_num=30000, frame_den=1001)))


@query()
def cap1_capitalized(spark, sf_dir):
    return _written(Q.each(_packed(spark, sf_dir), P.capitalize))


@query()
def lbl1_labels(spark, sf_dir):
    return _written(Q.each(_packed(spark, sf_dir, Spec(label_mode="alpha")), P.suppress_labels, Spec(label_mode="alpha")))


@query()
def cnd1_condensed(spark, sf_dir):
    return _written(Q.each(_packed(spark, sf_dir), P.condense, Spec(max_cps=15)))


@query()
def trp1_repaired(spark, sf_dir):
    long = F.when(F.col("pos") % 13 == 0, F.col("end_ms") + 3000 + F.col("pos") * 10).otherwise(F.col("end_ms"))
    return P.repair(_tokens(spark, sf_dir).withColumn("end_ms", long))


@query()
def txt9_disfluencies(spark, sf_dir):
    return _lined(spark, sf_dir).select("timeline_id", "seq", speech.text_column(F.col("text"), speech.remove_disfluencies).alias("text"))


@query()
def opt9_optimized(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return _written(Q.each(O.with_timings(_packed(spark, sf_dir), t), optimizer.optimize))


@query()
def opt9_decisions(spark, sf_dir):
    return optimizer.decision_table(O.with_timings(_packed(spark, sf_dir), _tokens(spark, sf_dir)))


@query()
def formatted_timelines(spark, sf_dir):
    """The whole chain of passes over packed cues, as subtitle text."""
    t = _tokens(spark, sf_dir)
    cues = Q.each(O.with_timings(_packed(spark, sf_dir), t), chain.format_cues)
    return sinks.srt(cues.select("timeline_id", "seq", "start_ms", "end_ms", F.array_join("lines", "\n").alias("text")))


# ------------------------------------------------------------- more of the inventory


@query(GROUPS + """, w AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY pos) AS n FROM gt),
d AS (SELECT timeline_id, group_id, min(n) - 1 AS source_word_start, max(n) AS source_word_end, arg_min(utt, pos) AS source_utterance_id, arg_min(hard, pos) AS hard_before, min(CASE WHEN hard THEN start_ms - before END) AS gap_before_ms, min(CASE WHEN hard THEN utt0 END) AS prev_utterance_id, count(start_ms) = 0 AS timing_unresolved FROM w GROUP BY ALL)
SELECT *, CASE WHEN hard_before THEN 1200 END AS effective_pause_boundary_ms FROM d""")
def seg2_pauses(spark, sf_dir):
    g = S.described_groups(_tokens(spark, sf_dir))
    return g.select("timeline_id", "group_id", "source_word_start", "source_word_end", "source_utterance_id", "hard_before", "gap_before_ms", "prev_utterance_id", "timing_unresolved", "effective_pause_boundary_ms")


@query(UTTS + """, f AS (SELECT timeline_id, row_number() OVER (PARTITION BY timeline_id ORDER BY utt) AS utt, start_ms, CASE WHEN end_ms > start_ms THEN end_ms ELSE start_ms + 1 END AS end_ms, regexp_extract_all(text, '\\[[^\\]]+\\]') AS tags FROM utts WHERE trim(text) <> ''),
x AS (SELECT timeline_id, utt, start_ms, end_ms, greatest(1, greatest(1, end_ms - start_ms) // len(tags)) AS share, unnest(tags) AS tag, unnest(range(len(tags))) AS k FROM f WHERE len(tags) > 0)
SELECT timeline_id, utt, CAST(k AS INT) AS k, upper(trim(tag)) AS text, start_ms + k * share AS start_ms, greatest(start_ms + k * share + 1, least(end_ms, start_ms + k * share + share)) AS end_ms FROM x""")
def nrm12_srt_sounds(spark, sf_dir):
    return N.srt_sound_tokens(N.parse_srt(N.backbone(_utts(spark, sf_dir))))


@query(TOKENS + """, u AS (SELECT timeline_id, utt, min(start_ms) AS a, max(end_ms) AS b, string_agg(text, ' ' ORDER BY pos) AS t FROM tok WHERE utt = 0 GROUP BY ALL HAVING min(start_ms) IS NOT NULL),
w AS (SELECT timeline_id, a, b, unnest(string_split(t, ' ')) AS text, unnest(range(len(string_split(t, ' ')))) AS pos FROM u),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY timeline_id ORDER BY pos) AS upto, sum(length(text)) OVER (PARTITION BY timeline_id) AS total FROM w)
SELECT timeline_id, CAST(pos AS INT) AS pos, text, CAST(a + (b - a) * (upto - length(text)) // total AS BIGINT) AS start_ms, CAST(a + (b - a) * upto // total AS BIGINT) AS end_ms FROM s""")
def src10_proportional(spark, sf_dir):
    t = _tokens(spark, sf_dir).where("utt = 0")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    u = t.groupBy("timeline_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), listed.alias("text")).where("start_ms is not null")
    return N.proportional_words(u)


@query(LINED + """, t AS (SELECT timeline_id, seq, start_ms, end_ms, '[SPEAKER ANN:] ' || lines[1] AS txt FROM lin WHERE len(lines) = 1),
q AS (SELECT *, greatest(0, end_ms - start_ms) AS lasts, lead(start_ms) OVER (PARTITION BY timeline_id ORDER BY seq) AS after, length(txt) AS n, length(txt) - 15 AS m FROM t),
r AS (SELECT *, CASE WHEN lasts > 0 THEN n / (lasts / 1000.0) ELSE 'inf'::DOUBLE END AS c1, CASE WHEN lasts > 0 THEN m / (lasts / 1000.0) ELSE 'inf'::DOUBLE END AS c0, least(start_ms + CAST(floor(n / 17 * 1000) AS BIGINT) + 1, coalesce(after - 80, start_ms + CAST(floor(n / 17 * 1000) AS BIGINT) + 1)) AS later FROM q)
SELECT timeline_id, seq, 'SPEAKER_LABEL_CAUSED_CPS_FAILURE' AS issue_code, CASE WHEN later > end_ms AND n / ((later - start_ms) / 1000.0) <= 17 THEN 'resolved' ELSE 'unresolved' END AS result FROM r WHERE c0 <= 17 AND c1 > 17
UNION ALL SELECT timeline_id, seq, 'SPEAKER_LABEL_CAUSED_CPL_FAILURE', 'resolved' FROM r WHERE m <= 24 AND n > 24""")
def qcs4_label_impact(spark, sf_dir):
    c = _lined(spark, sf_dir).where(F.size("lines") == 1).withColumns({"lines": F.array(F.concat(F.lit("[SPEAKER ANN:] "), F.col("lines")[0])), "label": F.lit("Ann")})
    return quality.issues(c, label="label", max_cpl=24).where("issue_code like 'SPEAKER_LABEL%'").select("timeline_id", "seq", "issue_code", "result")


@query(TOKENS + """, r AS (SELECT conv_id AS timeline_id, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id)
SELECT t.timeline_id, t.pos, r.n FROM tok t LEFT JOIN r ON r.timeline_id = t.timeline_id AND r.n > 1 WHERE lower(t.text) IN ('a', 'an', 'the')""")
def jn4_lookup(spark, sf_dir):
    """Membership in a small constant set, then an equi lookup."""
    r = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("timeline_id")).agg(F.countDistinct("role").alias("n")).where("n > 1")
    return _tokens(spark, sf_dir).where(F.lower("text").isin("a", "an", "the")).select("timeline_id", "pos").join(r, "timeline_id", "left")


@query()
def nrm17_caption_inputs(spark, sf_dir):
    return N.caption_inputs(_utts(spark, sf_dir), _tokens(spark, sf_dir))[1]


@query()
def nrm28_result_cues(spark, sf_dir):
    c = N.result_cues(_packed(spark, sf_dir), lambda s: F.concat(F.lit("SPEAKER "), F.upper(F.substring(s, 1, 1))))
    return c.withColumns({"lines": F.array_join("lines", "|"), "speaker_segments": F.to_json("speaker_segments")})


@query()
def agg12_repair_summary(spark, sf_dir):
    return P.repair_summary(trp1_repaired(spark, sf_dir))


@query()
def agg16_decision_keys(spark, sf_dir):
    return optimizer.key_summary(opt9_decisions(spark, sf_dir))


@query()
def snk5_job_results(spark, sf_dir):
    c = _packed(spark, sf_dir)
    shown = c.select("timeline_id", "seq", "start_ms", "end_ms", "type", "lines")
    flat = c.select("timeline_id", "seq", "start_ms", "end_ms", F.array_join("lines", "\n").alias("text"))
    return N.job_results(shown, sinks.srt(flat), quality.rollup(quality.issues(c, max_cps=45)))

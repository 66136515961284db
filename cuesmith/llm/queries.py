"""The queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.llm import decontam, huffman, lang_crf, ngram_join, packing, reply_trees, surrogates, topk, toxicity, url_rules
from cuesmith.llm.common import held_out, staged, table
from cuesmith.session import ship


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    found = lang_crf.label(docs, lang_crf.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(ship(spark), sf_dir, "documents"), capacity=1024, end_id=2, keep_ids=False)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(ship(spark), sf_dir, "documents"), n=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(ship(spark), sf_dir, "documents"), end_id=0)


#: The contract's rules: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(ship(spark), sf_dir, "pages"), rules, default="allow")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(ship(spark), sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: What the contract adds to ``conversations``.
EXTRA_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    """Digests of formatted conversations, from the formatted string and its loss spans alone."""
    for batch in batches:
        out = []
        for tree, formatted, spans in zip(*(batch.column(n).to_pylist() for n in ("tree", "formatted", "spans"))):
            turns = reply_trees.parse(formatted)
            loss = "".join(reply_trees.unescape(formatted[s["start"] : s["end"]]) for s in spans)
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            out.append((tree, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        names = [c.split()[0] for c in READ_BACK.split(", ")]
        kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(ship(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(EXTRA_TURNS, turns.schema))
    nodes = reply_trees.chain(turns)
    return reply_trees.conversations(staged(nodes, "turns")).select("tree", "formatted", "spans").mapInArrow(_read_back, READ_BACK)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, key="surrogates")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_url_filter, op4_ngram_jaccard, op5_decontamination, op6_token_files, op7_exact_top_k, op8_toxicity, op9_chat_format, op10_pii_surrogates)}
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p
), q AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM s
), r AS (
  SELECT *, '.' || host AS dotted FROM q
)
SELECT page_id, host, path,
  CASE WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN dotted LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
       WHEN dotted LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN dotted LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
  CASE WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'allow'
       WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'block'
       WHEN dotted LIKE '%.net' AND (path LIKE '/es/%' OR path LIKE '/fr/%') THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, list_slice(w, k, k + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM i), o AS (
  SELECT doc_id, k, m, list_slice(w, k, k + m - 1) AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths WHERE len(w) >= m)
), f AS (SELECT o.doc_id, o.k, o.m, i.item_id FROM o JOIN i USING (m, g)), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM f) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM f) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 3 WHEN 'assistant' THEN 3 ELSE 5 + 2 * strlen(role) END AS mark,
         len(text) + len(text) - len(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?(INST|OUT|SYS)\]|\[/?ROLE=')) AS size FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + 2 * mark + 14) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
}

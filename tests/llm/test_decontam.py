"""Decontamination against plain Python: odd rows, short shards, a benchmark in parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuesmith.llm import decontam
from cuesmith.session import ship

LOWER = {k: k + 32 for k in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for name, phrase in items:
            p = words(phrase)
            m = min(window, len(p))
            for k in range(len(p) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == p[k : k + m]:
                        hit |= set(range(i, i + m))
                        found.add(name or "")
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["Äpfel", "x1"]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 10, 14, 30])))) for k in range(25)] + [("i1", "w1 w2"), (None, "w3 w4 w5"), ("empty", ""), ("none", None), ("i2", "w9")]
    docs = [(1, None), (2, ""), (3, "w1"), (3, "w1"), (None, "W3-w4, w5!"), (4, "aé " * 30)]
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 60))
        phrase = rng.choice(items)[1] or ""
        docs.append((10 + k, rng.choice([" ", ", ", "\n"]).join(w + phrase.upper().split(" ") + w[::-1])))
    return docs, items


@pytest.mark.parametrize("part, shard", [(8 << 20, (2 << 20) - 1), (200, 300)])
def test_equals_plain_search(spark, monkeypatch, part, shard):
    monkeypatch.setattr(decontam, "PART_BYTES", part)
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    ship(spark)
    docs, items = cases(part)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_ids", F.lit(1)).withColumn("_row", F.lit(2))
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit("x"))
    got = decontam.scan(table, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=str) == plain(docs, items)
    cut = decontam.remove(table, bench)
    assert cut.columns == table.columns
    left = sorted(((r.doc_id, len(words(r.text))) for r in cut.collect()), key=str)
    assert left == sorted(((d, n - hit) for d, n, hit, _ in plain(docs, items)), key=str)
    clean = {r.doc_id: r.text for r in cut.collect()}
    assert clean[1] is None and clean[2] == "" and clean[4] == "aé " * 30


@pytest.mark.parametrize("text, item, n", [("x a b y", "a b", 2), ("a", "a", 1), ("a a a", "a", 3), ("b", "a", 0), ("a b c d e f g h i j k", "b c d e f g h i j k", 10)])
def test_short_shards(spark, text, item, n):
    ship(spark)
    (row,) = decontam.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    assert row.n_hit == n


def test_empty_tables(spark):
    ship(spark)
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert decontam.scan(docs.limit(0), bench).count() == 0 and decontam.remove(docs.limit(0), bench).count() == 0
    assert decontam.scan(docs, bench.limit(0)).first().n_hit == 0 and decontam.remove(docs, bench.limit(0)).first().text == "a b"

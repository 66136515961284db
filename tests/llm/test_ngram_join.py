"""The n-gram join against all pairs in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cuesmith.llm import ngram_join
from cuesmith.session import ship

SPACE = " \t\n\x0b\x0c\r"
LOWER = {k: k + 32 for k in range(65, 91)}


def plain(rows, n=5, percent=80):
    """(doc_id, n_shingles, component_id) by comparing every two texts."""
    sets = []
    for _, text in rows:
        words = "".join(" " if c in SPACE else c for c in (text or "").translate(LOWER)).split(" ")
        words = [w for w in words if w]
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    part = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= percent * len(s | t) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    least = {}
    for p, (doc, _) in zip(part, rows):
        least[p] = min(least.get(p, doc), doc)
    return sorted((doc, len(s), least[p]) for p, s, (doc, _) in zip(part, sets, rows))


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = []
    for length, edits, count in ((60, 3, 60), (120, 5, 60), (14, 1, 20)):
        base = rng.choices(vocabulary, k=length)
        for _ in range(count):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(length)] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(40)]
    texts += [None, "", " \t ", "one", "ONE", "one two", "é one", "a a a a a a a a", texts[0], texts[0].upper().replace(" ", "\n")]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, small, tile, waves", [(1, 12, 1024, (8, 64, None)), (2, 3, 16, (1, 2, None))])
def test_equals_all_pairs(spark, monkeypatch, seed, small, tile, waves):
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", small)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "WAVES", waves)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("hub", F.lit(1))
    ship(spark)
    got = sorted(tuple(r) for r in ngram_join.similar(docs).select("doc_id", "n_shingles", "component_id").collect())
    want = plain(rows)
    assert len({r[2] for r in want}) < len(rows) - 50
    assert got == want


def test_empty_table(spark):
    ship(spark)
    assert ngram_join.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0

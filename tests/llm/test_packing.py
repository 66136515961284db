"""Packing against the optimum of small cases, the area bound, and the library's ids."""

import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuesmith.llm import bpe, packing
from cuesmith.session import ship


def fewest(pieces, capacity):
    """The least number of sequences, by trying every place."""

    @lru_cache(None)
    def pack(left, room):
        if not left:
            return 0
        piece, rest = left[0], left[1:]
        best = 1 + pack(rest, tuple(sorted([*room, capacity - piece])))
        for i, r in enumerate(room):
            if r >= piece and (i == 0 or room[i - 1] != r):
                best = min(best, pack(rest, tuple(sorted([*room[:i], r - piece, *room[i + 1 :]]))))
        return best

    return pack(tuple(sorted(pieces, reverse=True)), ())


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_near_the_optimum(seed):
    rng = np.random.default_rng(seed)
    pieces = rng.integers(1, 13, rng.integers(1, 10)).tolist()
    got = int(packing.plan(np.bincount(pieces, minlength=13), 12)["sequences"])
    assert fewest(pieces, 12) <= got <= fewest(pieces, 12) + 1


@pytest.mark.parametrize("seed", range(3))
def test_plan_meets_the_area_bound(seed):
    rng = np.random.default_rng(seed)
    count = np.zeros(1025, np.int64)
    lengths = np.clip(rng.lognormal(5, 1, 4000).astype(int), 1, 1024)
    np.add.at(count, lengths, 1)
    bound = -(-int((count * np.arange(1025)).sum()) // 1024)
    x = packing.fractional(count, 1024)
    assert bound - 1 <= sum(x.values()) <= bound + 2
    assert bound <= packing.plan(count, 1024)["sequences"] <= bound + 1


def test_program_covers_every_length():
    count = np.array([0, 3, 0, 5, 1, 0, 2])
    x = packing.fractional(count, 6)
    held = np.zeros(7)
    for config, amount in x.items():
        assert sum(n * k for n, k in config) <= 6
        for n, k in config:
            held[n] += k * amount
    assert np.allclose(held, count)
    assert not packing.fractional(np.zeros(7, int), 6) and packing.plan(np.zeros(7, int), 6)["sequences"] == 0


def test_places_and_ids_of_odd_rows(spark):
    ship(spark)
    a, b = ("".join("ab"[bin(k).count("1") % 2 ^ flip] for k in range(2048)) for flip in (0, 1))
    texts = ["the cat", None, "", a, b, "word " * 2600, "naïve 漢字 🙂", "the cat", "x " * 511]
    rows = [(i if i != 2 else None, t, 7) for i, t in enumerate(texts)] + [(50, "same text", 7)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").withColumn("sequence_id", F.lit("x"))
    out = packing.pack(docs, capacity=1024, end_id=2).collect()
    whole = Tokenizer.from_file(bpe.default_path())
    want = []
    for doc, text, _ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        edges = [0, *range(head, len(ids) + 1, 1024)]
        want += [(doc, k, p, q - p, zlib.crc32(np.array(ids[p:q], "<u4").tobytes()), ids[p:q]) for k, (p, q) in enumerate(zip(edges, edges[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in out), key=str) == sorted(want, key=str)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist() and sum(n for _, n in places) <= 1024
    assert len(held) <= sum(packing.best_fit(np.bincount([len(w[5]) for w in want], minlength=1025), 1024).values())
    assert packing.pack(docs.limit(0)).count() == 0

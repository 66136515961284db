"""Token files: code lengths and codes against brute force, files against the library."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuesmith.llm import bpe, huffman
from cuesmith.llm.common import new_path


def best_cost(weight, limit):
    """The least total over all lengths that a prefix code can have."""
    return min(sum(w * n for w, n in zip(weight, lengths)) for lengths in itertools.product(range(1, limit + 1), repeat=len(weight)) if sum(2.0**-n for n in lengths) <= 1)


@pytest.mark.parametrize("limit", [3, 4, 6])
@pytest.mark.parametrize("seed", range(5))
def test_code_lengths_are_optimal(limit, seed):
    rng = np.random.default_rng(seed)
    weight = np.concatenate([rng.integers(1, 200, rng.integers(2, 6)), [0, 0]])
    rng.shuffle(weight)
    bits = huffman.code_lengths(weight, limit)
    used = weight > 0
    assert (bits[~used] == 0).all() and bits.max() <= limit and (2.0 ** -bits[used].astype(float)).sum() <= 1
    assert (weight * bits).sum() == best_cost(weight[used].tolist(), limit)
    codes = {format(int(c), f"0{n}b") for c, n in zip(huffman.canonical(bits)[used], bits[used])}
    assert len(codes) == used.sum() and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_one_id_and_too_many():
    assert huffman.code_lengths(np.array([0, 5, 0]), 4).tolist() == [0, 1, 0] and not huffman.code_lengths(np.zeros(3, int), 4).any()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


def test_files_give_back_the_library_ids(spark, monkeypatch):
    monkeypatch.setattr(huffman, "RANGE_IDS", 3000)  # several ranges
    rng = np.random.default_rng(2)
    a, b = ("".join("ab"[bin(k).count("1") % 2 ^ flip] for k in range(2048)) for flip in (0, 1))  # equal polynomial hashes
    texts = ["the cat", None, "", a, b, "word " * 3000, "naïve Ωmega 漢字 🙂", "the cat", " \n\t ", "x" * 5000]
    rows = [(int(i), t, "s") for t in texts for i in rng.integers(0, 6, 3)] + [(None, "the cat", "s"), (7, "same", "s")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("shard", F.lit(1))
    whole = Tokenizer.from_file(bpe.default_path())
    path = huffman.write(docs, new_path(spark, "files"), end_id=0)
    got = huffman.read(spark, path).orderBy("start").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.ids) for r in got), key=str) == sorted(((d is None, d or 0, [*whole.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows), key=str)
    assert [r.start for r in got] == np.cumsum([0, *[len(r.ids) for r in got[:-1]]]).tolist()
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys)
    digests = sorted((r.start, r.n_tokens, r.ids_crc32) for r in huffman.read_digests(spark, path).collect())
    assert digests == [(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got]


def test_empty_table(spark):
    assert huffman.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0

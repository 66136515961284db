"""The descent of two count-vector R-trees against every pair of points."""

import numpy as np
import pytest

from cuesmith.llm import ngram_join


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("n, m", [(1, 1), (33, 7), (150, 97), (300, 0)])
def test_tree_join_equals_all_pairs(seed, n, m):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, (5, ngram_join.GROUPS))

    def points(k):
        p = np.maximum(0, base[rng.integers(0, 5, k)] + rng.integers(-1, 2, (k, ngram_join.GROUPS)) * (rng.random((k, ngram_join.GROUPS)) < 0.2)).astype(np.int32)
        return p, p.sum(1), rng.integers(0, 6, k)

    p, size, part = points(n)
    left = ngram_join.RTree(p, size, part)
    q, q_size, q_part = points(m) if m else (p, size, part)
    right = ngram_join.RTree(q, q_size, q_part) if m else left
    a, b, _ = ngram_join.tree_join(left, right, 80)
    bound = np.minimum(p[:, None], q[None]).sum(2)
    ok = ngram_join.may_link(bound, size[:, None] + q_size[None], 80) & (part[:, None] != q_part[None])
    want = set(zip(*(x.tolist() for x in np.nonzero(ok))))
    got = list(zip(a.tolist(), b.tolist()))
    if m:
        assert set(got) == want and len(got) == len(want)
    else:
        assert len(got) == len(set(got)) and set(got) | {(y, x) for x, y in got} == want


def test_ranks():
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    ranks = ngram_join.Ranks(shingles[:1000], np.arange(1000) % 9 + 2)
    assert (ranks.of(shingles)[:1000] == np.minimum(np.arange(1000) % 9 + 2, 7)).all() and not ranks.of(shingles)[1000:].any()
    assert not ngram_join.Ranks(shingles[:0], np.zeros(0, int)).of(shingles).any()

"""Reply trees with branches, orphans and circles against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cuesmith.llm import reply_trees

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def plain(nodes, keep):
    """(tree, leaf, messages) of the best branches of each root."""
    by = {(n[0], n[1]): n for n in nodes}
    up = {k: (k[0], n[2]) if n[2] is not None and (k[0], n[2]) in by else None for k, n in by.items()}
    inner, found = set(up.values()), {}
    for k in by:
        path, at = [], k
        while at is not None and len(path) <= len(by):
            path.append(at)
            at = up[at]
        if at is None and k not in inner:
            scores = [by[p][5] or 0.0 for p in path]
            found.setdefault(path[-1], []).append((-sum(scores) / len(scores), -len(path), k[1], path[::-1]))
    return sorted((root[0], x[2], [(by[p][3] or "", by[p][4] or "") for p in x[3]]) for root, xs in found.items() for x in sorted(xs)[:keep])


@pytest.mark.parametrize("keep", [1, 2, 100])
def test_branches_equal_plain_walk(spark, keep):
    rng = random.Random(keep)
    nodes = []
    for tree in range(12):
        for node in range(rng.randrange(1, 25)):
            parent = rng.choice([None, *range(node), 999]) if rng.random() < 0.3 else (node - 1 if node else None)
            nodes.append((tree, node, parent, rng.choice(["user", "assistant", "system", "tool]", None]), rng.choice(["a", "[/INST]", "\\", "</s>", "", None]), rng.choice([0.0, 0.25, 0.5, 1.0, None])))
    nodes += [(50, 1, 2, "user", "circle", 1.0), (50, 2, 1, "assistant", "circle", 1.0), (50, 3, 2, "user", "hangs", 1.0), (50, 4, None, "user", "alone", 0.0)]
    table = spark.createDataFrame(nodes, SCHEMA).withColumn("root", F.lit("x")).withColumn("pos", F.lit(1))
    got = reply_trees.conversations(table, keep).collect()
    assert sorted((r.tree, r.leaf, reply_trees.parse(r.formatted)) for r in got) == plain(nodes, keep)
    for r in got:
        said = [text for role, text in reply_trees.parse(r.formatted) if role == "assistant"]
        assert [reply_trees.unescape(r.formatted[s.start : s.end]) for s in r.spans] == said and r.n_turns == len(reply_trees.parse(r.formatted))


def test_all_paths(spark):
    nodes = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "a", "x", 0.0), (1, 3, 1, "a", "y", 0.0), (1, 4, 3, "a", "z", 0.0)]
    got = sorted((r.leaf, r.pos, r.node) for r in reply_trees.paths(spark.createDataFrame(nodes, SCHEMA)).collect())
    assert got == [(2, 0, 1), (2, 1, 2), (4, 0, 1), (4, 1, 3), (4, 2, 4)]


def test_empty_and_long(spark):
    assert reply_trees.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(1, k, k - 1 if k else None, "user", "t" * 5000, None) for k in range(70)]
    (row,) = reply_trees.conversations(spark.createDataFrame(long, SCHEMA)).collect()
    assert row.n_turns == 70 and len(reply_trees.parse(row.formatted)) == 70

"""Top-k search and URL rules on odd rows, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cuesmith.llm import topk, url_rules
from cuesmith.llm.queries import URL_RULES
from cuesmith.session import ship


@pytest.mark.parametrize("shard, tile, fan", [(4096, 1024, 16), (7, 3, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, tile, fan):
    for name, value in (("SHARD", shard), ("TILE", tile), ("FAN_IN", fan)):
        monkeypatch.setattr(topk, name, value)
    ship(spark)
    rng = random.Random(shard)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(20, [1.0, 1.0, 1.0, 1.0]), (40, None), (60, [1.0, None, 0.0, 1.0]), (80, [math.nan, 0.0, 0.0, 0.0]), (100, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (200, [1.0, 2.0]), (210, [3.0, -1.0]), (3, [9.0] * 4), (3, [9.0] * 4), (220, [1e9] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("block", F.lit("x"))
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, (q, v) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(good) if j != k and len(w) == len(v))
            want += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:5], 1)]
    got = topk.top_k(vectors, k=5, every=20)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert topk.top_k(vectors.limit(0), k=5, every=20).count() == 0


def plain(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if v in ("allow", "block") and h is not None and p is not None and f".{host}".endswith(f".{h}") and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else default


ODD = [None, "", "no scheme", "http://", "http://COM", "HTTP://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://xexample.com/en/", "ftp://a.net/es/q", "http://net/fr/", "http://net.net.net/fr", "x://É.com/ü", "http://com/?/en/", "a://b://c.com/", "http://example.com#/en/", "http://.com/", "http://com./", "http://user@example.com:80/en/", "http://example.com/en/" + "a" * 5000]


def test_urls_equal_plain_rules(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(5, ODD[5])] * 3 + [(None, "http://a.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1)).withColumn("short", F.lit(2))
    extra = [*URL_RULES, ("com", "/", "block"), ("net", "", "maybe"), (None, "/", "allow"), ("example.com", "/en/x", "allow")]
    for rules in (URL_RULES, extra, []):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = url_rules.judge(pages, table, default="allow")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *plain(u, rules, "allow")) for i, u in rows), key=str)
    assert url_rules.judge(pages.limit(0), table).count() == 0

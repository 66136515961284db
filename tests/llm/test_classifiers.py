"""Toxicity: held-out quality, odd rows, and what a model may see."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cuesmith.llm import lang_crf, toxicity
from cuesmith.llm.common import ALNUM_WORDS, Words, bounded_sample, held_out, text_chunks
from cuesmith.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = QUERIES["op8_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    y, s, p = (np.array([r[k] for r in got], float) for k in ("toxic", "score", "predicted"))
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert ((s >= 0) & (s <= 1)).all() and (p == (s >= 0.7)).all()
    assert auc > 0.85 and (p[y == 0] == 0).mean() > 0.97


def test_pooling_equals_plain_loops():
    rng = np.random.default_rng(1)
    words = "good kind bad vile calm mean sweet rude".split()
    texts = [" ".join(rng.choice(words, 12)) for _ in range(120)]
    model = toxicity.Model(texts, np.array([float("vile" in t) for t in texts]), ["en"] * 120)
    lists = [rng.integers(0, len(model.e), n) for n in (0, 1, 2, 3, 9)]
    first = np.cumsum([0, *map(len, lists)])
    got = model.raw(np.concatenate(lists), first)
    for ids, x in zip(lists, got):
        pooled = []
        for k in toxicity.WIDTHS:
            r = [sum(model.e[ids[i + j]] @ model.w[k][j] for j in range(k)) for i in range(len(ids) - k + 1)]
            pooled.append(np.maximum(np.max(r, 0) + model.b[k], 0) if r else np.zeros(toxicity.FILTERS))
        assert np.isclose(np.concatenate(pooled) @ model.u + model.c, x, atol=1e-4)


def test_calibration_sees_other_words_than_training():
    texts = [f"shared own{i}" for i in range(100)]
    model = toxicity.Model(texts, np.array([float(i % 3 == 0) for i in range(100)]), ["en"] * 100)
    assert len(model.words) == 1  # words of one text alone are not learned, nor those of texts kept apart


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en"), (2, None, None), (3, "", "en"), (None, "a " * 300_000, "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    rows = [(i, ("vile " if i % 4 == 0 else "kind ") + f"text number {i % 7}", "en") for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(4, 0), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(many, labels)
    got = {r.doc_id: r.score for r in toxicity.score(many, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(400))
    kept = toxicity.reject(many.withColumn("score", F.lit("s")), model)
    assert kept.columns == [*many.columns, "score"] and sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 4]
    assert toxicity.reject(many.limit(0), model).count() == 0 and len(toxicity.score(docs, model).collect()) == 5


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(7, "x" * 50, "en")] * 500 + [(i, f"text {i}", "en") for i in range(500)] + [(1, "y" * 5000, "en")], "doc_id long, text string, lang string")
    got = bounded_sample(docs, 100, 1000).collect()
    assert 0 < len(got) <= 100 and all(len(r.text) <= 1000 for r in got)
    assert docs.where(held_out()).count() < docs.count()
    tagger = lang_crf.fit(docs, most=50)
    assert tagger.names == ["en"]


def _hashes(word):
    return Words(*next(text_chunks(pa.array([word])))[2:], ALNUM_WORDS).hash


def test_every_labelled_text_is_learned_from(spark):
    """More texts than a former sample held, and texts longer than it took: each word that two learning texts have is known."""
    ids = spark.range(20000).withColumnRenamed("id", "doc_id").where(~held_out()).withColumn("apart", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4)
    ids = [(r.doc_id, r.apart) for r in ids.orderBy("apart", "doc_id").collect()]
    texts = [(d, f"pair{k // 2} " + ("vile" if k // 2 % 10 == 0 else "kind") + (" z" * 40_000 if k < 2 else ""), "en") for k, (d, _) in enumerate(ids)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.col("text").contains("vile").cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    learn = [t for (_, t, _), (_, apart) in zip(texts, ids) if not apart]
    assert len(learn) > 10_000
    want = {f"pair{k}" for k in range(len(learn) // 2)} | {"vile", "kind", "z"}
    assert len(model.words) == len(want) and (model.index(np.concatenate([_hashes(w) for w in want])) > 0).all()
    assert {r.toxic for r in toxicity.score(docs, model).join(labels, "doc_id").where("(score >= 0.7) <> (toxic = 1)").collect()} == set()


def test_units_and_shared_rows_whatever_the_layout(spark, monkeypatch):
    """Several units and rows of several words: the same scores from rows in any order, and right ones."""
    monkeypatch.setattr(toxicity, "UNIT_TEXTS", 150)
    rows = [(i, ("vile " if i % 4 == 0 else "kind ") + f"text number {i % 7} own{i % 300}", "en" if i % 3 else "de") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    for most in (toxicity.ROWS, 128):
        got = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(d, k, rows=most)).collect()} for d, k in ((docs, labels), (docs.orderBy(F.rand(3)).repartition(11), labels.repartition(3)))]
        assert len(got[0]) == 1500 and all(np.isclose(got[0][i], got[1][i], atol=1e-6) for i in got[0])
        assert sum((got[0][i] >= 0.7) == (i % 4 == 0) for i in got[0]) >= (1500 if most > 128 else 1450)


def test_means_counts_and_cuts_equal_plain_loops():
    rng = np.random.default_rng(3)
    steps, n = rng.integers(-50, 50, 40), rng.integers(1, 9, 40)
    t = rng.integers(0, n + 1)
    cut = toxicity._best_threshold(steps, n, t, None) * toxicity.STEPS
    f1 = [2 * t[steps >= s].sum() / (n[steps >= s].sum() + t.sum()) for s in range(-51, 51)]
    assert np.isclose(2 * t[steps >= cut].sum() / (n[steps >= cut].sum() + t.sum()), max(f1))
    size, rows, sums, weight = 1000, {}, np.zeros((1000, toxicity.DIM + 1)), np.zeros(1000)
    for unit in range(3):
        at, texts = np.unique(rng.integers(0, size, 300)), unit + 2
        change = rng.normal(0, 1, (len(at), toxicity.DIM + 1)).astype("<f4")
        sums[at] += texts * change
        weight[at] += texts
        for k in range(toxicity.SLICES):
            own = at * toxicity.SLICES // size == k
            rows.setdefault(k, []).append({"slice": k, "texts": texts, "rows": at[own].astype("<i4").tobytes(), "change": change[own].tobytes()})
    got = np.zeros_like(sums)
    for k, changes in rows.items():
        mean = toxicity._Mean(k, size)
        for row in changes:
            mean.add(row)
        out = mean.batch().to_pylist()[0]
        got[np.frombuffer(out["rows"], "<i4")] = np.frombuffer(out["change"], "<f4").reshape(-1, toxicity.DIM + 1)
    assert np.allclose(got, sums / np.maximum(weight, 1)[:, None], atol=1e-5)
    own, word, n, t, times = toxicity.counted([np.array([5, 5, 7], np.uint64), np.array([7], np.uint64), np.array([5], np.uint64)], np.array([1.0, 0.0, 0.0]), np.array([0, 0, 1]))
    assert list(zip(own, word, n, t, times)) == [(0, 5, 1, 1, 2), (0, 7, 2, 1, 2), (1, 5, 1, 0, 1)]

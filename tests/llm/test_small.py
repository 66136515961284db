"""New operators on small inputs: brute force, odd rows, and the pipeline's stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import from_spark, from_sql
from cuesmith.llm import lang_crf, surrogates
from cuesmith.llm.common import Words, text_chunks
from cuesmith.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert from_spark(QUERIES[name](spark, SF)) == from_sql(ORACLE_SQL[name], SF)


def plain_posteriors(e, t):
    """Sums over every labelling of a short text."""
    n, width = e.shape
    out = np.zeros_like(e)
    for path in np.ndindex(*[width] * n):
        start = np.log(np.exp(t[:, path[0]]).sum())
        p = np.exp(start + sum(e[i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, k in enumerate(path):
            out[i, k] += p
    return out / out.sum(1, keepdims=True)


def test_posteriors_equal_brute_force():
    rng = np.random.default_rng(3)
    e, t, first = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 11])
    got = lang_crf.posteriors(e, first, t)
    for a, b in ((0, 4), (4, 11)):
        assert np.allclose(got[a:b], plain_posteriors(e[a:b], t))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op1_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "en"), (5, "123 — ! …", "de"), (6, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    tagger = lang_crf.Tagger([rows[0][1], rows[1][1]], ["en", "de"])
    got = {r.doc_id: r.lang_pred for r in lang_crf.label(docs, tagger).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert {r.lang_pred for r in lang_crf.label(docs, lang_crf.Tagger([], [])).collect()} == {"und"}
    assert lang_crf.label(docs.limit(0), tagger).count() == 0


def test_words_of_two_languages():
    en, de = "the of and to is that for with on by".split(), "der die und das nicht auf ist ein zu mit".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(w, 60)) for w in (en, de) * 20]
    tagger = lang_crf.Tagger(texts, ["en", "de"] * 20)
    mixed = " ".join([*en, *de])
    (_, _, data, offsets), = text_chunks(pa.array([mixed]))
    assert [tagger.names[k] for k in tagger.tag(Words(data, offsets, lang_crf.LETTERS)).argmax(1)] == ["en"] * 10 + ["de"] * 10


def test_surrogates(spark):
    text = "Mr. John Smith (a.b@mail.example.com, +1 (212) 555-0199) met Mrs. Mary Smith at 10.1.2.3; card 4111 1111 1111 1111"
    rows = [(1, text, "x"), (1, text, "x"), (2, "Dr. Smith wrote to A.B@mail.example.com", "y"), (None, "call +1 (212) 555-0199", "z"), (3, None, None), (4, "", "q"), (5, "nothing in 2024 here", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumn("surrogate", F.lit(1))
    out = surrogates.replace(docs, "key")
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[3] == [None] and got[4] == [""] and got[5] == ["nothing in 2024 here"]
    a, b = got[1]
    assert a == b
    for found in ("John", "Mary", "Smith", "a.b@mail", "555-0199", "10.1.2.3", "4111 1111"):
        assert found not in a
    family = a.split(" ")[2]
    assert got[2][0].split(" ")[1] == family == a.split("Mrs. ")[1].split(" ")[1]  # one person, one name
    assert a.split("(")[1].split(",")[0] == got[2][0].split(" ")[-1]  # case of an address does not matter
    assert got[None][0][5:] in a
    assert surrogates.replace(docs.limit(0), "key").count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Mr. John Family{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(120)]  # more than the list has
    names = [r.text.split(" ")[2] for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(names)) == len(rows) and not {r[1].split(" ")[2] for r in rows} & set(names)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.count() <= before
        if name in ("decontamination", "pii_surrogates"):
            assert out.count() == docs.count()
        docs = out
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_expected_transitions_equal_brute_force():
    rng = np.random.default_rng(4)
    e, t, first = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), np.array([0, 3, 4, 8])
    p, pairs = lang_crf.expectations(e, first, t)
    assert np.allclose(p, lang_crf.posteriors(e, first, t))
    want = np.zeros((3, 3))
    for a, b in zip(first[:-1], first[1:]):
        total, sums = 0.0, np.zeros((3, 3))
        for path in np.ndindex(*[3] * (b - a + 1)):  # the silent state first
            w = np.exp(sum(e[a + i, k] for i, k in enumerate(path[1:])) + sum(t[x, y] for x, y in zip(path, path[1:])))
            total += w
            for x, y in zip(path, path[1:]):
                sums[x, y] += w
        want += sums / total
    assert np.allclose(pairs, want)

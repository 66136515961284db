"""Each stage of the pipeline on a table of odd rows, against plain Python; the stages in a row."""

import pytest
from pyspark.sql import functions as F
from test_decontam import plain as plain_hits, words
from test_ngram_join import plain as plain_links

import corpus_pipeline as P
from cuesmith.llm import surrogates
from cuesmith.llm.common import staged, staged_paths

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of some 500 documents with labels and a benchmark."""
    folder = tmp_path_factory.mktemp("sf")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    labelled = [(1000 + i, ("vile filth " if i % 4 == 0 else "calm words ") + f"about thing {i % 9} and place {i % 5}") for i in range(400)]
    base = " ".join(f"w{k}" for k in range(60))
    passage = " ".join(f"b{k}" for k in range(14))
    odd = [
        (1, base), (2, base), (2, base), (3, base + " tail"), (None, base + " end"), (4, " ".join(f"v{k}" for k in range(60))), (5, None), (6, ""), (None, None), (7, "vile filth again"),
        (8, f"before it {passage} after it"), (9, passage.upper()), (10, "Dr. Anna Smith, a.b@mail.example.com"), (11, "to A.B@mail.example.com"), (12, "long " * 3000), (4, "calm other text of the same id"),
    ]
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in [*odd, *labelled]]
    write("documents", rows, SCHEMA)
    write("labels", [(d, 1, int(t.startswith("vile"))) for d, t in labelled] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    write("benchmark", [("q1", passage), ("q2", "only in the benchmark"), (None, ""), ("q3", None)], "item_id string, text string")
    return str(folder), rows


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("class", F.lit("c")).withColumn("row", F.lit(1))


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_drop_toxic(spark, sf):
    folder, rows = sf
    out = P.drop_toxic(spark, docs(spark, rows), folder)
    assert texts(out) == sorted(((r[0], r[1]) for r in rows if "vile" not in (r[1] or "")), key=str) and out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "class", "row"]


def test_drop_near_copies(spark, sf):
    folder, rows = sf
    rows = [r for r in rows if r[0] is None or r[0] < 1000]
    out = texts(P.drop_near_copies(spark, docs(spark, rows), folder))
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    groups = {}
    for i, _, least in plain_links([(i, t) for i, (_, t) in enumerate(distinct)]):
        groups.setdefault(least, []).append(distinct[i])
    assert out == sorted((g[0] for g in groups.values()), key=str)
    assert sum(t is not None and t.startswith("w0 ") for _, t in out) == 1


def test_cut_benchmark(spark, sf):
    folder, rows = sf
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    out = P.cut_benchmark(spark, docs(spark, rows), folder).collect()
    want = sorted(((d, n - hit) for d, n, hit, _ in plain_hits([(r[0], r[1]) for r in rows], items)), key=str)
    assert sorted(((r.doc_id, len(words(r.text))) for r in out), key=str) == want
    got = {r.doc_id: r.text for r in out}
    assert got[8] == "before it  after it" and got[9] == "" and got[5] is None
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_replace_pii(spark, sf):
    folder, rows = sf
    out = P.replace_pii(spark, docs(spark, rows), folder)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[10].split(", ")[1] == got[11].split(" ")[1] != "a.b@mail.example.com" and "Smith" not in got[10] and "Anna" not in got[10]
    others = [(r[0], r[1]) for r in rows if r[0] not in (10, 11)]
    assert sorted((x for x in texts(out) if x[0] not in (10, 11)), key=str) == sorted(others, key=str)
    assert docs(spark, rows).select(surrogates.count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == 3


def test_stages_in_a_row(spark, sf):
    folder, rows = sf
    mine = staged(spark.range(3).toDF("x"), "mine")
    before = staged_paths(spark)
    out = P.run(spark, folder).collect()
    assert len(staged_paths(spark)) == len(before) + 1 and mine.count() == 3  # its result is what is left
    at = {}
    for r in out:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(v)) <= 1024 for v in at.values())
    assert {r.doc_id for r in out if r.doc_id is not None and r.doc_id < 1000} == {1, 4, 5, 6, 8, 9, 10, 11, 12}
    assert sum(r.length for r in out if r.doc_id == 9) == 1 and max(r.piece for r in out if r.doc_id == 12) == 2


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_empty_table(spark, sf, k):
    assert P.STAGES[k][1](spark, docs(spark, []), sf[0]).count() == 0

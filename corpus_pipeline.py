"""A training corpus from ``documents``: toxic texts go, one text of each group of
near copies stays, benchmark passages are cut out, personal data is replaced, and
what is left is packed into sequences.

Cases, for all stages: null and empty texts are kept and stay as they are (packed, each
is a piece of the end id alone); rows with a null ``doc_id`` are rows like any other;
equal rows are judged alike, and only the near-copy stage makes one of them; further
columns, whatever their names, go along up to the last stage; an empty table stays
empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.llm import decontam, ngram_join, packing, surrogates, toxicity
from cuesmith.llm.common import new_path, release, staged_paths, table
from cuesmith.session import ship

#: Learning, sorting out and packing cannot be said in SQL; the tests hold each stage's decisions against plain Python on a small table of odd rows.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold; one of known words alone
    is scored, so texts without any are kept. Without labels all are kept."""
    ship(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null last) of each group that five-word
    shingles link at 80 percent. Rows are told apart by doc_id and text, so equal
    ones are one and different texts of one doc_id are not; rows without words stay."""
    ship(spark)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), key.alias("key")).alias("row")).distinct()
    found = ngram_join.similar(docs.select(key.alias("doc_id"), "text"), n=5, percent=80)
    found = found.join(rows, found["doc_id"] == rows["row.key"])  # rows without words are components of their own
    keep = found.groupBy("component_id").agg(F.min("row").alias("row")).select(F.col("row.key").alias("kept_key"))
    return docs.join(keep, key == keep["kept_key"], "left_semi").withColumn("kept_key", key).dropDuplicates(["kept_key"]).drop("kept_key")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; ``n_chars`` follows (null for a null
    text). A document may become empty; it stays. An empty benchmark changes nothing."""
    ship(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), window=10).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, equal ones for equal data in all of
    them; ``n_chars`` follows (null for a null text)."""
    return surrogates.replace(docs, key="surrogates").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset there; only documents
    over 1024 tokens are cut."""
    ship(spark)
    return packing.pack(docs, capacity=1024, end_id=2, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("pii_surrogates", replace_pii),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet in the shared folder and read again; what a
    stage has staged, and its input, is deleted once its result is there."""
    docs, before = table(spark, sf_dir, "documents"), staged_paths(spark)
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, [*before, path])
    return docs

"""A training-corpus pipeline over `documents`: five stages, each written as Parquet in the shared folder and read again.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents. The result is
the last stage's: the documents that are left, with surrogates in their text, and their pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equilake.llm.decontaminate import decontaminated
from equilake.llm.language_id import identify
from equilake.llm.minhash_dedup import near_duplicates
from equilake.llm.nbest_pieces import segment
from equilake.llm.queries import table, vocabulary
from equilake.llm.surrogates import replace_entities
from equilake.operators.prefix import numbered
from equilake.session import store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    return identify(docs).where("accepted").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id. Rows that share a doc_id are documents of their own if their texts differ (in
    the order of the texts' hashes); of equal rows one stays. Rows with a null id all stay: they are linked with nothing."""
    named = docs.where("doc_id is not null").withColumn("__h", F.xxhash64("text"))
    texts = named.groupBy("doc_id").agg(F.min("__h").alias("low"), F.max("__h").alias("high"))
    if texts.where("low <> high").isEmpty():
        kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
        kept = named.join(kept, "doc_id", "left_semi")
    else:
        keys, _ = numbered(named.select(F.lit(0).alias("one"), "doc_id", F.col("__h").alias("hash")).distinct(), ["one"], ["doc_id", "hash"])
        keys = keys.select(F.col("doc_id").alias("__d"), F.col("hash").alias("__k"), F.col("place").alias("__place"))
        own = named.join(keys, (F.col("doc_id") == F.col("__d")) & (F.col("__h") == F.col("__k"))).drop("__d", "__k")
        least = near_duplicates(own.select(F.col("__place").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("__place")).distinct()
        kept = own.join(least, "__place", "left_semi")
    one = kept.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("__h")))
    return one.where("__n = 1").select(docs.columns).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return replace_entities(docs).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces and the scores of the best segmentations."""
    return segment(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", pieces),
]

#: Sketches, trained models and keyed permutations are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs

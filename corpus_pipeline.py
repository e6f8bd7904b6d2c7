"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; its result is written as Parquet
and read again for the next one. All stages but the last return the columns of ``documents``.

Defined cases: rows without a known language go; rows equal in id and text are one document, of which one stays;
documents whose words are all repeated elsewhere stay with an empty text, and take no room in a sequence; null ids, texts, languages
and sources pass through every stage, and columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm import language_id, minmax_dedup, packing, phrase_dedup
from adloom.llm.shared import keyed, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that can be told; ``lang`` becomes that language."""
    docs = docs.select(*COLUMNS).withColumn("key", F.xxhash64(*COLUMNS))
    found = language_id.identify(language_id.from_documents(docs, F.col("key")), *language_id.fit_text_model(docs))
    told = found.where("kept").select("key", F.col("lang").alias("told")).dropDuplicates(["key"])
    return docs.join(told, "key").withColumn("lang", F.col("told")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of near duplicates (five-word shingles, 0.8)."""
    found = minmax_dedup.near_duplicates(docs)
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("k1", "k2")).alias("row")).select("row.*")
    blank = found.where("group IS NULL").select("k1", "k2")
    rows = keyed(docs, "doc_id", "text", COLUMNS).drop("id", "text").dropDuplicates(["k1", "k2"])
    return rows.join(first.union(blank).distinct(), ["k1", "k2"]).select(*[F.col(f"carry_{c}").alias(c) for c in COLUMNS])


def remove_recurring_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that stand in several places."""
    found = phrase_dedup.remove_recurring(docs, carry=("lang", "source"))
    return found.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_recurring_passages),
    ("packing", pack_sequences),
]

# Trigram models, hash signatures and automata are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

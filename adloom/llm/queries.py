"""The operators applied to their whole tables: one query each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm import (
    bloom_lm,
    conversation_trie,
    fingerprints,
    histogram_shards,
    language_id,
    lattice_sampling,
    license_scan,
    metric_join,
    minmax_dedup,
    oracles,
    packing,
    periodic_runs,
    phrase_dedup,
    suffix_dedup,
)
from adloom.llm.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str, table: str = "documents"):
    def wrap(build: Callable[[DataFrame], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        return build

    return wrap


def _removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together; a row has the id of the table it is from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = F.lit(None).cast("long")
    rows = language_id.from_documents(docs, F.col("doc_id"), none.alias("page_id")).union(
        language_id.from_pages(pages, none.alias("doc_id"), F.col("page_id"))
    )
    return language_id.identify(rows, *language_id.fit_text_model(docs))


REGISTRY["op1_bayesian_fusion"] = _languages


@register("op2_ordered_signatures")
def _licenses(docs: DataFrame) -> DataFrame:
    return license_scan.labelled(docs).withColumnRenamed("id", "doc_id")


@register("op3_invertible_sketch")
def _fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints.edited_fingerprints(docs).withColumnRenamed("id", "doc_id")


@register("op4_phrase_automata")
def _phrases(docs: DataFrame) -> DataFrame:
    return phrase_dedup.remove_recurring(docs).select(
        F.col("id").alias("doc_id"), "n_words", _removed().alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@register("op5_suffix_arrays")
def _suffixes(docs: DataFrame) -> DataFrame:
    return suffix_dedup.remove_repeats(docs).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        _removed().alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


@register("op6_variable_best_fit")
def _packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


@register("op9_gumbel_lattice")
def _sampled(docs: DataFrame) -> DataFrame:
    return lattice_sampling.sample_segmentations(docs).withColumnRenamed("id", "doc_id")


@register("op7_minmax_hashing")
def _near(docs: DataFrame) -> DataFrame:
    return minmax_dedup.near_duplicates(docs, size=2).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@register("op8_pivot_range_join", "embeddings")
def _vectors(rows: DataFrame) -> DataFrame:
    return metric_join.range_links(rows).withColumnRenamed("id", "vec_id")


register("op10_log_frequency_bloom")(bloom_lm.score_documents)


@register("op11_truncation_peeling", "conversations")
def _trie(conversations: DataFrame) -> DataFrame:
    turns, members = conversation_trie.rebuilt(stored(conversation_trie.ordered_turns(conversations), "ordered-turns"))
    nodes = conversation_trie.prefix_trie(stored(turns, "rebuilt"), members)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@register("op12_internal_matching")
def _periodic(docs: DataFrame) -> DataFrame:
    found = periodic_runs.collapse_runs(periodic_runs.planted(docs))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *best,
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed("runs"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


@register("op13_histogram_sort")
def _sharded(docs: DataFrame) -> DataFrame:
    placed = histogram_shards.shard_documents(docs, tolerance=0.0)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", "slot", grown)


REGISTRY["pipeline"] = corpus_pipeline.run


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

"""The registered queries of the operators: name -> (builder, DuckDB SQL or None).

Each query applies its operator with production parameters to its whole table
and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwise.llm import (ann_forest, bpe, exact_dedup, lexical_search, license_scan, line_dedup, merkle, mixing, ngram_join, quality,
                           quality_rules, sharding, sql, substring_dedup)
from clickwise.llm.common import read_table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Build, str | None]] = {}


def _query(name: str, oracle: str | None = None):
    def keep(fn: Build) -> Build:
        QUERIES[name] = (fn, oracle)
        return fn
    return keep


@_query("op1_exact_dedup", sql.EXACT_DEDUP)
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, the row with the largest doc_id stays."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_groups(docs).drop("n_chunks")


@_query("op2_license_scan", sql.license_scan())
def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return license_scan.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word",
                                          "base_labels", "labels", F.round("score", 6).alias("score"))


@_query("op5_mixing", sql.mixing())
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the Pfair interleaving of its source."""
    return mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "source"))


@_query("op6_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place under the law of equal bytes."""
    return sharding.shard(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op7_ngram_jaccard_join")
def ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets reach 85 % Jaccard similarity."""
    return ngram_join.near_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"), n=4, percent=85)


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern of the public byte-level tokenizer."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@_query("op10_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    return bpe.digests(read_table(spark, sf_dir, "documents", "doc_id", "text"), *vocabulary())


@_query("op3_line_dedup", sql.line_dedup())
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that repeat an earlier line, up to one word."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.dropped_lines(docs).select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped_lines"))


@_query("op9_substring_dedup")
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's passages that other documents hold too, and its text without the later copies."""
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op8_quality_classifier")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it stays."""
    return quality.score(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op4_ann_forest")
def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector, by inner product."""
    return ann_forest.nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@_query("op11_merkle_manifest", sql.merkle())
def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root recomputed from it, one in five tampered with."""
    return merkle.manifest(read_table(spark, sf_dir, "documents", *merkle.LEAF_FIELDS))


@_query("op12_quality_rules")
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule counts, base verdict, anomaly score and whether it stays."""
    docs, labels = read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.judge(docs, labels)


@_query("op13_lexical_search", sql.LEXICAL_SEARCH)
def lexical_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))

"""A training corpus from ``documents``: quality, exact copies, near copies, mixture, tokens.

Each stage takes the documents that its predecessor kept and is written as
Parquet, which the next one reads.  All but the last return the columns of
documents; the last one returns each document's token digests and its slot and
place in the mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clickwise.llm import bpe, exact_dedup, mixing, ngram_join, quality
from clickwise.llm.common import read_table
from clickwise.llm.queries import vocabulary
from clickwise.session import ensure_checkpoint_dir
from clickwise.sources import fs

# Texts that pass between Spark and Python at once: their bytes stand beside the executor's heap.
TEXTS_AT_ONCE = 1000
# Characters and distinct pieces that a tokenizing task holds: less than alone, as the executor's
# heap has grown in the stages before.
BLOCK_CHARS, REPLAY_PIECES = 3 << 20, 75_000

# Near copies: five words a shingle, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.keep_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return ngram_join.keep_one_per_group(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are interleaved."""
    return mixing.interleave(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, as digests, with its slot in the mixture and its place in the slot.

    The schedule depends on doc_id and source alone, so it is that of the mixed table.  Rows
    that share a doc_id are told apart by their text, equal ones by a number."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    plan = (mixing.mix(docs.withColumn("sha", sha), carry=("sha",))
            .select(F.col("doc_id").cast("long").alias("__id"), F.col("sha").alias("__sha"), "slot", "place")
            .withColumn("__copy", F.row_number().over(Window.partitionBy("__id", "__sha").orderBy("slot", "place"))))
    tokens = bpe.digests(docs, *vocabulary(), BLOCK_CHARS, REPLAY_PIECES).withColumn(
        "__n", F.row_number().over(Window.partitionBy("doc_id", "decoded_sha256").orderBy("n_tokens")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("decoded_sha256") == F.col("__sha")) & (F.col("__n") == F.col("__copy"))
    return tokens.join(plan, same, "left").select("slot", "place", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_exact),
    ("ngram_jaccard_join", drop_near),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

# The classifier and the tokenizer cannot be put into SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the tables in between go to the shared checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            fs.delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

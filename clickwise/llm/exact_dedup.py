"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Each folded text is cut into chunks whose ends depend on the content alone.
A chunk's identifier is its 64-bit hash, *verified*: the distinct chunks are
gathered once, compared by their bytes, and an identifier that two different
chunks share is found.  Two texts are equal when their ordered identifier lists
are equal; texts that hold a shared identifier also compare their SHA-256.
Every distinct chunk moves at most once per task; after that a document is 8
bytes per chunk, however long its text is.

Defined results: a null text equals the empty text (an empty identifier list);
a null doc_id ranks below all others; rows that repeat both doc_id and text are
one document for ``keep_exact`` and as many rows in ``exact_groups``; empty
tables give empty results; other columns never take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickwise.llm.common import ascii_lower, broadcast_if_small, materialise

# A chunk ends at the first vowel + blank after MIN_CHUNK characters, or at MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 4096
CHUNK_PATTERN = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?[aeiou][ \\n]|.{{1,{MAX_CHUNK}}}"


def _chunks(norm):
    return F.regexp_extract_all(norm, F.lit(CHUNK_PATTERN), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, recipe (ordered chunk identifiers) of every row."""
    return (docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_col).alias("norm"))
                .select("doc_id", F.sha2("norm", 256).alias("text_sha256"),
                        F.transform(_chunks(F.col("norm")), lambda c: F.xxhash64(c)).alias("recipe")))


def shared_identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Identifiers that stand for more than one chunk: the distinct chunks are
    compared by content, so any other identifier is verified."""
    distinct = (docs.select(F.explode(_chunks(ascii_lower(text_col))).alias("chunk"))
                    .select(F.xxhash64("chunk").alias("ident"), "chunk").distinct())
    return distinct.groupBy("ident").count().filter("count > 1").select("ident")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id of the equal
    texts), group_size, kept, text_sha256, n_chunks."""
    rows = materialise(recipes(docs, id_col, text_col))
    shared = shared_identifiers(docs, text_col)
    unsure = (rows.select("text_sha256", F.explode("recipe").alias("ident")).distinct()
                  .join(shared, "ident", "left_semi")
                  .select("text_sha256").distinct().withColumn("unsure", F.lit(True)))
    keyed = (rows.join(unsure, "text_sha256", "left")
                 .withColumn("tie", F.when(F.col("unsure"), F.col("text_sha256")).otherwise(F.lit("")))
                 .select("doc_id", "text_sha256", "recipe", "tie"))
    groups = keyed.groupBy("recipe", "tie").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return (keyed.join(groups, ["recipe", "tie"])
                 .select("doc_id", "keep_id", "group_size",
                         F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         "text_sha256", F.size("recipe").cast("long").alias("n_chunks")))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one per group of equal texts."""
    sha = F.sha2(ascii_lower(text_col), 256)
    # Only rows that go, or that repeat doc_id and text: the others need no look-up.
    odd = materialise(exact_groups(docs, id_col, text_col)
                      .groupBy(F.col("doc_id").alias("__odd_id"), F.col("text_sha256").alias("__odd_sha"))
                      .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__copies")).filter("NOT __kept OR __copies > 1"))
    marked = docs.withColumn("__sha", sha).join(
        broadcast_if_small(odd), F.col(id_col).eqNullSafe(F.col("__odd_id")) & (F.col("__sha") == F.col("__odd_sha")), "left")
    stay = marked.filter("__kept IS NULL").select(*docs.columns)
    if odd.filter("__kept").isEmpty():
        return stay
    one = marked.filter("__kept").dropDuplicates([id_col, "__sha"])
    return stay.union(one.select(*docs.columns))

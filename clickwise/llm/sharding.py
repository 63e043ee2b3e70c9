"""Sharding by sampled splitters (DataFrame functions only), law ``bytes``.

The sort key is a hash of the text, so equal texts stand side by side.  A
size-weighted sample of the keys gives quantile boundaries for many more ranges
than shards.  Every row is put into its range and the ranges' rows are counted; an
overfull range is subdivided by a second hash of the key, so equal texts stay
together.  Only a key that alone overfills a piece gets pieces of its own, by a hash
of doc_id, which follow each other.  Running sums over the pieces, then over the
rows inside a piece, place each row on the line of all bytes, and equal stretches of
that line are the shards: a group of equal texts is parted only where a shard ends.
Sampling decides only how even the ranges are, never the result's exactness: shard
sizes differ by about one text.

Defined results: a null text has size 1 (0 bytes plus 1) and CRC 0; an empty
table gives no rows; repeated rows are placed one by one; ties in the key are
ordered by doc_id (null first); other columns never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickwise.llm.common import materialise

# The sample is Poisson with SAMPLE_PER_RANGE rows per range on average, for any input.
RANGES_PER_SHARD, SAMPLE_PER_RANGE, STRIDE = 64, 16, 32
# A piece is one task's window: at most OVERFULL times a range's mean rows, and ROWS_PER_PIECE.
ROWS_PER_PIECE, OVERFULL = 250_000, 4
LAW = "bytes"


def _unit(*cols) -> Column:
    """A hash of the columns, uniform in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) / F.lit(float(1 << 63))


def splitters(rows: DataFrame, n_ranges: int) -> DataFrame:
    """One row with struct ``s``: ``bounds``, at most n_ranges ascending keys that
    cut the sampled bytes into equal parts, and ``heads``, every STRIDE-th of
    them.  A row is drawn in proportion to its size (weight 1); one beyond the
    sampling step always is (weight size / step)."""
    step = rows.agg((F.sum("size") / F.lit(float(n_ranges * SAMPLE_PER_RANGE))).alias("step")).scalar()
    drawn = (rows.withColumn("step", step)
                 .filter(_unit("doc_id", "key", F.lit("sample")) * F.col("step") < F.col("size"))
                 .groupBy("key").agg(F.sum(F.greatest(F.lit(1.0), F.col("size") / F.col("step"))).alias("weight")))
    # Bounded: about n_ranges * SAMPLE_PER_RANGE rows for any input.
    upto = drawn.select("key", F.sum("weight").over(W.orderBy("key")).alias("upto"),
                        F.sum("weight").over(W.partitionBy()).alias("whole"))
    bounds = (upto.groupBy(F.floor(F.col("upto") * n_ranges / F.col("whole")).alias("q")).agg(F.max("key").alias("key"))
                  .agg(F.array_sort(F.collect_list("key")).alias("bounds")))
    return bounds.select(F.struct("bounds", F.filter("bounds", lambda b, i: i % STRIDE == 0).alias("heads")).alias("s"))


def _range_of(key: Column, s: Column) -> Column:
    """Number of bounds below ``key``: the stride first, then inside it."""
    start = F.greatest(F.size(F.filter(s["heads"], lambda b: b < key)) - 1, F.lit(0)) * STRIDE
    return start + F.size(F.filter(F.slice(s["bounds"], start + 1, F.lit(STRIDE)), lambda b: b < key))


def place(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, rank (place on the line of all rows) per row."""
    data = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(F.encode(data, "UTF-8")).alias("text_crc32"), F.xxhash64(data).alias("key")))
    n_ranges = n_shards * RANGES_PER_SHARD
    ranged = (rows.withColumn("s", splitters(rows, n_ranges).scalar())
                  .withColumn("rng", _range_of(F.col("key"), F.col("s"))).drop("s"))
    # At most n_ranges + 1 rows, whatever the input.
    most = F.least(F.lit(ROWS_PER_PIECE), F.ceil(F.sum("n").over(W.partitionBy()) * OVERFULL / n_ranges)).cast("long")
    parts = (ranged.groupBy("rng").agg(F.count(F.lit(1)).alias("n"))
                   .select("rng", most.alias("most"), F.ceil(F.col("n") / most).alias("by_key")))
    ranged = ranged.join(F.broadcast(parts), "rng")
    # Keys that overfill a piece alone: each holds more than ``most`` rows, so there are at most
    # n_ranges / OVERFULL of them, or one per ROWS_PER_PIECE rows.
    hot = (ranged.filter("by_key > 1").groupBy("key", "most").agg(F.count(F.lit(1)).alias("n"))
                 .filter("n > most").select("key", F.ceil(F.col("n") / F.col("most")).alias("by_doc")))
    pieced = (ranged.join(F.broadcast(hot), "key", "left")
                    .withColumn("sub_key", F.floor(_unit("key", F.lit("sub")) * F.col("by_key")))
                    .withColumn("hot", F.col("by_doc").isNotNull())
                    .withColumn("own", F.when(F.col("hot"), F.col("key")).otherwise(F.lit(0)))
                    .withColumn("sub_doc", F.floor(_unit("doc_id", F.lit("sub")) * F.coalesce("by_doc", F.lit(1))))
                    .drop("by_key", "by_doc", "most"))
    piece = ["rng", "sub_key", "hot", "own", "sub_doc"]
    # One row per piece: a few times n_ranges, or a few per ROWS_PER_PIECE rows.
    line = W.orderBy(*piece)
    before = line.rowsBetween(W.unboundedPreceding, -1)
    offsets = (pieced.groupBy(*piece).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
                     .select(*piece, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte0"),
                             F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"),
                             F.sum("b").over(W.partitionBy()).alias("total")))
    inside = W.partitionBy(*piece).orderBy("key", "doc_id", "size", "text_crc32")
    return (pieced.join(offsets, piece)
                  .withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
                  .withColumn("rank", F.col("row0") + F.row_number().over(inside) - 1)
                  .select("doc_id", "size", "text_crc32", "rank",
                          F.expr(f"cast(((byte0 + upto - size) * {n_shards}) div total as int)").alias("shard")))


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless inside the shard), grown_shard."""
    placed = materialise(place(docs, n_shards, id_col, text_col))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows
    return (placed.join(F.broadcast(first), "shard")
                  .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                          (F.col("rank") - F.col("first")).alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard")))

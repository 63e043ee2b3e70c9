"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

A source's rows, in a hashed order, are cut into blocks.  With a target weight of
``a`` out of ``N`` the k-th block of a source is released at floor(k * N / a) and due at
ceil((k + 1) * N / a); at each slot the released block with the earliest deadline runs
(ties: first source by name).  As the weights add to one this meets every
deadline, so after any number of slots a source is less than one block away from
its weight while all still have blocks.  The schedule repeats after N slots: one cycle is
worked out once from the weights alone (N steps over the sources, in one task), and every
block finds its slot by an equi-join, in parallel.

Given weights are taken exactly: N is their common denominator (0.9 and 0.1: 10), up to
MAX_CYCLE; beyond that they are rounded to 1 / MAX_CYCLE, which adds less than one block
in MAX_CYCLE slots.  A source in the table that has no positive weight is refused, since
its rows would have no place; slots of a source without rows stay empty.  Default weights
are rows ** ALPHA, which damps a hot source, as whole shares of CYCLE slots (largest
remainder; one share for those that round to none).

All rows stay, each once: a source that ends early leaves its later slots
empty, and the others keep their order.  Ranks inside a source never need one
task: rows are counted per hash bucket, buckets are summed up, and only rows of
one bucket are ordered together.

Defined results: a null source is a source of its own, named '' in ties and weights with an
empty name; null doc_ids and repeated rows are ranked like others (first in
their bucket by null, rows of one doc_id by a hash of all their columns); empty tables
give no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickwise.llm.common import materialise

ALPHA = 0.5
BLOCK_ROWS = 32
# Slots of a cycle of default weights, at least twice the number of sources; the most slots of given ones.
CYCLE, MAX_CYCLE = 1000, 10_000
# Hash buckets of a source: a fixed 3 hex digits, at most 4,096.
BUCKET_DIGITS = 3


Weights = dict[str | None, float | str | Fraction]


def default_shares(counts: DataFrame, cycle: int = CYCLE, alpha: float = ALPHA) -> DataFrame:
    """source -> share: whole shares that add to ``cycle``, n ** alpha by largest remainder.  Sources
    that come to less than one share get one, the others divide the rest.  ``counts`` has
    (source, n), one row per source, and at most cycle / 2 of them."""
    everyone = W.partitionBy()
    exact = (counts.withColumn("want", F.round(F.pow(F.col("n").cast("double"), F.lit(alpha)), 9))
                   .withColumn("few", F.col("want") * cycle < F.sum("want").over(everyone)))
    others = F.sum(F.when(~F.col("few"), F.col("want"))).over(everyone)
    spare = F.lit(cycle) - F.sum(F.col("few").cast("long")).over(everyone)
    exact = exact.withColumn("exact", F.when(F.col("few"), 1.0).otherwise(F.round(F.col("want") * spare / others, 6)))
    whole = F.greatest(F.floor("exact"), F.lit(1))
    left = F.lit(cycle) - F.sum(whole).over(everyone)
    order = F.row_number().over(W.orderBy((F.col("exact") - F.floor("exact")).desc(), "source"))
    return (exact.withColumn("whole", whole).withColumn("left", left).withColumn("ord", order)
                 .select("source", (F.col("whole") + F.when(F.col("ord") <= F.col("left"), 1).otherwise(0)).cast("long").alias("share")))


def given_shares(weights: Weights, max_cycle: int = MAX_CYCLE) -> tuple[dict[str, int], int]:
    """Shares of the sources with a positive weight and the cycle they add to: exactly the weights'
    proportions if ``max_cycle`` allows."""
    exact = {(s or ""): Fraction(str(w)) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()) or not any(exact.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    whole = sum(exact.values())
    exact = {s: w / whole for s, w in sorted(exact.items()) if w}
    cycle = lcm(*(w.denominator for w in exact.values()))
    if cycle <= max_cycle:
        return {s: int(w * cycle) for s, w in exact.items()}, cycle
    if 2 * len(exact) > max_cycle:
        raise ValueError(f"{len(exact)} weights need a cycle of more than {max_cycle} slots")
    few = [s for s, w in exact.items() if w * max_cycle < 1]
    rest = sum(w for s, w in exact.items() if s not in few)
    parts = {s: Fraction(1) if s in few else w / rest * (max_cycle - len(few)) for s, w in exact.items()}
    out = {s: max(1, int(x)) for s, x in parts.items()}
    for s in sorted(parts, key=lambda s: (int(parts[s]) - parts[s], s))[:max(0, max_cycle - sum(out.values()))]:
        out[s] += 1
    return out, sum(out.values())


def cycle_schedule(share: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """source, share, k (block inside the cycle), slot: earliest deadline first
    over the released blocks, one cycle; ``cycle`` rows."""
    srcs = share.agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("srcs"))
    n = F.lit(cycle)
    start = srcs.select("srcs", F.struct(
        F.transform("srcs", lambda s: F.lit(0).cast("long")).alias("done"),
        F.lit([]).cast("array<int>").alias("picks")).alias("zero"))

    def step(state: Column, t: Column) -> Column:
        # Released: floor(k*N/a) <= t; due: ceil((k+1)*N/a).
        jobs = F.transform(F.col("srcs"), lambda s, i: F.struct(
            F.ceil((state["done"][i] + 1) * n / s["share"]).alias("due"), i.alias("i"),
            ((state["done"][i] < s["share"]) & (F.floor(state["done"][i] * n / s["share"]) <= t)).alias("ready")))
        pick = F.array_min(F.filter(jobs, lambda j: j["ready"]))["i"]
        return F.struct(F.transform(state["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d)).alias("done"),
                        F.concat(state["picks"], F.array(pick)).alias("picks"))

    picks = start.select("srcs", F.aggregate(F.sequence(F.lit(0), n - 1), F.col("zero"), step)["picks"].alias("picks"))
    slots = (picks.select("srcs", F.posexplode("picks").alias("slot", "i"))
                  .select("slot", F.get("srcs", F.col("i")).alias("s")).filter("s IS NOT NULL").select("slot", "s.*"))
    return slots.select("source", "share", (F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1).alias("k"), "slot")


def _place(rows: DataFrame, id_col: str, source_col: str, cycle: int, alpha: float, block_rows: int,
           weights: Weights | None) -> DataFrame:
    """``rows`` plus __source, __block, __slot, __at (place inside the block), __share."""
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = (rows.withColumn("__row", F.xxhash64(*rows.columns)).withColumn("__source", F.coalesce(F.col(source_col), F.lit("")))
                 .withColumn("__h", hashed).withColumn("__bucket", F.substring("__h", 1, BUCKET_DIGITS)))
    per_bucket = materialise(keyed.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("n"))
                                  .withColumnsRenamed({"__source": "source", "__bucket": "bucket"}))
    counts = materialise(per_bucket.groupBy("source").agg(F.sum("n").alias("n")))
    if weights is None:
        cycle = max(cycle, 2 * counts.count())
        share = materialise(default_shares(counts, cycle, alpha))
    else:
        given, cycle = given_shares(weights)
        share = rows.sparkSession.createDataFrame(list(given.items()), "source string, share long")
        lost = [r["source"] for r in counts.join(share, "source", "left_anti").orderBy("source").limit(5).collect()]
        if lost:
            raise ValueError(f"sources without a positive weight: {lost}")
    plan = materialise(cycle_schedule(share, cycle))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (per_bucket.withColumn("__row0", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(share, "source")
                         .select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "__row0", F.col("share").alias("__share")))
    at = F.row_number().over(W.partitionBy("__source", "__bucket").orderBy("__h", id_col, "__row")) - 1
    slots = plan.select(F.col("source").alias("__source"), F.col("k").alias("__k"), F.col("slot").alias("__slot0"))
    # ``slots`` has ``cycle`` rows.
    return (keyed.withColumn("__rank", at).join(offsets, ["__source", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__row0"))
                 .withColumn("__block", F.expr(f"__rank div {block_rows}")).withColumn("__k", F.col("__block") % F.col("__share"))
                 .join(F.broadcast(slots), ["__source", "__k"])
                 .withColumn("__slot", F.expr("__block div __share") * cycle + F.col("__slot0"))
                 .withColumn("__at", (F.col("__rank") % block_rows).cast("int")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", cycle: int = CYCLE, alpha: float = ALPHA,
        block_rows: int = BLOCK_ROWS, weights: Weights | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, block (of the source), slot, place (inside the block), share, and the columns ``carry``."""
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *carry))
    return _place(rows, "doc_id", "source", cycle, alpha, block_rows, weights).select(
        "doc_id", F.col("__source").alias("source"), F.col("__block").alias("block"), F.col("__slot").alias("slot"),
        F.col("__at").alias("place"), F.col("__share").alias("share"), *carry)


def interleave(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", cycle: int = CYCLE, alpha: float = ALPHA,
               block_rows: int = BLOCK_ROWS, weights: Weights | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, in the order of the schedule (written, the files hold them in that order)."""
    return (_place(docs, id_col, source_col, cycle, alpha, block_rows, weights)
            .orderBy("__slot", "__at").select(*docs.columns))

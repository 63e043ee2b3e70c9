"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Equal vectors are one class (its smallest vec_ids stand for all: a result of k
rows needs no more than k + 1 of them).  In each of TREES trees a class has a
BITS-bit string of random-hyperplane signs; vectors are first lengthened to equal
norm, so that the angle orders them by inner product.  A tree is the sorted array
of its strings, and the classes that share a prefix are one stretch of it.

A query starts at the longest prefixes and goes up in all trees at once, a bit at
a time, until the trees together hold enough candidates.  How many are enough is
measured: for a bounded sample of queries the exact neighbours are found by brute
force, and the smallest number that finds TARGET_RECALL of them is taken (all
classes, if need be).  Candidates are compared exactly, in double precision.

Stretches are worked on in groups of one prefix; a group that holds more than
GROUP_ROWS classes is salted into several, and its queries go to all of them, so
no group is unbounded and no candidate is left out.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components, or have a null vec_id take no part; vectors of each length are an
index of their own; rows repeating vec_id and vector are one; with no other vector
of its length a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clickwise.llm.common import materialise

TREES, BITS, SEED = 16, 32, 20
TARGET_RECALL, SAMPLE_QUERIES = 0.96, 100
GROUP_ROWS = 20_000
# Deepest prefixes looked at hold this many classes on average.
LEAF_ROWS = 64
SALTS = 64

RESULT = "query_id long, rank int, vec_id long, score double"

Batches = Iterator[pa.RecordBatch]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double>), a, b (128-bit name of the vector)."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
                   .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine & F.exists("v", lambda x: x != 0.0)))
    return rows.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit("vector"), "v"))


def smallest_members(rows: DataFrame, k: int) -> DataFrame:
    """a, b, cid, ids: of each class its up to k + 1 smallest vec_ids.  Ranks are
    taken in salted parts first, so a hot vector is not ranked by one task."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    ranked = (rows.select("a", "b", "vec_id").distinct().withColumn("part", part)
                  .withColumn("r", F.row_number().over(W.partitionBy("a", "b", "part").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
                  .withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("vec_id"))).filter(F.col("r") <= k + 1))
    return ranked.groupBy("a", "b").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(-1, dim)


def _strings(x: np.ndarray, planes: np.ndarray, norm: float) -> np.ndarray:
    """One hash string per vector and tree, as non-negative longs of BITS bits."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    signs = np.hstack([x, rest[:, None]]) @ planes > 0
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
    return signs.reshape(len(x), TREES, BITS) @ weights


def _best(scores: np.ndarray, x: np.ndarray, q: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of a query's k + 1 best, ties to the smaller cid.
    The product of matrices only picks; scores are summed anew the same way everywhere."""
    some = np.arange(len(scores))
    if len(some) > k + 12:
        bound = -np.partition(-scores[some], k + 1)[k + 1]
        some = some[scores[some] >= bound - 1e-9 * max(1.0, abs(bound))]
    exact = (x[some] * q).sum(1)
    order = np.lexsort((cid[some], -exact))[:k + 1]
    return some[order], exact[order]


def _search(dim: int, k: int):
    """One group's classes and queries -> each query's best classes among those that
    share its prefix."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("h").to_numpy(), kind="stable")
            h, cid, x = left.column("h").to_numpy()[order], left.column("cid").to_numpy()[order], _matrix(left.column("v"), dim)[order]
            qh, depth, qid, q = right.column("h").to_numpy(), right.column("depth").to_numpy(), right.column("cid").to_numpy(), _matrix(right.column("v"), dim)
            shift = BITS - depth
            lo = np.searchsorted(h, (qh >> shift) << shift)
            hi = np.searchsorted(h, ((qh >> shift) + 1) << shift)
            # Only stretches are multiplied, each once with the queries that share its prefix.
            by_stretch = np.lexsort((hi, lo))
            edges = np.flatnonzero(np.diff(lo[by_stretch]) | np.diff(hi[by_stretch])) + 1
            for sharing in np.split(by_stretch, edges):
                a, b = lo[sharing[0]], hi[sharing[0]]
                if a == b:
                    continue
                for at in range(0, len(sharing), 256):
                    some_queries = sharing[at:at + 256]
                    for i, row in zip(some_queries, q[some_queries] @ x[a:b].T):
                        some, exact = _best(row, x[a:b], q[i], cid[a:b], k)
                        out[0].append(np.full(len(some), qid[i]))
                        out[1].append(cid[a:b][some])
                        out[2].append(exact)
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        return pa.table({"query": cat(out[0], pa.int64()), "cid": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})
    return run


def _brute(queries: tuple[np.ndarray, np.ndarray], dim: int, k: int):
    """Each batch's exact best classes of a few queries."""
    def run(batches: Batches) -> Batches:
        qid, q = queries
        for batch in batches:
            cid, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            for i, row in enumerate(q @ x.T):
                some, exact = _best(row, x, q[i], cid, k)
                yield pa.record_batch([pa.array(np.full(len(some), qid[i])), pa.array(cid[some]), pa.array(exact)], names=["query", "cid", "score"])
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k + 1 best classes; ``found`` may name a class several times."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "cid")
    return (found.groupBy("query", "cid").agg(F.max("score").alias("score"))
                 .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r"))


def _enough(sample: list, truth: list, target: float) -> int:
    """Fewest candidates (summed over the trees) that find ``target`` of the sampled
    queries' true neighbours.  sample: query, strings, counts per depth; truth: query, strings."""
    by_query = {r["query"]: r for r in sample}
    deepest = len(sample[0]["counts"]) - 1
    hits = []
    for r in truth:
        q = by_query[r["query"]]
        same = max(BITS - (a ^ b).bit_length() for a, b in zip(q["strings"], r["strings"]))
        # The neighbour is found once the query has gone up to depth ``same``; it goes on from there
        # if the depth below held too few.
        depth = min(same, deepest)
        hits.append(0 if depth == deepest else q["counts"][depth + 1] + 1)
    hits.sort()
    return hits[min(len(hits) - 1, int(np.ceil(target * len(hits))) - 1)] if hits else 1


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vec_col)
    sizes = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = [_nearest(rows.filter(F.size("v") == F.lit(size)), k, every, target) for size in sizes]
    if len(found) == 1:
        return found[0]
    # A vec_id may have vectors of several lengths.
    line = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (reduce(DataFrame.union, found, vectors.sparkSession.createDataFrame([], RESULT))
            .withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k))


def _nearest(rows: DataFrame, k: int, every: int, target: float) -> DataFrame:
    """``nearest`` among usable vectors of one length."""
    empty = rows.sparkSession.createDataFrame([], RESULT)
    members = materialise(smallest_members(rows, k))
    reps = rows.join(members.select("a", "b", F.col("cid").alias("vec_id"), "cid"), ["a", "b", "vec_id"]).select("cid", "v").dropDuplicates(["cid"])
    classes = materialise(reps)
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
                       F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).first()
    if not size["n"]:
        return empty
    n, dim, norm = size["n"], size["dim"], size["norm"]
    planes = np.random.default_rng(SEED).standard_normal((dim + 1, TREES * BITS))
    asked = (rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "a", "b").distinct()
                 .join(members.select("a", "b", "cid"), ["a", "b"]).select(F.col("vec_id").alias("query_id"), "cid"))
    queries = classes.join(asked.select("cid").distinct(), "cid", "left_semi")

    def strings(batches: Batches, per_query: bool) -> Batches:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            # A query has no part in the added dimension.
            h = _strings(x, planes, 0.0 if per_query else norm)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(h), pa.list_(pa.int64()))], names=["cid", "v", "strings"])

    kind = "cid long, v array<double>, strings array<long>"
    index = materialise(classes.select("cid", "v").mapInArrow(lambda b: strings(b, False), kind))
    searched = materialise(queries.select("cid", "v").mapInArrow(lambda b: strings(b, True), kind))

    # Counts of every prefix up to ``deepest`` bits, per tree.
    deepest = int(min(BITS - 1, max(2, np.ceil(np.log2(max(n / LEAF_ROWS, 1))))))
    cell = lambda df: df.select("cid", F.posexplode("strings").alias("tree", "h")).withColumn("cell", F.shiftright("h", BITS - deepest))
    cells = cell(index).groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("c"))
    depths = F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth")
    prefix = F.expr(f"shiftright(cell, {deepest} - depth)")
    counts = cells.select("tree", "cell", "c", depths).groupBy("tree", "depth", prefix.alias("prefix")).agg(F.sum("c").alias("c"))
    counts = materialise(counts)
    per_depth = (cell(searched).select("cid", "tree", "cell", depths).withColumn("prefix", prefix)
                 .join(counts, ["tree", "depth", "prefix"], "left").groupBy("cid", "depth").agg(F.sum(F.coalesce("c", F.lit(0))).alias("c")))
    known = materialise(per_depth.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("depth", "c"))).alias("x"))
                                 .select("cid", F.col("x.c").alias("counts")))

    # A bounded sample of queries, with their exact neighbours, says how far up to go.
    drawn = searched.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE_QUERIES).join(known, "cid").collect()
    if not drawn:
        return empty
    few = (np.array([r["cid"] for r in drawn]), np.array([r["v"] for r in drawn]))
    truth = (_top(classes.select("cid", "v").mapInArrow(_brute(few, dim, k), "query long, cid long, score double"), k)
             .filter("query != cid").join(index.select("cid", "strings"), "cid").select("query", "strings").collect())
    enough = _enough([{"query": r["cid"], "strings": r["strings"], "counts": r["counts"]} for r in drawn], truth, target)
    held = F.filter(F.transform("counts", lambda c, i: F.when(c >= F.lit(int(enough)), i)), lambda d: d.isNotNull())
    routed = searched.join(known.select("cid", F.coalesce(F.array_max(held), F.lit(0)).alias("depth")), "cid")
    top_depth = int(routed.agg(F.min("depth")).first()[0])

    # Groups: one prefix of top_depth bits of one tree, salted by size.
    salts = (counts.filter(F.col("depth") == top_depth)
                   .select("tree", F.col("prefix").alias("grp"), F.ceil(F.col("c") / F.lit(GROUP_ROWS)).cast("int").alias("salts")))
    at = F.shiftright("h", BITS - top_depth) if top_depth else F.lit(0).cast("long")
    spread = (index.select("cid", "v", F.posexplode("strings").alias("tree", "h")).withColumn("grp", at).join(salts, ["tree", "grp"])
                   .withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int")).select("tree", "grp", "salt", "h", "cid", "v"))
    sent = (routed.select("cid", "v", F.col("depth").cast("long").alias("depth"), F.posexplode("strings").alias("tree", "h")).withColumn("grp", at)
                  .join(salts, ["tree", "grp"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                  .select("tree", "grp", "salt", "h", "depth", "cid", "v"))
    keys = ["tree", "grp", "salt"]
    found = (spread.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search(dim, k), "query long, cid long, score double"))
    best = _top(found, k).join(members.select("cid", "ids"), "cid").select(F.col("query"), "score", F.explode("ids").alias("vec_id"))
    line = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(best, asked["cid"] == best["query"]).filter("vec_id != query_id")
                 .withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

"""N-gram Jaccard join by vertical partitioning: links and components of near copies.

Texts with equal shingle sets are one node (named by 128 bits of the set).  In a
global shingle order -- shingles that many texts hold last -- two sets whose
Jaccard similarity reaches the bound share a shingle within their prefixes.

* Prefix postings meet by shingle in one shuffle; only shingles of two nodes or
  more live on.
* Of each shingle's nodes the most central one (most heavy shingles) is the
  leader; nodes are first compared with leaders only, which is linear in the
  postings and links nearly everything inside a large group of near copies.
* What is left are nodes of a shingle that are still in different components; they
  are compared too, so no link between components is lost.  Length and position
  bounds cut both lists.  A posting of a set of n shingles at place pos can meet one of
  another set only if percent * m <= 100 * n - (100 + percent) * pos and the same the
  other way round, so before any pairs are formed the postings of a shingle (and size
  class) that no least size, or no largest reach, of the others allows are dropped: texts
  that share a frame but stay just below the bound form no pairs.
* To compare a pair, the global order is cut into FRAGMENTS; overlaps are
  counted per fragment and summed per pair, exactly.

The order decides speed only, never the result.  Heavy shingles: those seen in
several texts of one window of a partition, counted over all documents, at most
HEAVY of the most frequent ones (a bounded list).

Defined results: null and empty texts have no shingles and are their own
component; a null doc_id gives null component_id and takes no part in linking;
rows that share a doc_id are one document; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickwise.llm.common import broadcast_if_small, frugal, materialise
from clickwise.llm.components import components
from clickwise.llm.shingles import set_names, shingle_sets, slices

FRAGMENT_BITS = 3
HEAVY = 1_000_000
HEAVY_TEXTS = 3
WINDOW_TOKENS = 1_000_000
SEEN_NODES = 200_000

Batches = Iterator[pa.RecordBatch]
NODE = ("a", "b")


def _sets(batches: Batches, n: int):
    """The batch's rows, row, token, count, a, b per slice of text."""
    for batch in batches:
        for first, offsets, data in slices(batch.column(1)):
            row, token = shingle_sets(offsets, data, n)
            yield (batch.slice(first, len(offsets) - 1), row, token, *set_names(row, token, len(offsets) - 1))


def _describe(batches: Batches, n: int) -> Batches:
    """Per text its number of shingles and node; per window of texts the shingles
    that several of them hold, with counts (one packed row)."""
    held, size = [], 0

    def repeated():
        token, seen = np.unique(np.concatenate(held), return_counts=True)
        some = seen > 1
        packed = np.stack([token[some].view(np.int64), seen[some]]).tobytes()
        return pa.record_batch([*[pa.nulls(1, pa.int64())] * 5, pa.array([packed], pa.binary())],
                               names=["doc_id", "mark", "n", "a", "b", "heavy"])

    for part, row, token, count, a, b in _sets(batches, n):
        yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(2), pa.array(count), pa.array(a), pa.array(b), pa.nulls(part.num_rows, pa.binary())],
                              names=["doc_id", "mark", "n", "a", "b", "heavy"])
        held.append(token)
        size += len(token)
        if size >= WINDOW_TOKENS:
            yield repeated()
            held, size = [], 0
    if held:
        yield repeated()


def _unpack_heavy(batches: Batches) -> Batches:
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            token, seen = np.frombuffer(packed, np.int64).reshape(2, -1)
            for at in range(0, len(token), 100_000):
                yield pa.record_batch([pa.array(token[at:at + 100_000]), pa.array(seen[at:at + 100_000])], names=["token", "seen"])


def _heavy(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their counts, of those seen HEAVY_TEXTS times or
    more: all from some count on, and of the next lower one a share (by hash), about HEAVY together."""
    seen = materialise(described.filter("heavy IS NOT NULL").select("heavy").mapInArrow(frugal(_unpack_heavy), "token long, seen long")
                       .groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= HEAVY_TEXTS))
    upto = Window.orderBy(F.desc("seen"))  # one row per distinct count
    steps = seen.groupBy("seen").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    # The count whose shingles fit in part only, if any.
    edge = steps.filter(F.col("upto") > HEAVY).orderBy(F.desc("seen")).select("seen", ((HEAVY - (F.col("upto") - F.col("n"))) / F.col("n")).alias("share")).first()
    if edge:
        drawn = F.shiftrightunsigned(F.xxhash64("token"), 1) / F.lit(2.0 ** 63) < F.lit(edge["share"])
        seen = seen.filter((F.col("seen") > edge["seen"]) | (F.col("seen") == edge["seen"]) & drawn)
    top = seen.toPandas().sort_values("token")  # about HEAVY rows at most
    return top["token"].to_numpy(np.int64), top["seen"].to_numpy(np.int64)


def _postings(batches: Batches, n: int, percent: int, heavy) -> Batches:
    """The prefix of each set in the global order; a set seen before in this task is left out."""
    tokens, weights = heavy.value
    seen: set = set()
    for _, row, token, count, a, b in _sets(batches, n):
        if not len(token):
            continue
        token = token.view(np.int64)
        at = np.minimum(np.searchsorted(tokens, token), max(len(tokens) - 1, 0))
        weight = np.where(tokens[at] == token, weights[at], 0) if len(tokens) else np.zeros(len(token), np.int64)
        central = np.bincount(row, weights=weight > 0, minlength=len(count)).astype(np.int64)
        order = np.lexsort((token, weight, row))
        place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        fresh = np.zeros(len(count), bool)
        for i, name in enumerate(zip(a.tolist(), b.tolist())):
            if name not in seen:
                seen.add(name)
                fresh[i] = True
        if len(seen) > SEEN_NODES:
            seen.clear()
        take = fresh[row] & (place <= count[row] - -(-percent * count[row] // 100))
        r, t = row[take], token[order][take]
        yield pa.record_batch([pa.array(x) for x in (t, a[r], b[r], count[r], place[take], central[r])],
                              names=["token", "a", "b", "n", "pos", "central"])


LIVE = "token long, a long, b long, n long, pos long, la long, lb long, ln long, lpos long, many boolean"


def _live(batches: Batches, percent: int) -> Batches:
    """Postings sorted by shingle, most central node first -> each further node of a
    shingle with the first one, its leader.  ``many`` marks postings that further nodes of
    their shingle may meet; of the others only pairs within the bounds are told.  Holds one
    batch and at most two rows of the last shingle."""
    def told(x: np.ndarray, many_before: bool, goes_on: bool) -> pa.RecordBatch:
        start = np.r_[True, x[0, 1:] != x[0, :-1]]
        lead = np.maximum.accumulate(np.where(start, np.arange(x.shape[1]), 0))
        many = (np.bincount(lead)[lead] > 2) | (many_before & (lead == 0))
        y = x[:, lead]
        possible = np.minimum(x[3] - x[4], y[3] - y[4]) * (100 + percent) >= percent * (x[3] + y[3])
        # Reach and size of the nodes that follow the leader, over shingles that lie whole in this batch.
        reach, size, far = 100 * x[3] - (100 + percent) * x[4], percent * x[3], np.iinfo(np.int64).max
        begin = np.flatnonzero(start)
        least = np.minimum.reduceat(np.where(start, far, size), begin)
        most = np.maximum.reduceat(np.where(start, -far, reach), begin)
        group = np.cumsum(start) - 1
        whole = ~((group == 0) & many_before | (group == group[-1]) & goes_on)
        many &= ~whole | (least[group] <= reach) & (most[group] >= size)
        out = ~start & (many | possible)
        return pa.record_batch([pa.array(c[out]) for c in (*x[:5], *y[1:5], many)], names=[f.split()[0] for f in LIVE.split(", ")])

    carry, many = np.empty((6, 0), np.int64), False
    for batch in batches:
        x = np.concatenate([carry, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        if not x.shape[1]:
            continue
        x = x[:, np.r_[True, (x[:3, 1:] != x[:3, :-1]).any(axis=0)]]
        last = int(np.flatnonzero(np.r_[True, x[0, 1:] != x[0, :-1]])[-1])
        if x.shape[1] - last > 2 or many and last == 0:  # three nodes or more: only the leader is still needed
            body, carry, many_next = x, x[:, [last]], True
        else:
            body, carry, many_next = x[:, :last], x[:, last:], False
        if body.shape[1]:
            yield told(body, many, many_next)
        many = many_next
    if carry.shape[1] > 1:
        yield told(carry, many, False)


def _segments(batches: Batches, n: int, first: bool) -> Batches:
    """Each text's shingles in the first fragment of the hash order, or in each of the others."""
    for _, row, token, count, a, b in _sets(batches, n):
        frag = (token >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64)
        mine = (frag == 0) == first
        row, token, frag = row[mine], token[mine], frag[mine]
        if not len(row):
            continue
        cut = np.r_[0, np.flatnonzero(np.diff(row * (1 << FRAGMENT_BITS) + frag)) + 1]
        r = row[cut]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(row)], pa.int32()), pa.array(token.view(np.int64)))
        yield pa.record_batch([pa.array(a[r]), pa.array(b[r]), pa.array(frag[cut].astype(np.int32)), lists],
                              names=["a", "b", "frag", "tokens"])


def _possible(n: str, pos: str, m: str, mpos: str, percent: int) -> Column:
    """Length and position bound: what is left of either set can still hold the overlap the bound asks for."""
    need = f"percent * ({n} + {m})".replace("percent", str(percent))
    return F.expr(f"least({n} - {pos}, {m} - {mpos}) * {100 + percent} >= {need}")


def _overlaps(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, first: bool) -> DataFrame:
    """u, v, frag, both, su, sv: the pairs' overlap and sizes in the first fragment or
    in each of the others, where both hold shingles.  Only the pairs' texts are read again."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    readers = materialise(nodes.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    parts = materialise(texts.join(broadcast_if_small(readers), "doc_id", "left_semi").select("doc_id", "text")
                             .mapInArrow(frugal(partial(_segments, n=n, first=first)), "a long, b long, frag int, tokens array<long>")
                             .select(F.struct("a", "b").alias("node"), "frag", "tokens"))
    left = parts.select(F.col("node").alias("u"), "frag", F.col("tokens").alias("tu"))
    right = parts.select(F.col("node").alias("v"), "frag", F.col("tokens").alias("tv"))
    # A doc_id on several rows may bring a node's fragments more than once.
    return (pairs.select("u", "v").join(left, "u").join(right, ["v", "frag"])
                 .groupBy("u", "v", "frag").agg(F.max(F.size(F.array_intersect("tu", "tv"))).alias("both"),
                                                F.max(F.size("tu")).alias("su"), F.max(F.size("tv")).alias("sv")))


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v, nu, nv) that reach the bound: partial overlaps per fragment,
    summed per pair.  Pairs that miss too much of the first fragment to reach the
    bound, whatever the others hold, need no more of them."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bound = f"100 * {{0}} >= {percent} * (nu + nv - {{0}})"
    some = materialise(pairs.join(_overlaps(pairs, texts, nodes, n, True).drop("frag"), ["u", "v"], "left")
                            .withColumn("both", zero("both")).withColumn("most", F.col("both") + F.least(F.col("nu") - zero("su"), F.col("nv") - zero("sv")))
                            .filter(bound.format("most")).select("u", "v", "nu", "nv", "both"))
    rest = _overlaps(some, texts, nodes, n, False).groupBy("u", "v").agg(F.sum("both").alias("rest"))
    return (some.join(rest, ["u", "v"], "left").withColumn("both", F.col("both") + zero("rest"))
                .filter(bound.format("both")).select("u", "v"))


def _meetable(postings: DataFrame, percent: int) -> DataFrame:
    """``postings`` (token, n, pos, ...) with their size class, reach and size, without those that no
    other one of their shingle can meet: sizes of a linked pair lie in one class or in neighbouring ones."""
    x = (postings.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9))
                 .withColumn("reach", F.expr(f"100 * n - {100 + percent} * pos")).withColumn("size", F.col("n") * percent))
    near = (x.groupBy("token", "cls").agg(F.min("size").alias("least"), F.max("reach").alias("most"))
             .withColumn("cls", F.explode(F.array(*[F.col("cls") + k for k in (-1, 0, 1)])))
             .groupBy("token", "cls").agg(F.min("least").alias("least"), F.max("most").alias("most")))
    return x.join(near, ["token", "cls"]).filter("least <= reach AND most >= size").drop("least", "most")


def _apart(live: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """node, n, node2, n2: further nodes of one shingle that are still in different components
    and that the bounds allow to be linked."""
    rows = _meetable(live.filter("many"), percent)
    part = materialise(rows.join(label.select("node", F.col("root").alias("part")), "node", "left")
                           .join(label.select(F.col("node").alias("lead"), F.col("root").alias("lead_part")), "lead", "left")
                           .select("token", "cls", "node", "n", "reach", "size", F.coalesce("part", "node").alias("part"),
                                   F.coalesce("lead_part", "lead").alias("lead_part")))
    apart = part.filter("part != lead_part")
    other = part.select("token", F.explode(F.array(*[F.col("cls") + k for k in (-1, 0, 1)])).alias("cls"), F.col("node").alias("node2"), F.col("n").alias("n2"),
                        F.col("reach").alias("reach2"), F.col("size").alias("size2"), F.col("part").alias("part2"),
                        (F.col("part") == F.col("lead_part")).alias("with_lead"))
    return apart.join(other, ["token", "cls"]).filter((F.col("part") != F.col("part2")) & (F.col("with_lead") | (F.col("node") < F.col("node2")))
                                                      & (F.col("size2") <= F.col("reach")) & (F.col("size") <= F.col("reach2")))


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", mark: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of
    at least ``percent`` / 100 Jaccard similarity of n-word shingles) per row; with
    ``mark`` also the text's hash."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialise(texts.withColumn("mark", F.xxhash64("text"))
                            .mapInArrow(frugal(partial(_describe, n=n)), "doc_id long, mark long, n long, a long, b long, heavy binary"))
    rows = described.filter("heavy IS NULL").select("doc_id", "mark", "n", F.struct("a", "b").alias("node"))
    nodes = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "node")
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(described))
    live = materialise(texts.filter("doc_id IS NOT NULL")
                            .mapInArrow(frugal(partial(_postings, n=n, percent=percent, heavy=heavy)),
                                        "token long, a long, b long, n long, pos long, central long")
                            .repartition("token").sortWithinPartitions("token", F.desc("central"), "a", "b")
                            .mapInArrow(frugal(partial(_live, percent=percent)), LIVE)
                            .select("token", F.struct("a", "b").alias("node"), "n", "pos",
                                    F.struct(F.col("la").alias("a"), F.col("lb").alias("b")).alias("lead"), "ln", "lpos", "many"))
    ends = lambda x, y, nx, ny: [F.least(x, y).alias("u"), F.greatest(x, y).alias("v"),
                                 F.when(F.col(x) < F.col(y), F.col(nx)).otherwise(F.col(ny)).alias("nu"),
                                 F.when(F.col(x) < F.col(y), F.col(ny)).otherwise(F.col(nx)).alias("nv")]
    first = materialise(live.filter(_possible("n", "pos", "ln", "lpos", percent))
                            .select(*ends("node", "lead", "n", "ln")).distinct())
    links = materialise(_verified(first, texts, nodes, n, percent))
    label = components(links)

    second = materialise(_apart(live, label, percent).select(*ends("node", "node2", "n", "n2")).distinct().join(first, ["u", "v"], "left_anti"))
    more = materialise(_verified(second, texts, nodes, n, percent))
    if not more.isEmpty():
        label = components(links.union(more))

    smallest = nodes.groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = smallest.join(label, "node")
    roots = joined.groupBy("root").agg(F.min("first").alias("component"))
    linked = joined.join(roots, "root").select("node", "component")
    named = smallest.join(linked, "node", "left").select("node", F.coalesce("component", "first").alias("component"))
    # A doc_id on several rows has a component per text, that of the row's own shingles.
    return (rows.join(named, "node", "left")
                .select("doc_id", *["mark"] * mark, F.col("n").alias("n_shingles"),
                        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id")))


def keep_one_per_group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies: of each group the smallest doc_id stays."""
    gone = materialise(near_groups(docs, n, percent, id_col, text_col, mark=True).filter("doc_id != component_id")
                       .select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__gone_mark")).distinct())
    # By the text too: other rows of the doc_id may hold a text that is no near copy.
    return docs.join(broadcast_if_small(gone), (F.col(id_col) == F.col("__gone")) & (F.xxhash64(text_col) == F.col("__gone_mark")), "left_anti")

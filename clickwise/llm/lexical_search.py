"""Ranked lexical search with hashed max-sketches.

A document's impact for a term grows with the term's occurrences and falls with the
document's length; a query's score for it is the sum of weight * impact over the
query's terms.

* **Sketch.** Each document's impacts fold into BUCKETS coordinates by the term's hash,
  every coordinate the maximum of what falls on it.  (Within one document the impact
  rises with the occurrences, so the largest count is kept and turned into the impact
  once the corpus' mean length is known: one pass over the texts.)
* **Upper bounds.** All queries at once are looked up in a batch of sketches: the sum of
  weight * coordinate is never below the score.
* **Exact rescoring, by descending bound.** The documents of the largest bounds are
  scored exactly; the K-th best score found is a query's threshold.  Further waves
  take the next bounds down to the threshold; the last one takes all that reach it, so
  nothing is lost, whatever the bounds' quality.

Equal texts are one entry of sketches and scores and become documents again at the
end, where only the K first of them matter.  The text is read once for the sketches
and once per wave that has candidates.  Queries are the stated set; they are taken in
blocks of QUERY_ITEMS, each against all documents.  Terms are told apart by 64-bit
hashes for counting and by their bytes for scoring.

Defined results: a null text, or one without terms, has no place in any ranking and
does not count; an item without terms has no rows; items that share an item_id are
ranked one by one; equal scores stand by doc_id, null first, and rows that repeat
doc_id and text follow each other; empty tables give no rows; other columns never
take part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clickwise.llm.common import broadcast_if_small, materialise
from clickwise.llm.shingles import BYTE_VALUE, U, mix, powers, slices

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
TOP_K = 10
# Candidates a query of each wave but the last, which takes all that are left.
WAVES = (64, 1024)
QUERY_ITEMS, QUERY_TERMS = 1000, 500_000
# Texts a task remembers not to treat twice.
SEEN_TEXTS = 100_000
DOCS_AT_ONCE = 256

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
IS_TERM = np.ones(256, bool)
IS_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

ENTRY = np.dtype([("bucket", "<u2"), ("tf", "<u4")])
Batches = Iterator[pa.RecordBatch]


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8").translate(ASCII_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + (75 * n * n_docs) // max(n_terms, 1)


def _term_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term; ``data`` is folded."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    end = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)), np.searchsorted(offsets, start, "right") - 1


def term_counts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text; text number, hash and occurrences of its distinct terms, by text and hash."""
    h, row = _term_hashes(offsets, data)
    n = np.bincount(row, minlength=len(offsets) - 1)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, np.int64)
    return n, row[first], h[first], np.diff(np.r_[first, len(h)])


def sketches(n_rows: int, row: np.ndarray, h: np.ndarray, tf: np.ndarray) -> pa.Array:
    """Each text's sketch: its buckets in order with the largest count that falls on them."""
    bucket = (h >> U(64 - BUCKET_BITS)).astype(np.int64)  # rises with the hash
    first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, np.int64)
    out = np.empty(len(first), ENTRY)
    if len(first):
        out["bucket"], out["tf"] = bucket[first], np.maximum.reduceat(tf, first)
    size = np.bincount(row[first], minlength=n_rows) * ENTRY.itemsize
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])


class _Seen:
    """The texts of a task so far, as far as a bounded memory goes."""

    def __init__(self):
        self.marks: set[str] = set()

    def fresh(self, marks: list[str]) -> np.ndarray:
        out = np.zeros(len(marks), bool)
        for i, m in enumerate(marks):
            if m not in self.marks:
                self.marks.add(m)
                out[i] = True
        if len(self.marks) > SEEN_TEXTS:
            self.marks.clear()
        return out


INDEX = "doc_id long, mark string, n long, sketch binary, counts binary"


def _index(query_hashes):
    def run(batches: Batches) -> Batches:
        wanted = query_hashes.value
        df, docs, terms, seen = np.zeros(len(wanted), np.int64), 0, 0, _Seen()
        for batch in batches:
            for first, offsets, data in slices(batch.column(2)):
                n, row, h, tf = term_counts(offsets, data)
                size = len(n)
                docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = wanted[at] == h
                df += np.bincount(at[hit], minlength=len(wanted))
                marks = batch.column(1).slice(first, size)
                fresh = seen.fresh(marks.to_pylist()) & (n > 0)
                sketch = sketches(size, row, h, tf)
                yield pa.record_batch([batch.column(0).slice(first, size), marks, pa.array(n),
                                       sketch.take(pa.array(np.where(fresh, np.arange(size), 0), mask=~fresh)), pa.nulls(size, pa.binary())],
                                      names=["doc_id", "mark", "n", "sketch", "counts"])
        packed = np.r_[docs, terms, df].astype(np.int64).tobytes()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())],
                              names=["doc_id", "mark", "n", "sketch", "counts"])
    return run


def _sum_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents, terms and the query terms' document counts, summed over the tasks' rows."""
    def spread(batches: Batches) -> Batches:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["i", "c"])
    rows = (index.filter("counts IS NOT NULL").select("counts").mapInArrow(spread, "i long, c long")
                 .groupBy("i").agg(F.sum("c").alias("c")).collect())  # at most one row per query term
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["i"]] = r["c"]
    return out


@dataclass
class Queries:
    """A block of items: their distinct terms (sorted by hash), each item's term numbers and weights."""
    ids: list
    terms: list[bytes]
    hashes: np.ndarray
    item_terms: list[np.ndarray]
    item_times: list[np.ndarray]
    n_docs: int = 0
    n_terms: int = 0
    weights: np.ndarray | None = None
    threshold: np.ndarray | None = None

    @staticmethod
    def of(items: list[tuple]) -> "Queries":
        bags = [terms_of(text) for _, text in items]
        items, bags = [x for x, b in zip(items, bags) if b], [b for b in bags if b]
        distinct = sorted({t for b in bags for t in b})
        data = b"".join(distinct)
        offsets = np.r_[0, np.cumsum([len(t) for t in distinct])].astype(np.int64)
        hashes, _ = _term_hashes(offsets, np.frombuffer(data, np.uint8))
        order = np.argsort(hashes, kind="stable")
        distinct, hashes = [distinct[i] for i in order], hashes[order]
        number = {t: i for i, t in enumerate(distinct)}
        pairs = [np.unique([number[t] for t in b], return_counts=True) for b in bags]
        return Queries([i for i, _ in items], distinct, hashes, [p[0] for p in pairs], [p[1] for p in pairs],
                       threshold=np.ones(len(items), np.int64))

    def with_counts(self, counts: np.ndarray) -> "Queries":
        self.n_docs, self.n_terms = int(counts[0]), int(counts[1])
        self.weights = np.array([weight(self.n_docs, int(df)) for df in counts[2:]], np.int64)
        return self

    def bucket_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket -> column (-1: no query term) and weights, columns by items."""
        bucket = (self.hashes >> U(64 - BUCKET_BITS)).astype(np.int64)
        used = np.unique(bucket)
        column = np.full(BUCKETS, -1)
        column[used] = np.arange(len(used))
        out = np.zeros((len(used), len(self.ids)))
        for k, (at, times) in enumerate(zip(self.item_terms, self.item_times)):
            np.add.at(out[:, k], column[bucket[at]], self.weights[at] * times)
        return column, out


def _bounds(batch: pa.RecordBatch, q: Queries, column: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and bounds (documents by items) of DOCS_AT_ONCE rows of (mark, n, sketch) at a time."""
    for at in range(0, batch.num_rows, DOCS_AT_ONCE):
        part = batch.slice(at, DOCS_AT_ONCE)
        packed = part.column(2).to_pylist()
        m = length_norm(part.column(1).to_numpy(), q.n_docs, q.n_terms)
        entries = np.frombuffer(b"".join(packed), ENTRY)
        row = np.repeat(np.arange(len(packed)), [len(p) // ENTRY.itemsize for p in packed])
        col = column[entries["bucket"]]
        hit = col >= 0
        sketch = np.zeros((len(packed), weights.shape[0]))
        sketch[row[hit], col[hit]] = impact(entries["tf"][hit].astype(np.int64), m[row[hit]])
        # Whole numbers below 2 ** 53 add up exactly; one more for any that are not.
        bound = sketch @ weights
        yield at, np.where(bound < 2.0 ** 53, bound, bound * (1 + 1e-9))


PAIRS = "mark string, item int, bound double"


def _candidates(shared, most: int | None):
    """Of each task and item the ``most`` largest bounds that reach the item's threshold (None: all)."""
    def pairs(marks, items, bounds):
        return pa.record_batch([pa.array(marks, pa.string()), pa.array(items.astype(np.int32)), pa.array(bounds)], names=["mark", "item", "bound"])

    def run(batches: Batches) -> Batches:
        q = shared.value
        column, weights = q.bucket_weights()
        low = q.threshold.astype(np.float64)
        kept = [(np.empty(0), np.empty(0, object))] * len(q.ids)
        for batch in batches:
            marks = np.array(batch.column(0).to_pylist(), object)
            for at, bound in _bounds(batch, q, column, weights):
                row, item = np.nonzero(bound >= low)
                if most is None:
                    if len(row):
                        yield pairs(marks[at + row], item, bound[row, item])
                    continue
                for k in np.unique(item).tolist():
                    mine = row[item == k]
                    b, m = np.r_[kept[k][0], bound[mine, k]], np.r_[kept[k][1], marks[at + mine]]
                    if len(b) > most:
                        top = np.argpartition(-b, most - 1)[:most]
                        b, m = b[top], m[top]
                        low[k] = max(low[k], b.min())
                    kept[k] = (b, m)
        for k, (b, m) in enumerate(kept):
            if len(b):
                yield pairs(m, np.full(len(b), k), b)
    return run


def exact_scores(text: str, q: Queries, number: dict[bytes, int]) -> np.ndarray:
    """The text's score for every item of the block."""
    tf, n = np.zeros(len(q.terms), np.int64), 0
    for t in terms_of(text):
        n += 1
        i = number.get(t)
        if i is not None:
            tf[i] += 1
    m = length_norm(np.array([n]), q.n_docs, q.n_terms)[0]
    value = q.weights * impact(tf, m)
    return np.array([int((value[at] * times).sum()) for at, times in zip(q.item_terms, q.item_times)], np.int64)


SCORES = "mark string, item int, score long"


def _rescored(shared, top_k: int):
    """Exact scores of (mark, text) rows, of each task and item those that can be among the
    ``top_k`` distinct texts (ties of the last included)."""
    def run(batches: Batches) -> Batches:
        q = shared.value
        number = {t: i for i, t in enumerate(q.terms)}
        low, best, held, seen = q.threshold.copy(), [[] for _ in q.ids], [], _Seen()
        for batch in batches:
            marks, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in np.flatnonzero(seen.fresh(marks)).tolist():
                score = exact_scores(texts[i].as_py(), q, number)
                for k in np.flatnonzero(score >= low).tolist():
                    held.append((marks[i], k, int(score[k])))
                    best[k] = sorted([*best[k], int(score[k])], reverse=True)[:top_k]
                    if len(best[k]) == top_k:
                        low[k] = max(low[k], best[k][-1])
        held = [h for h in held if h[2] >= low[h[1]]]
        if held:
            m, k, s = zip(*held)
            yield pa.record_batch([pa.array(m, pa.string()), pa.array(k, pa.int32()), pa.array(s, pa.int64())], names=["mark", "item", "score"])
    return run


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one block at a time on the driver."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len(terms_of(r["text"]))
        if block and (len(block) >= QUERY_ITEMS or size + n > QUERY_TERMS):
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def _search_block(spark: SparkSession, rows: DataFrame, q: Queries, top_k: int) -> DataFrame:
    """item (number in the block), mark, score of each item's best texts, ``top_k`` and ties, and
    the index's rows (doc_id, mark)."""
    sc = spark.sparkContext
    index = materialise(rows.mapInArrow(_index(sc.broadcast(q.hashes)), INDEX))
    q.with_counts(_sum_counts(index, len(q.hashes) + 2))
    entries = index.filter("sketch IS NOT NULL").select("mark", "n", "sketch")
    exact = None
    for most in (*WAVES, None):
        shared = sc.broadcast(q)
        found = entries.mapInArrow(_candidates(shared, most), PAIRS).groupBy("mark", "item").agg(F.max("bound").alias("bound"))
        if most is not None:
            place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "mark"))
            found = found.withColumn("place", place).filter(F.col("place") <= most)
        marks = found.select("mark").distinct()
        if exact is not None:
            marks = marks.join(tried, "mark", "left_anti")
        marks = materialise(marks)
        if marks.isEmpty():
            continue
        scores = materialise(rows.select("mark", "text").join(broadcast_if_small(marks), "mark", "left_semi")
                                 .mapInArrow(_rescored(shared, top_k), SCORES))
        exact, tried = (scores, marks) if exact is None else (exact.union(scores), tried.union(marks))
        exact = exact.distinct()
        nth = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "mark"))
        for r in exact.withColumn("nth", nth).filter(F.col("nth") == top_k).collect():  # a row per item
            q.threshold[r["item"]] = max(q.threshold[r["item"]], r["score"])
    if exact is None:
        return spark.createDataFrame([], "doc_id long, item int, score long")
    least = spark.createDataFrame([(k, int(t)) for k, t in enumerate(q.threshold)], "item int, least long")
    best = materialise(exact.join(F.broadcast(least), "item").filter("score >= least").select("item", "mark", "score"))
    # ``best``: ``top_k`` texts an item and ties of the last one.
    return index.filter("mark IS NOT NULL").select("doc_id", "mark").join(broadcast_if_small(best), "mark").select("doc_id", "item", "score")


def search(docs: DataFrame, items: DataFrame, top_k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top_k`` best documents with a score above 0."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("mark"), text.alias("text"))
    stated = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).orderBy("item_id", "text")
    out = []
    for block in _item_blocks(stated):
        q = Queries.of(block)
        if not q.ids:
            continue
        names = spark.createDataFrame(list(enumerate(q.ids)), "item int, item_id long")
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        out.append(_search_block(spark, rows, q, top_k).withColumn("rank", rank).filter(F.col("rank") <= top_k)
                   .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]

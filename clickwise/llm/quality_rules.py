"""Quality rules judged by an isolation forest over rule statistics.

1. One pass over the whole texts gives each document its rule counts (words,
   characters in words, symbols, repeated lines, words in repeated 3-word windows,
   and more) and the rule statistics made of them (``FEATURES``: shares and logs).
   From here on documents are a few numbers.
2. Two base rules fail a document outright: too few words, too many repeated ones.
3. An isolation forest of TREES trees is grown over the others: each tree splits
   TREE_ROWS sampled rows at random values of random statistics until they stand
   alone, all trees in parallel.  The sample is of distinct statistics (TREES *
   TREE_ROWS rows expected, a documented bound of what is fitted), so a large group
   of copies is one row and never makes itself look usual.
4. Each document's score is 2 ** -(mean path length / that of a random tree): short
   paths are anomalies.
5. The threshold comes from all labelled rows, as counts per score bin and label: the
   score that best tells good from bad texts, a lost good text weighing GOOD_WEIGHT
   bad ones.  A score at or above it is rejected.

All draws follow hashes of the rows and fixed seeds, so a run can be repeated.

Defined results: a null, empty or blank text has no words and fails the base rules;
rows that repeat a doc_id are judged one by one; a null doc_id has no label; without
labels of both kinds no document is rejected by its score; empty tables give no
rows; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickwise.llm.common import materialise
from clickwise.llm.shingles import BYTE_VALUE, IS_BLANK, PLACE, U, mix, powers, slices

# Small trees: rows of one kind of junk must not hide each other (masking).
TREES, TREE_ROWS = 200, 64
SCORE_BINS = 2000
GOOD_WEIGHT = 50
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WINDOW_WORDS = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# What the statistics are made of beside COUNTS.
MORE = ("n_chars", "n_lines", "n_letters", "n_upper", "n_marks", "n_distinct", "n_stutter", "n_short")
FEATURES = {
    "log_words": lambda c: np.log1p(c["n_words"]),
    "word_length": lambda c: c["word_chars"] / c["words"],
    "symbols": lambda c: np.log1p(1000 * c["n_symbols"] / c["chars"]),
    "dup_lines": lambda c: c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
    "repeat_words": lambda c: c["n_repeat_words"] / c["words"],
    "distinct": lambda c: c["n_distinct"] / c["words"] * np.log1p(c["n_words"]),
    "stutter": lambda c: np.log1p(1000 * c["n_stutter"] / c["words"]),
    "upper": lambda c: np.log1p(1000 * c["n_upper"] / np.maximum(c["n_letters"], 1)),
    "marks": lambda c: np.log1p(1000 * c["n_marks"] / c["chars"]),
    "short": lambda c: c["n_short"] / c["words"],
}

Batches = Iterator[pa.RecordBatch]


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


IS_SYMBOL = _table("#*$%&|<>")
IS_UPPER = _table(bytes(range(65, 91)))
IS_LETTER = IS_UPPER | _table(bytes(range(97, 123)))
IS_MARK = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
# Every byte but the later ones of a character.
IS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes and the length of every span."""
    up, down = powers(max(len(data), 1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[np.minimum(start, len(down) - 1)] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _seen_before(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether an earlier item of the same row has the same key."""
    order = np.lexsort((key, row))
    same = np.r_[False, (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])]
    out = np.zeros(len(row), bool)
    out[order] = same  # lexsort is stable: the first of a run is the earliest
    return out


def counts(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text; ``offsets`` and ``data`` as given by ``slices``."""
    n_rows = len(offsets) - 1
    if not len(data):
        return {c: np.zeros(n_rows, np.int64) for c in (*COUNTS, *MORE)}
    solid = ~IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    end = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    per_row = lambda rows: np.bincount(rows, minlength=n_rows).astype(np.int64)
    word = _hashes(data, start, end)
    chars = np.r_[0, np.cumsum(IS_CHAR[data], dtype=np.int64)]

    # Windows of WINDOW_WORDS words that the text holds twice or more cover their words.
    covered = np.zeros(len(word), bool)
    m = len(word) - WINDOW_WORDS + 1
    if m > 0:
        at = np.flatnonzero(row[:m] == row[WINDOW_WORDS - 1:])
        window = mix(sum((word[at + k] * PLACE[k] for k in range(WINDOW_WORDS)), U(0)))
        order = np.lexsort((window, row[at]))
        same = (window[order][1:] == window[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
        twice = at[order[np.r_[False, same] | np.r_[same, False]]]
        for k in range(WINDOW_WORDS):
            covered[twice + k] = True

    # Lines: from each text's begin or line feed to the next.
    feeds = np.flatnonzero(data == 10)
    line_start = np.sort(np.r_[offsets[:-1][np.diff(offsets) > 0], feeds + 1])
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    # A feed that ends its text opens an empty line, which holds no word.
    inside = (line_start < len(data)) & np.r_[np.diff(line_start) > 0, True]
    line_start, line_row = line_start[inside], line_row[inside]
    line_end = np.minimum(np.r_[feeds, len(data)][np.searchsorted(feeds, line_start)], offsets[line_row + 1])
    filled = np.r_[0, np.cumsum(solid, dtype=np.int64)]
    some = filled[line_end] > filled[line_start]
    line_start, line_end, line_row = line_start[some], line_end[some], line_row[some]
    dup = _seen_before(line_row, _hashes(data, line_start, line_end))

    length = chars[end] - chars[start]
    stutter = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1]))
    return {
        "n_words": per_row(row), "word_chars": _sums(solid & IS_CHAR[data], offsets), "n_symbols": _sums(IS_SYMBOL[data], offsets),
        "n_dup_lines": per_row(line_row[dup]), "n_repeat_words": per_row(row[covered]),
        "n_chars": _sums(IS_CHAR[data], offsets), "n_lines": per_row(line_row),
        "n_letters": _sums(IS_LETTER[data], offsets), "n_upper": _sums(IS_UPPER[data], offsets),
        "n_marks": _sums(IS_MARK[data], offsets),
        "n_distinct": per_row(row[~_seen_before(row, word)]), "n_stutter": per_row(row[stutter]), "n_short": per_row(row[length <= 3]),
    }


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The rule statistics, one column each."""
    c = {**c, "words": np.maximum(c["n_words"], 1), "chars": np.maximum(c["n_chars"], 1)}
    return np.stack([f(c).astype(np.float64) for f in FEATURES.values()], axis=1)


STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, x array<double>"


def _statistics(batches: Batches) -> Batches:
    for batch in batches:
        for first, offsets, data in slices(batch.column(1), fold=False):
            c = counts(offsets, data)
            x = features(c)
            n, k = x.shape
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0).slice(first, n), *(pa.array(c[name]) for name in COUNTS), pa.array(failed), lists],
                                  names=["doc_id", *COUNTS, "base_failed", "x"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed, x (FEATURES in order) per row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics, STATISTICS)


# A tree is six rows of numbers: statistic (-1: a leaf), split value, left child, right child, rows in it, depth.
def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One isolation tree over the rows of ``x``: random statistic, random value between
    the least and the largest, down to single rows or the mean depth of such a tree."""
    limit = max(1, int(np.ceil(np.log2(max(len(x), 2)))))
    nodes, open_nodes = [], [(np.arange(len(x)), 0, None, None)]
    while open_nodes:
        rows, level, parent, side = open_nodes.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, len(rows), level])
        if parent is not None:
            nodes[parent][side] = me
        if level == limit or len(rows) < 2:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        free = np.flatnonzero(high > low)
        if not len(free):
            continue
        f = int(rng.choice(free))
        at = float(rng.uniform(low[f], high[f]))
        left = x[rows, f] <= at
        nodes[me][:2] = [f, at]
        open_nodes += [(rows[left], level + 1, me, 2), (rows[~left], level + 1, me, 3)]
    return np.array(nodes, np.float64).T


def usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def anomaly(x: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    """Score of each row: 2 ** -(mean path / usual path), near 1 for anomalies."""
    total, usual = np.zeros(len(x)), 0.0
    for tree in trees:
        f, at, left, right = tree[0].astype(int), tree[1], tree[2].astype(int), tree[3].astype(int)
        length = tree[5] + usual_path(tree[4])
        node = np.zeros(len(x), int)
        for _ in range(int(tree[5].max())):
            go = x[np.arange(len(x)), np.maximum(f[node], 0)] <= at[node]
            node = np.where(go, left[node], right[node])  # a leaf is its own child
        total += length[node]
        usual += float(usual_path(tree[4][0]))
    return 2.0 ** -(total / usual) if usual else np.zeros(len(x))


def _grow_table(table: pa.Table) -> pa.Table:
    x = np.array(table.column("x").to_pylist(), np.float64)
    number = table.column("tree")[0].as_py()
    tree = grow(x[np.lexsort(x.T)], np.random.default_rng(number))
    return pa.table({"tree": pa.array([number], pa.int64()), "packed": pa.array([tree.tobytes()], pa.binary())})


def fit_forest(stats: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS) -> list[np.ndarray]:
    """The forest over the rows that pass the base rules; trees * tree_rows of their distinct
    statistics are drawn (expected), about ``tree_rows`` for each tree."""
    passed = stats.filter("NOT base_failed").select("x", F.xxhash64("x").alias("h"))
    n = passed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    # Few rows stand in several trees, as ``times`` draws of each; of many rows a share is drawn once.
    times = int(min(trees, max(1, np.ceil(trees * tree_rows / max(n, 1)))))
    share = min(1.0, trees * tree_rows / max(n * times, 1))
    if times > 1:  # distinct statistics are fewer than the draws; copies of them need not be drawn
        passed = passed.groupBy("h").agg(F.first("x").alias("x"))
    draw = F.explode(F.sequence(F.lit(1), F.lit(times)))
    unit = F.shiftrightunsigned(F.xxhash64("h", "draw", F.lit("draw")), 1) / F.lit(2.0 ** 63)
    drawn = (passed.withColumn("draw", draw).filter(unit < share)
                   .withColumn("tree", F.pmod(F.xxhash64("h", "draw", F.lit("tree")), F.lit(trees)))
                   .groupBy("tree", "h").agg(F.first("x").alias("x")))
    grown = drawn.groupBy("tree").applyInArrow(_grow_table, "tree long, packed binary")
    # ``trees`` rows of at most 2 * tree_rows nodes each, whatever the input.
    return [np.frombuffer(r["packed"], np.float64).reshape(6, -1) for r in sorted(grown.collect(), key=lambda r: r["tree"])]


def scored(stats: DataFrame, forest: list[np.ndarray]) -> DataFrame:
    """``stats`` with ``score`` in place of ``x``."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = anomaly(x, shared.value)
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")), pa.array(score)],
                                  names=["doc_id", *COUNTS, "base_failed", "score"])
    return stats.mapInArrow(run, STATISTICS.replace("x array<double>", "score double"))


def best_threshold(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, good_weight: float = GOOD_WEIGHT) -> float:
    """The bin border from which on rejecting gains most: bad texts caught less ``good_weight``
    times the good ones lost, in shares of either.  The highest such border; inf where
    nothing is gained or a kind is missing."""
    if not good.sum() or not bad.sum():
        return float("inf")
    order = np.argsort(-bins)
    gain = np.cumsum(bad[order]) / bad.sum() - good_weight * np.cumsum(good[order]) / good.sum()
    best = int(np.argmax(gain))
    return float(bins[order][best] / SCORE_BINS) if gain[best] > 0 else float("inf")


def calibrate(judged: DataFrame, labels: DataFrame, good_weight: float = GOOD_WEIGHT) -> float:
    """Threshold on ``score`` from every labelled row that passes the base rules; ``labels`` has
    doc_id and quality (1 good, 0 bad; of several labels of a doc_id the least)."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = (judged.filter("NOT base_failed").select("doc_id", F.floor(F.col("score") * SCORE_BINS).alias("bin")).join(known, "doc_id")
             .groupBy("bin").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad"))
             .collect())  # at most SCORE_BINS rows
    bins, good, bad = (np.array([r[c] for r in found], np.float64) for c in ("bin", "good", "bad"))
    return best_threshold(bins, good, bad, good_weight)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES,
          tree_rows: int = TREE_ROWS, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """doc_id, COUNTS, base_failed, score, kept per row of ``docs``."""
    stats = materialise(statistics(docs, id_col, text_col))
    judged = materialise(scored(stats, fit_forest(stats, trees, tree_rows)))
    threshold = calibrate(judged, labels, good_weight)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(threshold)))

"""Quality classifier from weak labels.

1. Heuristic labellers look at statistics of the whole text (symbols, capitals,
   stutter, vocabulary, repeated phrases, marks, word length) and each votes
   junk, good, or not at all.  The documents are counted per vote pattern, at
   most 3 ** 7 of them.
2. Expectation-maximisation over the pattern counts estimates how often each
   labeller is right on junk and on good texts (no labels are used), and gives
   every pattern a probability of being good.
3. A linear scorer over hashed features (byte trigrams and binned statistics)
   is trained on those probabilities over a sample of TRAIN_ROWS documents (its
   labels come from all documents).  Copies of a text are one row with a weight,
   the number of them drawn, so no group of copies makes the sample longer.
4. The scorer scores every whole document; documents under KEEP_FROM go.

Labels and sample depend on the documents alone, so a run can be repeated.

Defined results: null and empty (or blank) texts score 0 and are not kept;
repeated rows and null doc_ids are scored like others; an empty table gives no
rows; other columns, whatever their names, pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickwise.llm.common import broadcast_if_small, frugal, materialise
from clickwise.llm.shingles import U, shingle_sets, slices, words

KEEP_FROM = 0.5
TRAIN_ROWS = 6000
TRIGRAM_BITS = 12
BINS = 8
SCALE = 30.0

# Statistic: junk from, good below (or between), fewest words to vote; None: never.
LABELLERS = {
    "symbols": (lambda s: s > 0.03, lambda s: s < 0.005, 20),
    "capitals": (lambda s: s > 0.3, lambda s: s < 0.1, 10),
    "stutter": (lambda s: s > 0.15, lambda s: s < 0.04, 12),
    "few_words": (lambda s: s > 0.65, lambda s: s < 0.5, 50),
    "phrases": (lambda s: s > 0.4, lambda s: s < 0.15, 50),
    "marks": (lambda s: s > 0.2, lambda s: s < 0.02, 10),
    "word_length": (lambda s: (s > 8.5) | (s < 3.5), lambda s: (s > 4.5) & (s < 7.5), 30),
}
EDGES = {
    "symbols": [0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16],
    "capitals": [0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8],
    "stutter": [0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6],
    "few_words": [0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8],
    "phrases": [0.02, 0.05, 0.1, 0.15, 0.3, 0.5, 0.8],
    "marks": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "word_length": [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0],
}
N_FEATURES = (1 << TRIGRAM_BITS) + len(LABELLERS) * BINS

IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LETTER = IS_UPPER.copy()
IS_LETTER[97:123] = True
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-"]] = True
IS_MARK = np.zeros(256, bool)
IS_MARK[[ord("!"), ord("|")]] = True

Batches = Iterator[pa.RecordBatch]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Number of words, and each labeller's statistic, per text."""
    n_rows = len(offsets) - 1
    word, row = words(offsets, data)
    n = np.bincount(row, minlength=n_rows)
    some, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    same = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) if len(word) else []
    distinct, pairs = (np.bincount(shingle_sets(offsets, data, k)[0], minlength=n_rows) for k in (1, 2))
    return n, {
        "symbols": _per_row(IS_SYMBOL[data], offsets) / size,
        "capitals": _per_row(IS_UPPER[data], offsets) / np.maximum(_per_row(IS_LETTER[data], offsets), 1),
        "stutter": (np.bincount(row[same], minlength=n_rows) if len(same) else np.zeros(n_rows)) / some,
        "few_words": 1 - distinct / some,
        "phrases": np.maximum(0, 1 - pairs / np.maximum(n - 1, 1)),
        "marks": _per_row(IS_MARK[data], offsets) / some,
        "word_length": size / some,
    }


def patterns(n: np.ndarray, stats: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all labellers as one base-3 number: 0 no vote, 1 junk, 2 good."""
    out = np.zeros(len(n), np.int32)
    for name, (junk, good, least) in LABELLERS.items():
        vote = np.where(junk(stats[name]), 1, np.where(good(stats[name]), 2, 0))
        out = out * 3 + np.where(n >= least, vote, 0).astype(np.int32)
    return out


def _votes(pattern: np.ndarray) -> np.ndarray:
    digits = [pattern // 3 ** k % 3 for k in reversed(range(len(LABELLERS)))]
    return np.stack(digits, axis=1)


def label_model(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good per pattern; per labeller how often its vote is right
    on junk and on good texts.  EM from the majority vote."""
    votes = _votes(pattern)
    junk, good = (votes == 1).astype(float), (votes == 2).astype(float)
    voted = junk + good
    prob = (good.sum(1) + 1) / (voted.sum(1) + 2)
    for _ in range(rounds):
        g, b = count * prob, count * (1 - prob)
        # One pseudo-vote each keeps the rates off 0 and 1.
        right_good = (g @ good + 1) / (g @ voted + 2)
        right_junk = (b @ junk + 1) / (b @ voted + 2)
        prior = (g.sum() + 1) / (count.sum() + 2)
        log_g = np.log(prior) + good @ np.log(right_good) + junk @ np.log(1 - right_good)
        log_b = np.log(1 - prior) + junk @ np.log(right_junk) + good @ np.log(1 - right_junk)
        prob = 1 / (1 + np.exp(np.clip(log_b - log_g, -500, 500)))
    return prob, right_junk, right_good


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams and their rows."""
    if len(data) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    d = data.astype(np.uint32)
    h = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - TRIGRAM_BITS)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return h[inside].astype(np.int32), row[:-2][inside]


def _bins(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Feature number of each statistic's bin, one column per labeller."""
    return np.stack([(1 << TRIGRAM_BITS) + k * BINS + np.digitize(stats[name], EDGES[name]) for k, name in enumerate(LABELLERS)], axis=1)


def _pattern_rows(batches: Batches) -> Batches:
    for batch in batches:
        for first, offsets, data in slices(batch.column(0), fold=False):
            yield pa.record_batch([batch.column(1).slice(first, len(offsets) - 1), pa.array(patterns(*statistics(offsets, data)))], names=["mark", "pattern"])


def _feature_rows(prob: dict[int, float]):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first, offsets, data in slices(batch.column(0), fold=False):
                n, stats = statistics(offsets, data)
                pattern, bins = patterns(n, stats), _bins(stats)
                gram, row = _trigrams(data, offsets)
                out = []
                for i in np.flatnonzero(pattern).tolist():
                    x = np.zeros(N_FEATURES, np.float32)
                    lo, hi = np.searchsorted(row, [i, i + 1])
                    x[:1 << TRIGRAM_BITS] = np.bincount(gram[lo:hi], minlength=1 << TRIGRAM_BITS) * (SCALE / max(1, hi - lo))
                    x[bins[i]] = 1
                    out.append(x.tobytes())
                keep = np.flatnonzero(pattern)
                mark, weight = (batch.column(c).slice(first, len(n)).take(pa.array(keep)) for c in (1, 2))
                yield pa.record_batch([mark, weight, pa.array(out, pa.binary()),
                                       pa.array([prob[p] for p in pattern[keep].tolist()], pa.float64())], names=["mark", "weight", "x", "good"])
    return run


def fit(x: np.ndarray, good: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-4, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on soft labels by full-batch Adam; bias last.  A row counts ``weight`` times."""
    weight = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        miss = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - good)
        miss = (miss * weight).astype(np.float32)
        grad = np.append(x.T @ miss, miss.sum()) / float(weight.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _fit_table(table: pa.Table) -> pa.Table:
    table = table.sort_by("mark")  # a sorted copy: its buffers start at row 0
    column = table.column("x").combine_chunks()
    x = np.frombuffer(column.buffers()[2], np.float32)[:len(column) * N_FEATURES].reshape(-1, N_FEATURES)
    return pa.table({"w": pa.array([fit(x, table.column("good").to_numpy(), weight=table.column("weight").to_numpy()).tobytes()], pa.binary())})


def drawn(texts: DataFrame, share: float) -> DataFrame:
    """mark, weight: of ``texts`` (mark, n copies) those in the sample.  The copies drawn are
    n * share, rounded up or down by the mark, so the weights add to all rows * share on average."""
    at = F.shiftrightunsigned("mark", 1) / F.lit(2.0 ** 63)
    return texts.select("mark", F.ceil(F.col("n") * F.lit(float(share)) - at).cast("long").alias("weight")).filter("weight > 0")


def sampled(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[DataFrame | None, np.ndarray, np.ndarray]:
    """text, mark, weight of the training texts, each once; the vote patterns and their counts."""
    texts = docs.select(F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text", F.lit("train")))
    counted = materialise(texts.mapInArrow(frugal(_pattern_rows), "mark long, pattern int").groupBy("mark", "pattern").agg(F.count(F.lit(1)).alias("n")))
    found = counted.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3 ** 7 rows
    pattern, count = (np.array([r[c] for r in found], np.int64) for c in ("pattern", "n"))
    if not pattern.any():
        return None, pattern, count
    few = materialise(drawn(counted.filter("pattern != 0"), min(2.0, train_rows / count.sum())))
    return texts.join(broadcast_if_small(few), "mark").groupBy("mark", "text").agg(F.max("weight").alias("weight")).select("text", "mark", "weight"), pattern, count


def train(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the scorer, bias last."""
    texts, pattern, count = sampled(docs, text_col, train_rows)
    if texts is None:
        return np.zeros(N_FEATURES + 1, np.float32)
    prob, _, _ = label_model(pattern, count)
    sample = texts.mapInArrow(frugal(_feature_rows(dict(zip(pattern.tolist(), prob.tolist())))), "mark long, weight long, x binary, good double")
    # Distinct texts, about ``train_rows`` of them at most whatever is copied, so one task can hold them.
    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit_table, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32) if found else np.zeros(N_FEATURES + 1, np.float32)


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The scorer's probability of good per text; 0 where there is no word."""
    out = []
    for _, offsets, data in slices(texts, fold=False):
        n, stats = statistics(offsets, data)
        gram, row = _trigrams(data, offsets)
        total = np.bincount(row, weights=weights[gram], minlength=len(n))
        z = SCALE * total / np.maximum(np.bincount(row, minlength=len(n)), 1) + weights[_bins(stats)].sum(1) + weights[-1]
        out.append(np.where(n > 0, 1 / (1 + np.exp(-z)), 0.0))
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, kept per row."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, train_rows))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            s = scores(batch.column(1), weights.value)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array(s >= keep_from)], names=["doc_id", "score", "kept"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(frugal(run), "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", keep_from: float = KEEP_FROM, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is good enough."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, train_rows))
    at = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), weights.value) >= keep_from))
    return docs.mapInArrow(frugal(run), docs.schema)

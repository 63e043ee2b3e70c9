"""Rule counts against plain Python, the forest against its definition, held-out labels."""

import re

import numpy as np
import pytest

from clickwise.llm import quality_rules as rules
from clickwise.llm.common import read_table
from clickwise.llm.shingles import slices
from tests.conftest import SF001, SF01
from tests.llm import odd

TRICKY = ["", "\n", "\n\n", "a", "a\n", "\na", "a\na", "a\na\n", "a\n\na\na", "x y\nx y\n x y\nx y", "a b c a b c", "a b c a b c a", "a a a a",
          "a a a", "é É ü # $$ <b>\t|&|", "a b c\nd e f\na b c\nd e f", "one two three " * 30, "\r\na\r\na", "a\x0bb\x0cc", "中国 🙂 中国 🙂 中国 🙂"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def judged(df):
    return {r.doc_id: tuple(r)[1:7] for r in df.collect()}


def test_counts_equal_plain_python(spark):
    docs = {r.doc_id: r.text for r in read_table(spark, SF001, "documents").collect()}
    got = judged(rules.judge(read_table(spark, SF001, "documents"), read_table(spark, SF001, "labels")))
    assert got == {d: plain(t) for d, t in docs.items()}


def test_tricky_texts(spark):
    """All in one slice, so texts stand side by side in memory."""
    got = judged(rules.statistics(table(spark, TRICKY).coalesce(1)).drop("x"))
    assert got == {i: plain(t) for i, t in enumerate(TRICKY)}


def test_held_out_labels(spark):
    """Calibrated on even doc_ids, judged on odd ones, among texts that pass the base rules."""
    labels = read_table(spark, SF01, "labels")
    rows = {r.doc_id: r for r in rules.judge(read_table(spark, SF01, "documents"), labels.filter("doc_id % 2 = 0")).collect()}
    odd_labels = [(rows[r.doc_id], r.quality) for r in labels.filter("doc_id % 2 = 1").collect()]
    kept = {q: [x.kept for x, y in odd_labels if y == q and not x.base_failed] for q in (0, 1)}
    assert len(kept[0]) > 5 and len(kept[1]) > 100
    assert np.mean(kept[1]) >= 0.98 and np.mean(kept[0]) <= 0.1


def test_path_lengths_and_scores():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(255, 2)), [[9.0, 9.0]]]
    trees = [rules.grow(x[rng.choice(256, 64, replace=False)], np.random.default_rng(i)) for i in range(100)]
    score = rules.anomaly(x, trees)
    assert score.argmax() == 255 and score[-1] > 0.6 and np.median(score) < 0.55

    def plain_path(tree, row):
        node = 0
        while tree[0, node] >= 0:
            node = int(tree[2, node] if row[int(tree[0, node])] <= tree[1, node] else tree[3, node])
        return tree[5, node] + float(rules.usual_path(tree[4, node]))
    want = [2 ** -(np.mean([plain_path(t, row) for t in trees]) / float(rules.usual_path(64))) for row in x]
    assert np.allclose(score, want)
    for tree in trees:
        assert tree[4, tree[0] < 0].sum() == 64 and tree[5].max() <= 6
    assert rules.usual_path(1) == 0 and rules.usual_path(2) == 1 and rules.usual_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_threshold_follows_the_weight():
    bins, good, bad = np.array([10, 20, 30, 40]), np.array([97, 2, 1, 0]), np.array([0, 5, 5, 10])
    assert rules.best_threshold(bins, good, bad, 0) == 20 / rules.SCORE_BINS
    assert rules.best_threshold(bins, good, bad, 30) == 40 / rules.SCORE_BINS
    assert rules.best_threshold(bins, good, 0 * bad) == rules.best_threshold(bins, 0 * good, bad) == float("inf")


def test_without_labels_only_the_base_rules_reject(spark):
    docs = read_table(spark, SF001, "documents")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in rules.judge(docs, none).collect())


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 1), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    rows = rules.judge(odd.docs(spark).withColumnsRenamed({"ident": "score", "node": "kept"}), labels).collect()
    want = sorted([(r[0], *plain(r[1])) for r in odd.ROWS], key=str)
    assert sorted([(r.doc_id, *tuple(r)[1:7]) for r in rows], key=str) == want
    assert rules.judge(odd.empty(spark), labels).count() == 0
    assert rules.judge(odd.empty(spark), labels.limit(0)).count() == 0


def test_runs_agree_and_copies_do_not_change_the_forest(spark):
    docs = read_table(spark, SF001, "documents", "doc_id", "text")
    labels = read_table(spark, SF001, "labels")
    a, b = (sorted(map(tuple, rules.judge(d, labels).collect())) for d in (docs, docs.repartition(7)))
    assert a == b
    hot = docs.limit(1).crossJoin(spark.range(3000)).select("doc_id", "text")
    one, many = (rules.fit_forest(rules.statistics(d)) for d in (docs, docs.union(hot)))
    assert len(one) == len(many) and all(np.array_equal(x, y) for x, y in zip(one, many))


def test_slices_give_the_same_counts():
    import pyarrow as pa
    texts = [t for t in TRICKY for _ in range(3)]
    for _, offsets, data in slices(pa.array(texts), fold=False):
        got = rules.counts(offsets, data)
        assert [tuple(int(got[c][i]) for c in rules.COUNTS) for i in range(len(texts))] == [plain(t)[:5] for t in texts]

"""Weak-label model and scorer: held-out labels, recovered accuracies, odd rows."""

import numpy as np

from clickwise.llm import quality
from clickwise.llm.common import read_table
from tests.conftest import SF01
from tests.llm import odd


def test_held_out_labels(spark):
    """The classifier sees no labels; they judge it."""
    kept = {r.doc_id: r.kept for r in quality.score(read_table(spark, SF01, "documents")).collect()}
    labels = read_table(spark, SF01, "labels").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1]
    junk = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(junk) <= 0.1


def test_em_recovers_labeller_accuracies():
    rng = np.random.default_rng(0)
    k, n = len(quality.LABELLERS), 40_000
    good = rng.random(n) < 0.7
    right = np.linspace(0.6, 0.95, k)
    votes = np.where(rng.random((n, k)) < 0.6, np.where(rng.random((n, k)) < right, good[:, None], ~good[:, None]) + 1, 0)
    pattern, count = np.unique(votes @ 3 ** np.arange(k)[::-1], return_counts=True)
    prob, on_junk, on_good = quality.label_model(pattern, count)
    assert np.abs(on_junk - right).max() < 0.05 and np.abs(on_good - right).max() < 0.05
    assert abs((prob * count).sum() / n - 0.7) < 0.03


def test_scorer_learns_soft_labels():
    rng = np.random.default_rng(1)
    x = rng.random((500, 20)).astype(np.float32)
    y = 1 / (1 + np.exp(-(6 * x[:, 0] - 6 * x[:, 1])))
    w = quality.fit(x, y)
    z = np.hstack([x, np.ones((500, 1), np.float32)]) @ w
    assert np.corrcoef(1 / (1 + np.exp(-z)), y)[0, 1] > 0.98


def test_odd_rows(spark):
    rows = quality.score(odd.docs(spark)).collect()
    assert len(rows) == len(odd.ROWS)
    assert {r.doc_id: (r.score, r.kept) for r in rows if r.doc_id in (1, 2, 3)} == {i: (0.0, False) for i in (1, 2, 3)}
    assert quality.score(odd.empty(spark)).count() == 0 and quality.keep_good(odd.empty(spark)).count() == 0
    kept = quality.keep_good(odd.docs(spark))
    assert kept.columns == odd.docs(spark).columns
    scored = sorted(str(r.doc_id) for r in rows if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == scored


def test_two_runs_agree(spark):
    docs = read_table(spark, SF01, "documents", "doc_id", "text")
    a, b = (sorted(map(tuple, quality.score(d, train_rows=300).collect())) for d in (docs, docs.repartition(5)))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-4)


def test_more_likely_junk_than_good_goes(spark):
    """The bound is the scorer's own even odds, in op8 and in the pipeline's stage."""
    docs = read_table(spark, SF01, "documents", "doc_id", "text")
    assert quality.KEEP_FROM == 0.5
    rows = quality.score(docs).collect()
    assert all(r.kept == (r.score >= 0.5) for r in rows)
    assert quality.keep_good(docs).count() == sum(r.score >= 0.5 for r in rows)


def test_copies_do_not_lengthen_the_sample(spark):
    """A third of all rows are one text: drawn or not, it is one row, with its share as weight."""
    docs = read_table(spark, SF01, "documents", "text").limit(300)
    texts = [r.text for r in docs.collect()]
    rows = [(t,) for t in texts] + [(t,) for t in texts[:5] for _ in range(600)]
    sample, _, count = quality.sampled(spark.createDataFrame(rows, "text string"), train_rows=60)
    got = sample.collect()
    assert count.sum() == len(rows) and len({r.mark for r in got}) == len(got) <= 60
    weight = {r.text: r.weight for r in got}
    want = 601 * 60 / len(rows)
    assert all(abs(weight.get(t, 0) - want) < 2 for t in texts[:5])
    assert sum(weight.values()) <= 60 + 2 * 5 + 20


def test_a_weight_is_as_many_rows():
    rng = np.random.default_rng(2)
    x, y, n = rng.random((50, 8)).astype(np.float32), rng.random(50), rng.integers(1, 5, 50)
    assert np.allclose(quality.fit(x, y, weight=n), quality.fit(np.repeat(x, n, 0), np.repeat(y, n)), atol=1e-3)

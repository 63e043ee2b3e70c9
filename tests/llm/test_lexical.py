"""Search against a plain scoring of every pair, with waves of every size."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from clickwise.llm import lexical_search as lex
from clickwise.llm.common import read_table
from clickwise.llm.shingles import slices
from tests.conftest import SF001
from tests.llm import odd
from tests.llm.brute import fold


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(text))


def plain_search(docs, items, k=10):
    bags = [(d, plain_terms(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms, df = len(bags), sum(len(b) for _, b in bags), {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 75 + (75 * len(b) * n_docs) // n_terms
            s = 0
            for t in plain_terms(text):
                if t in df:
                    tf = b.count(t)
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("waves", [(64, 1024), (1,), (10, 11), ()])
def test_equals_scoring_every_pair(spark, monkeypatch, waves):
    monkeypatch.setattr(lex, "WAVES", waves)
    docs, items = read_table(spark, SF001, "documents"), read_table(spark, SF001, "benchmark")
    want = plain_search(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert result(lex.search(docs.repartition(4), items)) == want


def test_blocks_of_items(spark, monkeypatch):
    docs, items = read_table(spark, SF001, "documents"), read_table(spark, SF001, "benchmark").limit(7)
    whole = result(lex.search(docs, items))
    monkeypatch.setattr(lex, "QUERY_ITEMS", 3)
    assert result(lex.search(docs, items)) == whole


def test_ties_copies_and_repeated_rows(spark):
    """A third of all rows are one text; copies stand by doc_id, and are not cut off by the waves."""
    texts = ["red fox runs"] * 40 + ["red fox", "fox red", "red dog sleeps", "blue bird", "", None, "...", "RED fox runs"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "red fox runs")] * 2 + [(None, "red fox")]
    items = [(1, "Red fox"), (1, "bird"), (2, "!!"), (3, None), (4, "unheard of"), (5, "red red red"), (None, "fox runs")]
    got = result(lex.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_search(docs, items)


def test_odd_rows(spark):
    docs = odd.docs(spark).withColumnsRenamed({"ident": "mark", "node": "score"})
    items = spark.createDataFrame([(1, "same text one word5", "x"), (2, "中国 Ünï x", "y")], "item_id long, text string, doc_id string")
    assert result(lex.search(docs, items)) == plain_search(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert lex.search(odd.empty(spark), items).count() == 0
    assert lex.search(docs, items.limit(0)).count() == 0


def test_bounds_are_never_below_the_scores():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 1500)) % 20_000) for _ in range(100)]
    q = lex.Queries.of([(i, " ".join(f"w{x}" for x in rng.integers(0, 20_000, 40))) for i in range(10)])
    for _, offsets, data in slices(pa.array(texts)):
        n, row, h, tf = lex.term_counts(offsets, data)
        sketch = lex.sketches(len(texts), row, h, tf)
        df = [int((h == x).sum()) for x in q.hashes]
        q.with_counts(np.r_[len(texts), n.sum(), df])
        column, weights = q.bucket_weights()
        batch = pa.record_batch([pa.array([str(i) for i in range(len(texts))]), pa.array(n), sketch], names=["mark", "n", "sketch"])
        bound = np.concatenate([b for _, b in lex._bounds(batch, q, column, weights)])
        number = {t: i for i, t in enumerate(q.terms)}
        exact = np.stack([lex.exact_scores(t, q, number) for t in texts])
        assert (bound >= exact).all() and (bound == exact).any() and max(len(s) for s in sketch.to_pylist()) <= lex.BUCKETS * lex.ENTRY.itemsize

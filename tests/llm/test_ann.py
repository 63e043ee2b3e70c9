"""Nearest neighbours against brute force."""

import random

import numpy as np

from clickwise.llm import ann_forest


def exact(rows, k, every):
    out = {}
    for q, v in rows:
        if q is not None and q % every == 0:
            near = sorted(((-float((np.array(w) * np.array(v)).sum()), i) for i, w in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(spark, rows, schema="vec_id long, embedding array<float>, label int, rank string", **kw):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], schema)
    out = {}
    for r in sorted(ann_forest.nearest(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_small_tables_are_searched_whole(spark):
    rnd = random.Random(1)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1 + i % 3))) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, rows[i % 2][1]) for i in range(40)]  # ties
    got, want = found(spark, rows, k=20, every=20, target=1.0), exact(rows, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = found(spark, rows, k=20, every=20), exact(rows, 20, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert got.keys() == want.keys() and recall >= 0.9
    for q in got:  # scores are exact, order is by score and id
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float((np.array(rows[i][1]) * np.array(rows[q][1])).sum())) < 1e-12 for i, s in got[q])


def test_a_third_of_copies(spark):
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [float(i % 7), float(i % 5 + 1)]) for i in range(300)]
    got, want = found(spark, rows, k=20, every=20, target=1.0), exact(rows, 20, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0]),
            (None, [1.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (160, [1.0, 2.0])]
    got = found(spark, rows, k=20, every=20)
    assert got == {0: [(160, 5.0), (1, 4.0)], 160: [(0, 5.0), (1, 4.0)]}
    assert found(spark, []) == {} and found(spark, [(20, None)]) == {} and found(spark, [(20, [1.0])]) == {}


def test_a_longer_vector_drops_no_other(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(100, [1.0] * 5)]
    got, want = found(spark, rows, "vec_id long, embedding array<double>, label int, rank string", k=5, every=20, target=1.0), exact(rows[:-1], 5, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_salted_groups_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(8) + (i % 4 == 0)).astype(np.float32).tolist()) for i in range(800)]
    whole = found(spark, rows, k=20, every=20)
    monkeypatch.setattr(ann_forest, "GROUP_ROWS", 50)
    assert found(spark, rows, k=20, every=20) == whole


def test_a_stretch_is_searched_like_each_query_alone():
    """Queries of one prefix share a product; each still meets its own prefix's classes only."""
    import pyarrow as pa
    rng = np.random.default_rng(7)
    h, x = rng.integers(0, 1 << ann_forest.BITS, 300), rng.standard_normal((300, 4))
    qh, depth, q = rng.integers(0, 1 << ann_forest.BITS, 90), rng.integers(0, 5, 90), rng.standard_normal((90, 4))
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    left = pa.table({"h": h, "cid": np.arange(300), "v": lists(x)})
    right = pa.table({"h": qh, "depth": depth, "cid": np.arange(1000, 1090), "v": lists(q)})
    got = {}
    for r in ann_forest._search(4, 5)(left, right).to_pylist():
        got.setdefault(r["query"], []).append(r["cid"])
    for i in range(90):
        shift = ann_forest.BITS - int(depth[i])
        near = [c for c in range(300) if h[c] >> shift == qh[i] >> shift]
        assert got.get(1000 + i, []) == sorted(near, key=lambda c: -(x[c] * q[i]).sum())[:6]

"""N-gram Jaccard join and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clickwise.llm import ngram_join
from clickwise.llm.components import components
from tests.llm import odd
from tests.llm.brute import near_groups, shingles


def groups(spark, rows, n, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(df, n, percent).collect()}


def corpus(seed, n_docs=220):
    """Near copies of a few texts, shared passages, and texts of their own."""
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(4000)
    bases = [[word() for _ in range(rnd.choice([12, 60, 140]))] for _ in range(6)]
    passage = [word() for _ in range(60)]
    out = []
    for d in range(n_docs):
        kind = rnd.random()
        if kind < 0.6:
            w = list(bases[min(rnd.randrange(9), 5)])
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w.insert(rnd.randrange(len(w)), word())
        elif kind < 0.8:
            w = [word() for _ in range(rnd.randrange(20, 80))] + passage
        else:
            w = [word() for _ in range(rnd.randrange(1, 50))]
        out.append((d, rnd.choice([" ", "\n", "  "]).join(w)))
    return out + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "only two"), (1004, "Only TWO"), (1005, "two only"), (1006, "é É ê"), (1007, "é é ê")]


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 3, 60)])
def test_components_equal_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    got, want = groups(spark, rows, n, percent), near_groups(rows, n, percent)
    assert {d: v for d, v in got.items() if want[d][0]} == {d: v for d, v in want.items() if v[0]}
    assert all(got[d] == (0, d) for d, v in want.items() if not v[0])
    assert any(c != d for d, (_, c) in want.items())


def test_a_large_group_of_near_copies(spark):
    """A third of all texts are near copies of one: linked without comparing all pairs."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(900):
        w = list(base) if d % 3 == 0 else [f"u{d}-{i}" for i in range(40)]
        if d % 3 == 0:
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    assert groups(spark, rows, 4, 85) == near_groups(rows, 4, 85)


def test_odd_rows(spark):
    out = ngram_join.near_groups(odd.docs(spark)).collect()
    assert len(out) == len(odd.ROWS)
    by = {(r.doc_id, r.component_id) for r in out}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (11, 4), (6, 6), (7, 6), (None, None)} <= by
    assert ngram_join.near_groups(odd.empty(spark)).count() == 0
    kept = ngram_join.keep_one_per_group(odd.docs(spark))
    assert kept.columns == odd.docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 8, 9, 10, 12]
    assert kept.filter("doc_id IS NULL").count() == 2


def test_shingle_counts_match_plain_python(spark):
    rows = corpus(7, 60)
    got = groups(spark, rows, 4, 85)
    assert {d: n for d, (n, _) in got.items()} == {d: len(shingles(t, 4)) for d, t in rows}


def test_live_postings_over_any_batch_cut():
    """The stream of sorted postings may be cut anywhere."""
    rnd = random.Random(2)
    post = sorted({(rnd.randrange(40), -(a % 2), a, 0) for a in [rnd.randrange(6) for _ in range(300)]} | {(t, 0, 8, 0) for t in range(30, 60)})
    post = [(t, a, b, 100, 0, -c) for t, c, a, b in post for _ in range(rnd.choice([1, 1, 3]))]
    names = ["token", "a", "b", "n", "pos", "central"]

    def run(cuts):
        batches = [pa.record_batch([pa.array([p[i] for p in post[x:y]], pa.int64()) for i in range(6)], names=names) for x, y in zip([0, *cuts], [*cuts, len(post)])]
        out = [tuple(r.values()) for b in ngram_join._live(iter(batches), 80) for r in b.to_pylist()]
        return {(r[0], r[1], r[5]) for r in out}, {(r[0], r[1]) for r in out if r[9]}
    whole = run([])
    for _ in range(30):
        assert run(sorted(rnd.sample(range(len(post) + 1), rnd.randrange(1, 60)))) == whole


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (200, 105)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 105: 105, 200: 105}
    assert np.array_equal(sorted(got), sorted({x for p in links for x in p}))


def test_a_clean_text_stays_beside_a_near_copy_of_its_doc_id(spark):
    base, own = [f"b{i}" for i in range(60)], " ".join(f"o{i}" for i in range(60))
    rows = [(1, " ".join(base)), (7, " ".join(base[:-1] + ["z"])), (7, own), (9, own + " more")]
    kept = ngram_join.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[2]])


def test_texts_just_below_the_bound_form_no_pairs(spark, monkeypatch):
    """600 texts share 100 of 113 to 117 shingles: a join on the shingle alone would form 180,000 pairs."""
    formed = []
    apart = ngram_join._apart

    def counted(live, label, percent):
        out = apart(live, label, percent)
        formed.append((live.count(), out.count()))
        return out
    monkeypatch.setattr(ngram_join, "_apart", counted)
    frame = [f"f{i}" for i in range(103)]
    rows = [(d, " ".join(frame + [f"o{d}-{i}" for i in range(13 + d % 5)])) for d in range(600)]
    rows += [(1000 + d, rows[d][1] + " more") for d in range(0, 600, 100)]
    got = groups(spark, rows, 4, 85)
    assert {d: c for d, (_, c) in got.items()} == {d: d - 1000 if d >= 1000 else d for d, _ in rows}
    (postings, pairs), = formed
    assert pairs <= len(rows) and postings < 40 * len(rows)


def test_meetable_keeps_every_possible_pair(spark):
    """Against all pairs of a shingle: a posting that can meet another one stays."""
    rnd = random.Random(4)
    rows = []
    for token in range(60):
        for _ in range(rnd.randrange(1, 12)):
            n = rnd.randrange(5, 200)
            rows.append((token, n, rnd.randrange(0, n - -(-80 * n // 100) + 1)))
    kept = {(r.token, r.n, r.pos) for r in ngram_join._meetable(spark.createDataFrame(rows, "token long, n long, pos long"), 80).collect()}
    can = set()
    for i, (t, n, p) in enumerate(rows):
        for j, (s, m, q) in enumerate(rows):
            if i != j and t == s and min(n - p, m - q) * 180 >= 80 * (n + m):
                can.add((t, n, p))
    assert can <= kept and len(kept) < len(set(rows))


def test_heavy_list_is_bounded_and_never_empty(spark, monkeypatch):
    """One count shared by more shingles than the list holds: a share of them is taken."""
    import numpy as np
    packed = np.stack([np.arange(1000), np.r_[np.full(10, 50), np.full(900, 7), np.full(90, 2)]]).astype(np.int64).tobytes()
    df = spark.createDataFrame([(bytearray(packed),)], "heavy binary")
    for most, least, high in ((2000, 910, 910), (310, 250, 370), (10, 10, 10), (5, 1, 9)):
        monkeypatch.setattr(ngram_join, "HEAVY", most)
        token, seen = ngram_join._heavy(df)
        assert least <= len(token) <= high and (np.diff(token) > 0).all() and seen.min() >= 3

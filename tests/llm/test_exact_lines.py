"""Exact and line dedup against plain Python."""

import hashlib
from collections import defaultdict

from clickwise.llm import exact_dedup, line_dedup
from tests.llm import odd
from tests.llm.brute import fold


def test_exact_groups(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(odd.docs(spark)).collect())
    groups = defaultdict(list)
    for d, t, *_ in odd.ROWS:
        groups[fold(t)].append(d)
    expect = []
    for d, t, *_ in odd.ROWS:
        ids = groups[fold(t)]
        keep = max((i for i in ids if i is not None), default=None)
        expect.append((d is None, d or 0, keep, len(ids), d == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    assert got == sorted(expect)


def test_recipes_tell_long_texts_apart(spark):
    far = odd.LONG[:-1] + "!"
    df = spark.createDataFrame([(1, odd.LONG), (2, far), (3, "A" + odd.LONG[1:]), (4, odd.LONG)], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df).collect()} == {1: 4, 2: 2, 3: 3, 4: 4}
    chunks = {r.doc_id: r.recipe for r in exact_dedup.recipes(df).collect()}
    same = len(set(chunks[1]) & set(chunks[2]))
    assert same > 0.9 * len(chunks[1])  # only the last chunk differs


def test_shared_identifiers_are_found(spark, monkeypatch):
    """With a hash of few bits chunks collide; texts are still told apart."""
    from pyspark.sql import functions as F
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    df = spark.createDataFrame([(i, f"text {i % 10}") for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df).collect()}
    assert got == {i: 20 + i % 10 for i in range(30)}


def test_keep_exact_keeps_one_row_of_each_text_and_all_columns(spark):
    kept = exact_dedup.keep_exact(odd.docs(spark))
    assert kept.columns == odd.docs(spark).columns
    texts = sorted(fold(r.text) for r in kept.collect())
    assert texts == sorted({fold(t) for _, t, *_ in odd.ROWS})


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(odd.empty(spark)).count() == 0
    assert exact_dedup.keep_exact(odd.empty(spark)).count() == 0
    assert line_dedup.dropped_lines(odd.empty(spark)).count() == 0


def near(a, b):
    if a == b:
        return True
    a, b = a.split(" "), b.split(" ")
    if min(len(a), len(b)) < line_dedup.NEAR_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_lines(rows):
    """{doc_id: dropped line numbers}; rows of (doc_id, text), doc_ids different."""
    lines = sorted((d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")))
    out = defaultdict(list)
    for k, (d, i, x) in enumerate(lines):
        if len(x.split(" ")) >= line_dedup.MIN_WORDS and any(near(x, y) for _, _, y in lines[:k]):
            out[d].append(i)
    return {d: out.get(d, []) for d, _ in rows}


BASE = "the quick brown fox jumps over one lazy dog today"


def test_lines_against_brute_force(spark):
    w = BASE.split(" ")
    variants = [BASE, BASE.replace("fox", "cat"), BASE.replace("fox", "cow"), " ".join(w[1:]), " ".join(w[:-1]), BASE + " again",
                "so " + BASE, " ".join(w[:4] + ["very"] + w[4:]), " ".join(reversed(w)), BASE.replace("fox", "cat").replace("dog", "pig"),
                "a b c", "a b c", "a b d", "short", "short", "", "one two three four five six seven eight", "one two three four five six seven",
                " ".join(w[1:]) + " x", "the the the the the the the the", "the the the the the the the the the"]
    import random
    rnd = random.Random(3)
    rows = [(d, "\n".join(rnd.choice(variants) for _ in range(rnd.randrange(1, 6)))) for d in range(40)] + [(90, None), (91, ""), (92, odd.LONG), (93, odd.LONG + " end")]
    got = {r.doc_id: r.dropped for r in line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert got[93] == [0]  # 60,000 words, one put in


def test_clean_texts_and_odd_rows(spark):
    out = {}
    for r in line_dedup.dedup_lines(odd.docs(spark)).collect():
        out.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.dropped))
    assert out[1] == [(None, 1, [])] and out[2] == [("", 1, [])]
    assert out[9] == [("\n".join(["a line"] * 50), 50, [])]   # two words: too short to be dropped
    assert [x[2] for x in out[5]] == [[], []] and [x[2] for x in out[11]] == [[0]]  # repeated rows are one document
    assert len(out[None]) == 2 and out[6][0][2] == []

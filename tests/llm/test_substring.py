"""Substring dedup: shared passages are caught, other text stays."""

import random
import re

import numpy as np

from clickwise.llm import substring_dedup as sub
from tests.llm import odd


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randrange(2, 10))) for _ in range(n))


def run(spark, rows, **kw):
    return {r.doc_id: r for r in sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}


def test_gear_looks_back_sixteen_bytes():
    data = np.frombuffer(prose(random.Random(1), 400).encode(), np.uint8)
    slow = [sum(int(sub.GEAR[data[i - j]]) << j for j in range(16) if i >= j) & 0xFFFF for i in range(len(data))]
    assert sub.gear(data).tolist() == slow


def test_chunks_cover_the_text_and_resist_shifts():
    rnd = random.Random(2)
    text = prose(rnd, 3000)
    cuts = []
    for t in (text, "some words put in " + text):
        data = np.frombuffer(t.encode(), np.uint8)
        start, end, digest = sub.chunks(np.array([0, len(data)]), data)
        assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all() and (end - start).max() <= sub.MAX_CHUNK + 3
        for a, b in zip(start, end):
            bytes(data[a:b]).decode()  # never inside a character
        cuts.append(set(digest.tolist()))
    assert len(cuts[0] & cuts[1]) > 0.97 * len(cuts[0])


def test_passages_are_caught_and_cut_out_once(spark):
    rnd = random.Random(3)
    passages = [prose(rnd, n) for n in (52, 60, 120, 400)]
    rows, holds = [], {}
    for d in range(120):
        if d % 3 == 0:
            k = rnd.randrange(4)
            rows.append((d, f"{prose(rnd, 30)} {passages[k]} {prose(rnd, 20)}"))
            holds.setdefault(k, []).append(d)
        else:
            rows.append((d, prose(rnd, rnd.randrange(1, 200))))
    got = run(spark, rows)
    texts = dict(rows)
    for k, ids in holds.items():
        for d in ids:
            at = texts[d].encode().index(passages[k].encode())
            spans = [(s.start, s.end) for s in got[d].repeats]
            inside = sum(min(e, at + len(passages[k].encode())) - max(s, at) for s, e in spans)
            assert inside > 0.5 * len(passages[k].encode())
            assert bool(got[d].dropped) == (d != min(ids))  # the first one stays
    clean = [d for d in texts if d % 3]
    assert all(not got[d].repeats and got[d].text == texts[d] for d in clean)


def test_cut_texts_are_the_text_without_the_spans(spark):
    rnd = random.Random(4)
    p = prose(rnd, 90)
    rows = [(d, f"{prose(rnd, 40)} {p} {prose(rnd, 10)} {p if d % 2 else ''}") for d in range(20)]
    for d, r in run(spark, rows).items():
        data = dict(rows)[d].encode()
        for s in reversed(r.dropped):
            data = data[:s.start] + data[s.end:]
        assert r.text == data.decode() and r.n_bytes == len(dict(rows)[d].encode())


def test_a_third_of_all_texts_hold_one_passage(spark):
    rnd = random.Random(6)
    p = prose(rnd, 100)
    rows = [(d, f"{prose(rnd, 20)} {p}" if d % 3 == 0 else prose(rnd, 60)) for d in range(900)]
    got = run(spark, rows)
    assert [d for d in got if got[d].dropped] != [] and {d for d in got if got[d].repeats} == set(range(0, 900, 3))
    assert {d for d in got if got[d].dropped} == set(range(3, 900, 3))


def test_odd_rows(spark):
    out = sub.substring_dedup(odd.docs(spark)).collect()
    assert len(out) == len(odd.ROWS)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[2][0].text == "" and all(r.text == "no id at all" for r in by[None])
    assert all(not r.dropped for r in by[5]) and not by[10][0].repeats
    assert sub.substring_dedup(odd.empty(spark)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = prose(random.Random(9), 200)
    out = sub.substring_dedup(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, bool(r.dropped)) for r in out) == [(1, False), (1, False), (2, True)]


def test_words_shared_with_several_texts_are_no_passage(spark):
    """Four words in random order: nearly every chunk stands elsewhere too, no 24 words in a row do."""
    rnd = random.Random(11)
    rows = [(d, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(150))) for d in range(300)]
    grams = [{tuple(w[i:i + sub.MIN_WORDS]) for i in range(len(w) - sub.MIN_WORDS + 1)} for w in (t.split() for _, t in rows)]
    assert len(set().union(*grams)) == sum(map(len, grams))
    got = run(spark, rows)
    assert all(not r.repeats and r.text == dict(rows)[d] for d, r in got.items())


def test_every_span_is_made_of_passages_of_one_other_text(spark):
    """Pieces of eight words from many texts around one passage of 60: only the passage goes."""
    rnd = random.Random(12)
    few = [prose(rnd, 1) for _ in range(6)]
    texts = [" ".join(rnd.choice(few) for _ in range(200)) for _ in range(200)]
    passage = prose(rnd, 60)
    last = " ".join(" ".join(t.split()[20:28]) for t in texts[:20]) + f" {passage} " + " ".join(" ".join(t.split()[50:58]) for t in texts[20:40])
    rows = [*enumerate(texts), (500, f"{prose(rnd, 9)} {passage}"), (501, last)]
    got = run(spark, rows)
    at, size = last.encode().index(passage.encode()), len(passage.encode())
    assert [d for d in got if got[d].dropped] == [501]
    (span,) = got[501].dropped
    assert at <= span.start and span.end <= at + size and span.end - span.start > size / 2


def plain_chunks(data):
    """Chunk ends of one text, byte by byte."""
    def inside(i):
        return i < len(data) and data[i] & 0xC0 == 0x80

    hashes, cuts = [], [0]
    for i in range(len(data)):
        hashes.append(sum(int(sub.GEAR[data[i - j]]) << j for j in range(16) if i >= j) & 0xFFFF)
    natural = [i + 1 for i, h in enumerate(hashes) if i >= 15 and h < 65536 // sub.MEAN_CHUNK and i + 1 < len(data)] + [len(data)]
    for c in natural:
        at = cuts[-1]
        while c - at > sub.MAX_CHUNK:
            at += sub.MAX_CHUNK
            cuts.append(at)
        cuts.append(c)
    moved = set()
    for c in cuts:
        while inside(c):
            c += 1
        moved.add(c)
    return sorted(moved)


def plain_passages(data, min_words):
    """(start, end) of each passage: the fewest whole chunks from a cut on that hold enough word ends."""
    cuts = plain_chunks(data)
    words = [m.end() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    for i, a in enumerate(cuts[:-1]):
        end = next((b for b in cuts[i + 1:] if sum(a < w <= b for w in words) >= min_words), None)
        if end is not None:
            yield a, end


def joined(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_spans_equal_a_plain_recomputation(spark):
    """Every span of every text against whole bytes of chunk lists, without digests."""
    rnd = random.Random(21)
    shared = [prose(rnd, n) for n in (30, 45, 55, 80, 200)]
    rows = []
    for d in range(60):
        parts = [prose(rnd, rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(shared).split(" ")
            a = rnd.randrange(0, len(p) // 3)
            parts += [" ".join(p[a:]), prose(rnd, rnd.randrange(0, 12))]
        rows.append((d, "  ".join(parts) + ("\n" if d % 2 else "")))
    rows += [(60, "x" * 700), (61, "x" * 700), (62, "a b " * 150), (63, "é" * 500 + " w" * 60), (64, ""), (65, rows[3][1])]
    where = {}
    for d, t in rows:
        data = t.encode()
        for a, b in plain_passages(data, sub.MIN_WORDS):
            cuts = [c - a for c in plain_chunks(data) if a <= c <= b]
            where.setdefault((data[a:b], tuple(cuts)), []).append((d, a, b))
    repeats, dropped = {}, {}
    for places in where.values():
        for k, (d, a, b) in enumerate(sorted(places)):
            if len(places) > 1:
                repeats.setdefault(d, []).append((a, b))
            if k:
                dropped.setdefault(d, []).append((a, b))
    got = run(spark, rows)
    assert len(dropped) > 20 and len(dropped) < len(repeats)
    for d, _ in rows:
        assert [(s.start, s.end) for s in got[d].repeats] == joined(repeats.get(d, [])), d
        assert [(s.start, s.end) for s in got[d].dropped] == joined(dropped.get(d, [])), d

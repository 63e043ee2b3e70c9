"""License scan, sharding and mixing against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

from clickwise.llm import license_scan, mixing, sharding
from tests.llm import odd
from tests.llm.brute import fold


def test_base_phrases(spark):
    texts = ["Released under the MIT License.", "gnu General-Public license; GNU GENERAL PUBLIC LICENSE", "general public license gnu", "cc  by cc by",
             "mit\nlicense apache license", "the apache x license", None, "", odd.LONG + " mit license " + odd.LONG, "mitlicense mit-license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(df).collect()}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        at = [(i, lab) for p, lab in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        expect = (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert got[d] == expect, t


def test_long_templates_survive_edits(spark):
    mit = license_scan.TEMPLATES
    name, text = next((n, t) for n, t in mit.items() if n == "mit-text") if "mit-text" in mit else next(iter(mit.items()))
    w = text.split()
    texts = [text, " ".join(w[:9] + ["now"] + w[9:]), " ".join(w[:9] + w[11:]), " ".join(w[: len(w) // 2]), " ".join(reversed(w)), "words before " + text.upper() + " and after"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [name in rows[i].labels.split(",") for i in range(6)] == [True, True, True, False, False, True]
    assert rows[0].score == 1.0 and 0.8 <= rows[1].score < 1.0 and rows[3].score == 0.0
    span = next(m for m in rows[5].matches if m.label == name)
    assert (span.first, span.last) == (2, 1 + len(w))


def test_odd_rows_and_empty_table(spark):
    out = license_scan.scan(odd.docs(spark)).collect()
    assert len(out) == len(odd.ROWS) and all(0 <= r.score <= 1 for r in out)
    assert license_scan.scan(odd.empty(spark)).count() == 0


def check_shards(rows, got, n=16):
    assert sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows) \
        == sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_of_odd_rows(spark):
    check_shards([(d, t) for d, t, *_ in odd.ROWS], sharding.shard(odd.docs(spark)).collect())
    assert sharding.shard(odd.empty(spark)).count() == 0


def test_shard_sizes_are_even_with_a_third_of_copies(spark):
    rows = [(i, "copy " * 40 if i % 3 == 0 else f"text {i} " * (i % 97)) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = check_shards(rows, got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(t) for _, t in rows)


def test_equal_texts_adjoin_and_part_only_where_a_shard_ends(spark):
    """Small groups, a group larger than a shard, one larger than a piece; shard numbers from the line of bytes."""
    rows = [(i, f"group {i % 400} " * (1 + i % 400 % 9)) for i in range(4000)] + [(10_000 + i, "of a third ") for i in range(3000)] \
        + [(20_000 + i, "larger than a piece") for i in range(60)] + [(30_000 + i, f"single {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = {r.doc_id: r for r in sharding.place(df).collect()}
    texts, places = dict(rows), defaultdict(list)
    for d, r in placed.items():
        places[texts[d]].append(r["rank"])
    assert all(max(p) - min(p) == len(p) - 1 for p in places.values())
    line, total = 0, sum(len(t) + 1 for _, t in rows)
    for n, d in enumerate(sorted(placed, key=lambda d: placed[d]["rank"])):
        assert placed[d]["rank"] == n and placed[d].shard == line * 16 // total
        line += len(texts[d]) + 1
    assert line == total


def edf(shares, cycle):
    """One cycle, slot by slot: the released block with the earliest deadline."""
    done, out = {s: 0 for s in shares}, []
    for t in range(cycle):
        jobs = [(-(-(done[s] + 1) * cycle // a), s) for s, a in sorted(shares.items()) if done[s] < a and done[s] * cycle // a <= t]
        due, s = min(jobs)
        assert due >= t + 1  # no deadline is missed
        done[s] += 1
        out.append(s)
    return out


def test_schedule_and_deviation(spark):
    shares = {"a": 50, "b": 23, "c": 13, "d": 9, "e": 4, "f": 1}
    plan = mixing.cycle_schedule(spark.createDataFrame(list(shares.items()), "source string, share long"), 100).orderBy("slot").collect()
    assert [r.source for r in plan] == edf(shares, 100)
    done = Counter()
    for t, r in enumerate(plan, 1):
        assert r.k == done[r.source]
        done[r.source] += 1
        assert all(abs(done[s] - a * t / 100) < 1 for s, a in shares.items())


def test_mix_keeps_all_rows_in_blocks(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(None, None), (5, "hot"), (7, "")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), cycle=50, block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s or "") for d, s in rows)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    n, shares, slots = Counter(s or "" for _, s in rows), {}, defaultdict(set)
    for r in got:
        shares[r.source] = r.share
        slots[r.source].add((r.block, r.slot))
    assert sum(shares.values()) == 50
    plan = edf(shares, 50)
    for s, blocks in slots.items():
        assert len(blocks) == math.ceil(n[s] / 8)
        own = [t for t, x in enumerate(plan) if x == s]
        assert all(slot == b // shares[s] * 50 + own[b % shares[s]] for b, slot in blocks)


def test_interleave_orders_whole_rows(spark):
    out = mixing.interleave(odd.docs(spark), cycle=10, block_rows=2)
    assert out.columns == odd.docs(spark).columns and out.count() == len(odd.ROWS)
    assert mixing.interleave(odd.empty(spark)).count() == 0 and mixing.mix(odd.empty(spark)).count() == 0


def test_given_weights_are_kept_after_any_prefix(spark):
    """Less than one block from the weight itself, over many cycles, while all sources have blocks."""
    for weights in ({"a": 0.9, "b": 0.1}, {"a": 0.97, "b": 0.02, "c": 0.01}, {"a": "1/3", "b": "1/7", "c": 1}, {"a": 3, "b": 2, "": 1, "gone": 0}):
        rows = [(i, s or None) for k, s in enumerate(weights) if s != "gone" for i in range(k * 10_000, k * 10_000 + 3000)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1, weights=weights).collect()
        at, left, done = {r.slot: r.source for r in got}, Counter(s or "" for _, s in rows), Counter()
        assert len(at) == len(got) == len(rows)
        whole = sum(Fraction(str(w)) for w in weights.values())
        for t in range(max(at) + 1):
            done[at[t]] += 1
            if any(done[s] == left[s] for s in left):
                break
            assert all(abs(done[s] - (t + 1) * Fraction(str(weights[s])) / whole) < 1 for s in left), (weights, t)
        assert t >= 3000


def test_weights_that_cannot_be_kept_are_refused(spark):
    import pytest
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, source string")
    for weights in ({"a": 1, "b": 1}, {"a": 1, "b": 0, None: 1}, {"a": -1, "b": 1, None: 1}, {"a": 0, "b": 0, None: 0}):
        with pytest.raises(ValueError):
            mixing.mix(docs, weights=weights)
    assert mixing.mix(docs, weights={"a": 1, "b": 0.5, None: 2}).count() == 3
    shares, cycle = mixing.given_shares({"a": 0.123456789, "b": 0.876543211, "c": 1e-9})
    assert cycle == sum(shares.values()) == mixing.MAX_CYCLE and shares["c"] == 1


def test_rows_of_one_doc_id_have_one_order(spark):
    rows = [(1, "s", f"text {i}") for i in range(40)] + [(None, "s", f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a, b = ([r.text for r in mixing.interleave(d, block_rows=4).collect()] for d in (df, df.repartition(7)))
    assert a == b


def test_more_sources_than_slots(spark):
    rows = [(i, f"s{i % 30}") for i in range(90)]
    assert mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), cycle=10, block_rows=1).count() == 90

"""The manifest against a whole tree in plain Python, and its witnesses."""

import hashlib
import zlib

import pytest

from clickwise.llm import merkle
from clickwise.llm.common import read_table
from tests.conftest import SF001
from tests.llm import odd
from tests.llm.brute import FOLD

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, lower=False):
    out = []
    for f in FIELDS:
        v = r[f]
        if f == "text" and v is not None and lower:
            v = v.translate(FOLD)
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def climb(nodes, fanout):
    """Root, and per node the runs it and its ancestors stand in: (left, right) lists."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owner = [], []
        for k in range(0, len(nodes), fanout):
            run = nodes[k:k + fanout]
            for j in range(len(run)):
                for m in owner[k + j]:
                    paths[m].append((run[:j], run[j + 1:]))
            up.append(h(*run))
            up_owner.append([m for j in range(len(run)) for m in owner[k + j]])
        nodes, owner = up, up_owner
    return nodes[0], paths


def plain_manifest(rows, fanout):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[s] = (ordered, *climb([plain_leaf(r) for r in ordered], fanout))
    root, outer = climb([trees[s][1] for s in names], fanout)
    out = []
    for s, above in zip(names, outer):
        ordered, subroot, paths = trees[s]
        for r, path in zip(ordered, paths):
            way = path + above
            crc = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
            node = plain_leaf(r, lower=crc is not None and crc % 5 == 0)
            for left, right in way:
                node = h(*left, node, *right)
            out.append((r["doc_id"], plain_leaf(r), subroot, root, h(*(x for a, b in way for x in a + b)), node, node == root))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout,levels", [(16, 3), (16, 1), (2, 2), (3, 1)])
def test_equals_a_plain_tree(spark, fanout, levels):
    """Small fan-outs make several rounds of block roots out of few rows."""
    docs = read_table(spark, SF001, "documents")
    want = plain_manifest([r.asDict() for r in docs.collect()], fanout)
    assert result(merkle.manifest(docs.repartition(5), fanout, levels)) == want
    assert 0 < sum(not w[-1] for w in want) < len(want)


def test_many_sources(spark):
    """More sources than a block holds, one of them with a third of all rows."""
    rows = [(i, f"s{i % 40}" if i % 3 else "hot", "en", i, f"Text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(merkle.manifest(docs, 3, 2)) == plain_manifest([r.asDict() for r in docs.collect()], 3)


def test_odd_rows(spark):
    docs = odd.docs(spark).withColumnsRenamed({"node": "grp", "ident": "witness"})
    assert result(merkle.manifest(docs)) == plain_manifest([r.asDict() for r in docs.collect()], 16)
    assert merkle.manifest(odd.empty(spark)).count() == 0


def test_one_document_is_the_root(spark):
    docs = spark.createDataFrame([(7, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.manifest(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:7", "-", "-", "-", "-")
    assert row.proof_sha256 == h("") and row.verified


def test_witnesses_grow_as_siblings_complete():
    app = merkle.Appender(fanout=2)
    nodes = [h(str(i)) for i in range(5)]
    sizes = []
    for n in nodes:
        app.append(n)
        sizes.append([len(w) for w in app.witness])
    assert sizes == [[0], [1, 1], [1, 1, 0], [2, 2, 2, 2], [2, 2, 2, 2, 0]]
    root = app.close(merkle.depth(5, 2))
    assert root == climb(nodes, 2)[0]
    assert all(merkle.fold(n, w) == root for n, w in zip(nodes, app.witness))

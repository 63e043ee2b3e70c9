"""BPE against the tokenizer's own library, and an exact round trip."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
import tiktoken
from pyspark.sql import functions as F

from clickwise.llm import bpe
from clickwise.llm.common import read_table
from clickwise.llm.queries import vocabulary
from tests.conftest import SF001
from tests.llm import odd

PATH, PATTERN = vocabulary()


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def strange_texts():
    rnd = random.Random(1)
    alphabet = "abAB  \n\t\r'sédñ的中国🙂\x1c\x85\xa0\u2003\u200b0123½²_=-!?*\u0301aaaaa"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(600)]
    return texts + ["a" * 3000, "=" * 2000 + " " * 1500, "ab" * 700, " ", "\n\n\n", "<|endoftext|>", "".join(rnd.choice("abcdefghij") for _ in range(900))]


def test_encode_and_decode_equal_the_library(spark):
    texts = strange_texts() + [r.text for r in read_table(spark, SF001, "documents", "text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).collect()
    enc = library()
    assert len(out) == len(texts)
    for r in out:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]


def test_replay_pieces_by_themselves():
    merges = bpe._merges(PATH)
    enc = library()
    pieces = [p.encode() for p in ("aaaa", "aaaaa", "ababab", "the", " the", "zzzzzzzzzz", "Straße", "x", "internationalisation")] + [b""]
    for piece, ids in zip(pieces, bpe.replay(pieces, merges)):
        assert ids.tolist() == (enc.encode_ordinary(piece.decode()) if piece else [])


def test_blocks_of_one_document_give_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1)
    texts = [t for t in strange_texts()[:120] if t]
    enc, run = library(), bpe._blocks(PATTERN, 7)
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in enumerate(texts)])]
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 3)))
    rows = [r for b in run(iter(batches)) for r in b.to_pylist()]
    assert len({r["block"] for r in rows}) == len(texts) and {r["block"] >> 32 for r in rows} == {3}
    codes = [r for b in bpe._codes(PATH)(iter([bpe._rows([tuple(r.values()) for r in rows if r["bucket"] >= 0])])) for r in b.to_pylist()]
    got = {}
    for block in {r["block"] for r in rows}:
        table = pa.Table.from_pylist([r for r in rows if r["block"] == block], schema=bpe.ARROW)
        own = pa.Table.from_pylist([r for r in codes if r["block"] == block], schema=bpe.ARROW)
        got |= {r["doc_id"]: r["ids"] for r in bpe._assemble(None)(table, own).to_pylist()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_packed_documents_unpack():
    raw, data = bpe._pack_docs([1, None], [2, 1], np.array([2, 0, 1]), np.array([0, 1, 2]))
    ids, counts, places = bpe._unpack_docs(pa.decompress(data, raw, "zstd", asbytes=True), 2)
    assert (ids, counts, places.tolist()) == ([1, None], [2, 1], [2, 0, 1])


def test_odd_rows(spark):
    out = bpe.encode(odd.docs(spark), PATH, PATTERN, decoded=True).collect()
    enc = library()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == sorted((d is None, d or 0, t or "") for d, t, *_ in odd.ROWS)
    assert all(list(r.ids) == enc.encode_ordinary(bytes(r.decoded).decode()) for r in out)
    assert bpe.encode(odd.empty(spark), PATH, PATTERN).count() == 0
    none = bpe.digests(odd.docs(spark).filter("doc_id = 1"), PATH, PATTERN).first()
    assert none.n_tokens == 0 and none.ids_sha256 == none.decoded_sha256 == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]

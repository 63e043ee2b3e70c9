"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. Each partition cuts its texts into pieces (the tokenizer's pattern) and
   packs blocks of whole documents: a document becomes a list of numbers into
   its block's dictionary of distinct pieces.
2. The dictionaries are shuffled by buckets of their pieces' content, packed, so
   all blocks' copies of a piece meet in one task.  There the merges are replayed over the distinct
   pieces together: an inverted index from token pair to positions applies each
   merge in rank order and then touches only the merged positions' neighbours.
3. The pieces' token ids go back to their blocks, where the documents' lists
   are turned into ids.  Texts themselves are never shuffled.

A block is bounded by BLOCK_CHARS (or is one longer document), so is every
group; a piece occurs once per block at most, so no bucket is hot.

Defined results: a null text is the empty text (no ids); null doc_ids and
repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clickwise.llm.common import frugal

BLOCK_CHARS = 12 << 20
# Distinct pieces that one replay holds in memory.
REPLAY_PIECES = 150_000
# Pair ranks remembered by a worker.
KNOWN_PAIRS = 300_000
BUCKETS_PER_PARTITION = 4


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file's tokens and ranks (a fixed file, some 50,000 lines)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """Rank lookups of one vocabulary: of token pairs, and which merged tokens
    can be part of an earlier-ranked token (those are merged one per piece at a
    time, because an earlier merge may come up in between)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}
        self.early = set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                for part in (token[:cut], token[cut:]):
                    if ranks.get(part, -1) > rank:
                        self.early.add(ranks[part])

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key (left * size + right); ``size`` where there is none."""
        unique, back = np.unique(keys, return_inverse=True)
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        known, tokens, ranks, size = self.pairs, self.tokens, self.ranks, self.size
        out = np.empty(len(unique), np.int64)
        for i, k in enumerate(unique.tolist()):
            r = known.get(k)
            if r is None:
                r = known[k] = ranks.get(tokens[k // size] + tokens[k % size], size)
            out[i] = r
        return out[back]


def replay(pieces: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Token ids of every piece, all merges replayed over all pieces at once."""
    whole = [merges.ranks.get(p) for p in pieces]
    open_ = [i for i, (p, w) in enumerate(zip(pieces, whole)) if w is None and p]
    out: list = [np.array([w], np.int32) if w is not None else np.empty(0, np.int32) for w in whole]
    if not open_:
        return out
    lengths = np.array([len(pieces[i]) for i in open_])
    tok = merges.byte[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)]
    n = len(tok)
    piece_of = np.repeat(np.arange(len(open_), dtype=np.int32), lengths)
    ends = np.cumsum(lengths)
    nxt, prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[ends - 1] = n
    prev[ends - lengths] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(left: np.ndarray) -> None:
        """Enter the pairs that start at these positions into the index."""
        rank = merges.rank_of(tok[left] * merges.size + tok[nxt[left]])
        order = np.argsort(rank, kind="stable")
        rank, left = rank[order], left[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rank)]):
            r = int(rank[a]) if a < len(rank) else merges.size
            if r == merges.size:
                break
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(left[a:b])

    add(np.flatnonzero(nxt < n))
    while heap:
        rank = heapq.heappop(heap)
        at = np.unique(np.concatenate(index.pop(rank)))
        at = at[(tok[at] >= 0) & (nxt[at] < n)]
        # Only positions that still hold a pair of this rank.
        at = at[merges.rank_of(tok[at] * merges.size + tok[nxt[at]]) == rank] if len(at) else at
        if not len(at):
            continue
        if rank in merges.early:  # the first one of each piece now, the rest again later
            first = np.r_[True, piece_of[at[1:]] != piece_of[at[:-1]]]
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(heap, rank)
            at = at[first]
        else:  # of overlapping pairs every other one, from the left
            fresh = np.r_[True, nxt[at[:-1]] != at[1:]]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = nxt[at]
        tok[at], tok[gone] = rank, -1
        after = nxt[gone]
        nxt[at] = after
        inner = after < n
        prev[after[inner]] = at[inner]
        before = prev[at]
        add(np.unique(np.concatenate([at[inner], before[before >= 0]])))
    live = tok >= 0
    counts = np.bincount(piece_of[live], minlength=len(open_))
    for i, ids in zip(open_, np.split(tok[live].astype(np.int32), np.cumsum(counts)[:-1])):
        out[i] = ids
    return out


@lru_cache(maxsize=4)
def _merges(path: str) -> Merges:
    return Merges(load_ranks(path))


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _pack(parts: list[bytes]) -> tuple[int, bytes]:
    """Raw size and compressed bytes: the parts' lengths, then the parts."""
    raw = np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)
    return len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, count: int, raw: int) -> list[bytes]:
    data = pa.decompress(packed, raw, "zstd", asbytes=True)
    ends = (np.cumsum(np.frombuffer(data, "<u4", count)) + 4 * count).tolist()
    return [data[a:b] for a, b in zip([4 * count, *ends], ends)]


# One kind of row all the way.  bucket -1: a block's documents (count of them).
# Others: the pieces of one block and bucket, numbered base .. base + count - 1;
# data are the pieces, later their ids.
SCHEMA = "block long, bucket int, base long, count long, raw long, data binary"
ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("base", pa.int64()),
                   ("count", pa.int64()), ("raw", pa.int64()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def _planes(numbers: np.ndarray) -> bytes:
    """Little numbers byte plane by byte plane, which compresses to their entropy."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _pack_docs(ids: list, counts: list[int], place: np.ndarray, numbers: np.ndarray) -> tuple[int, bytes]:
    """Documents' ids, numbers of pieces, and pieces: as ranks by frequency in the
    block, with each rank's place in the dictionary."""
    order = np.argsort(-np.bincount(numbers, minlength=len(place)), kind="stable")
    rank = np.empty(len(place), np.int64)
    rank[order] = np.arange(len(place))
    raw = (np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
           + np.array([len(place)], "<u4").tobytes() + np.array(counts, "<u4").tobytes() + _planes(place[order]) + _planes(rank[numbers]))
    return len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpack_docs(data: bytes, n: int) -> tuple[list, list[int], np.ndarray]:
    ids, none = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n)
    size = int(np.frombuffer(data, "<u4", 1, 9 * n)[0])
    counts = np.frombuffer(data, "<u4", n, 9 * n + 4)
    place = _from_planes(data, 13 * n + 4, size)
    numbers = _from_planes(data, 13 * n + 4 + 4 * size, int(counts.sum()))
    return [None if x else i for i, x in zip(ids.tolist(), none)], counts.tolist(), place[numbers]


def _blocks(pattern: str, buckets: int, block_chars: int | None = None):
    """Texts -> blocks: their documents and their dictionaries by bucket."""
    block_chars = block_chars or BLOCK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        cut = regex.compile(pattern).findall
        block, pieces, size, ids, found = TaskContext.get().partitionId() << 32, _Numbers(), 0, [], []

        def flush():
            known = [p.encode("utf-8") for p in pieces]
            bucket = np.array([crc32(p) % buckets for p in known], np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            out = [(block, -1, 0, len(ids), *_pack_docs(ids, [len(f) for f in found], place, np.concatenate(found).astype(np.int64)))]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    out.append((block, b, lo, hi - lo, *_pack([known[i] for i in order[lo:hi].tolist()])))
            return _rows(out)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc)
                found.append(np.array([pieces[p] for p in cut(text)], np.uint32))
                size += len(text)
                if size >= block_chars:
                    yield flush()
                    block, pieces, size, ids, found = block + 1, _Numbers(), 0, [], []
                    pa.default_memory_pool().release_unused()
        if ids:
            yield flush()
    return run


def _codes(path: str, replay_pieces: int | None = None):
    """Dictionary rows of some buckets -> the same rows with ids for pieces; every
    distinct piece is replayed once per ``replay_pieces``."""
    replay_pieces = replay_pieces or REPLAY_PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path)
        held, numbers = [], _Numbers()

        def flush():
            code = [ids.astype("<i4").tobytes() for ids in replay(list(numbers), merges)]
            for at in range(0, len(held), 1000):
                yield _rows([(r["block"], r["bucket"], r["base"], r["count"], *_pack([code[i] for i in which]))
                             for r, which in held[at:at + 1000]])

        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append((r, [numbers[p] for p in _unpack(r.pop("data"), r["count"], r["raw"])]))
                size += r["count"]
                if len(numbers) >= replay_pieces or size >= 10 * replay_pieces:
                    yield from flush()
                    held, numbers, size = [], _Numbers(), 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from flush()
    return run


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("bucket"), 0))


def _objects(parts: list[bytes]) -> np.ndarray:
    out = np.empty(len(parts), object)
    out[:] = parts
    return out


def _longs(parts: list[bytes]) -> pa.Array:
    """Ids of all documents, without a copy of the joined bytes."""
    data = b"".join(parts)
    return pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])


def _assemble(decode_path: str | None):
    """One block: its documents' pieces and its dictionary's ids -> the documents'
    ids, and with ``decode_path`` the bytes decoded from them."""
    def run(block: pa.Table, codes: pa.Table) -> pa.Table:
        rows = codes.sort_by("base").select(["count", "raw", "data"]).to_pylist()
        code = _objects([c for r in rows for c in _unpack(r["data"], r["count"], r["raw"])])
        del rows
        docs = block.filter(pc.less(block.column("bucket"), 0)).to_pylist()[0]
        ids, counts, places = _unpack_docs(pa.decompress(docs["data"], docs["raw"], "zstd", asbytes=True), docs["count"])
        flat, at = [], 0
        for n in counts:
            flat.append(b"".join(code[places[at:at + n]].tolist()))
            at += n
        out = {"doc_id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *(len(f) // 4 for f in flat)]), pa.int32()), _longs(flat))}
        if decode_path:
            tokens = _tokens(decode_path)
            out["decoded"] = pa.array([decode_ids(np.frombuffer(f, "<i4"), tokens) for f in flat], pa.binary())
        return pa.table(out)
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False, block_chars: int | None = None, replay_pieces: int | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every row, as the tokenizer without special tokens
    gives them; with ``decoded`` also the bytes decoded from the ids.  Smaller blocks and
    replays hold less in a task and move more: a piece once per block and replay (default: BLOCK_CHARS and
    REPLAY_PIECES)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # One exchange by block serves both the dictionaries and the assembly.
    blocks = texts.mapInArrow(frugal(_blocks(pattern, BUCKETS_PER_PARTITION * partitions, block_chars)), SCHEMA).repartition(partitions, "block")
    codes = blocks.mapInArrow(frugal(_dictionaries), SCHEMA).repartition(partitions, "bucket").mapInArrow(frugal(_codes(ranks_path, replay_pieces)), SCHEMA)
    return (blocks.groupBy("block").cogroup(codes.groupBy("block"))
                  .applyInArrow(_assemble(ranks_path if decoded else None), "doc_id long, ids array<int>" + ", decoded binary" * decoded))


@lru_cache(maxsize=4)
def _tokens(path: str) -> np.ndarray:
    """Bytes of each token id."""
    known = {r: t for t, r in load_ranks(path).items()}
    return _objects([known.get(i, b"") for i in range(max(known) + 1)])


def decode_ids(ids: np.ndarray, tokens: np.ndarray) -> bytes:
    return b"".join(tokens[ids].tolist())


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with ``ids``) plus ``decoded``, the ids' bytes; null ids decode to none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_path)
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
            out = [decode_ids(flat[a:b], tokens) for a, b in zip([0, *ends], ends)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema + ", decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, block_chars: int | None = None, replay_pieces: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    out = encode(docs, ranks_path, pattern, decoded=True, block_chars=block_chars, replay_pieces=replay_pieces)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))

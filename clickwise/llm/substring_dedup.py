"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash of the last 16 bytes runs over each text; a chunk ends where it falls
below a bound (every MEAN_CHUNK bytes on average, MAX_CHUNK at most, never inside
a character).  Cuts depend on the bytes around them alone, so a passage gets the
same chunks wherever it stands and whatever is put in before it.  Every chunk has
a digest of its bytes.  A chunk of some 3 words recurs by chance, so what is looked
for is a run of chunks: at every chunk begins a passage, as few whole chunks as hold
MIN_WORDS words, named by the list of their digests.  Two passages meet where all
their chunks are equal and in the same order, so what is shared stands in one piece
in the other text too; the first one in (doc_id, place) order is the original,
others repeat it.

Passages that meet another are joined where they overlap or touch and reported
(``repeats``), those that are not originals are cut out of the text (``dropped``).
A shared stretch loses less than a chunk at either end, so MIN_WORDS is about half
of the 50 words that must be caught.

A window of texts sends each digest once, however often it holds it, so a passage
of a third of all texts is spread over the tasks before anything is shuffled.

Defined results: a null text stays null and has no spans; a row without doc_id
takes no part and stays as it is; rows that repeat doc_id and text are one
document (they are no repeats of each other); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickwise.llm.shingles import BYTE_VALUE, IS_BLANK, U, mix, powers, slices

MEAN_CHUNK, MAX_CHUNK, MIN_WORDS = 20, 120, 24
WINDOW_PASSAGES = 1_000_000
# A place is one long: 24 bits of the text's hash, 32 of the start.
START_BITS = 32
GEAR = mix(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint16)

Batches = Iterator[pa.RecordBatch]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[b] << age over 16 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += older
    return h


def _cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where chunks begin and end; texts begin at ``offsets``."""
    cut = np.flatnonzero(gear(data) < np.uint16(65536 // MEAN_CHUNK)) + 1
    own = cut - offsets[np.searchsorted(offsets, cut - 1, "right") - 1] >= 16  # all bytes that were hashed are the text's
    cut = np.unique(np.concatenate([offsets, cut[own]]))
    gap = np.diff(cut)
    more = (gap - 1) // MAX_CHUNK
    forced = np.repeat(cut[:-1], more) + MAX_CHUNK * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    cut = np.concatenate([cut, forced])
    padded = np.r_[data, np.zeros(4, np.uint8)]
    for _ in range(3):  # on to the next character
        cut = cut + ((padded[cut] & 0xC0) == 0x80)
    return np.unique(cut)


def _digests(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digest of each stretch ``values[start:end]``, by prefix sums."""
    n = len(values)
    up, down = powers(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)).view(np.int64)


def chunks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and digest of every chunk; texts begin at ``offsets``."""
    cut = _cuts(offsets, data)
    return cut[:-1], cut[1:], _digests(BYTE_VALUE[data], cut[:-1], cut[1:])


def _word_ends(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where words end; a text's end ends its last one."""
    edge = np.r_[IS_BLANK[data[1:]], True]
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    return np.flatnonzero(~IS_BLANK[data] & edge) + 1


def _last_chunks(start: np.ndarray, end: np.ndarray, word_ends: np.ndarray, min_words: int) -> np.ndarray:
    """The chunk with which ``min_words`` word ends lie in the run from each chunk on; the number of chunks if there are fewer."""
    far = np.iinfo(np.int64).max
    at = np.searchsorted(word_ends, start, "right") + min_words - 1
    return np.searchsorted(end, np.r_[word_ends, far][np.minimum(at, len(word_ends))])


def passages(offsets: np.ndarray, data: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text number and digest of the passage at each chunk whose text has as many words from there on."""
    start, end, digest = chunks(offsets, data)
    last = _last_chunks(start, end, _word_ends(offsets, data), min_words)
    row = np.searchsorted(offsets, start, "right") - 1
    fits = np.flatnonzero(np.r_[end, np.iinfo(np.int64).max][last] <= offsets[row + 1])
    return start[fits], row[fits], _digests(digest.view(np.uint64), fits, last[fits] + 1)


PASSAGE_SCHEMA = "key long, doc_id long, place long, state int"
ONCE, MANY, AGAIN = 0, 1, 2


def _passage_rows(batches: Batches, min_words: int) -> Batches:
    """Per window of texts each digest's first passage (state ONCE, or MANY if the
    window repeats it) and the further ones (AGAIN, under a key of their own)."""
    held, size = [], 0

    def window():
        digest, doc, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, digest))
        digest, doc, place = digest[order], doc[order], place[order]
        new = np.r_[True, (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]
        digest, doc, place = digest[new], doc[new], place[new]
        first = np.r_[True, digest[1:] != digest[:-1]]
        many = np.r_[~first[1:], False]
        state = np.where(first, np.where(many, MANY, ONCE), AGAIN).astype(np.int32)
        key = np.where(first, digest, mix((doc ^ (place << 20)).view(np.uint64)).view(np.int64))
        return pa.record_batch([pa.array(c) for c in (key, doc, place, state)], names=["key", "doc_id", "place", "state"])

    for batch in batches:
        ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for first, offsets, data in slices(batch.column(1), fold=False):
            if not len(data):
                continue
            start, row, digest = passages(offsets, data, min_words)
            if not len(start):
                continue
            place = (marks[first + row] << START_BITS) | (start - offsets[row])
            held.append((digest, ids[first + row], place))
            size += len(start)
            if size >= WINDOW_PASSAGES:
                yield window()
                held, size = [], 0
    if held:
        yield window()


def _repeats(batches: Batches) -> Batches:
    """Sorted by key, doc_id, place -> the passages whose digest stands elsewhere too, with
    whether they repeat an earlier one.  Holds one batch and the first row of a key."""
    carry, told = np.empty((4, 0), np.int64), False
    for batch in batches:
        x = np.concatenate([carry, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
        again = x[3] == AGAIN
        keep = np.r_[True, again[1:] | (x[:3, 1:] != x[:3, :-1]).any(axis=0)]
        x, again = x[:, keep], again[keep]
        start = np.r_[True, (x[0, 1:] != x[0, :-1]) | again[1:] | again[:-1]]
        lead = np.maximum.accumulate(np.where(start, np.arange(x.shape[1]), 0))
        size = np.bincount(lead, minlength=x.shape[1])[lead]
        is_lead = lead == np.arange(x.shape[1])
        out = again | (size > 1) | (x[3] == MANY)
        later = again | ~is_lead
        if told:
            out[0] = False
        yield pa.record_batch([pa.array(x[1][out]), pa.array(x[2][out]), pa.array(later[out])], names=["doc_id", "place", "later"])
        at = lead[-1]
        told = bool(out[at]) or (told and at == 0)
        carry = x[:, [at]]


def _runs(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Passages, sorted by start, joined where they overlap or touch."""
    if not len(start):
        return []
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[new], reach[np.r_[new[1:], True]])]


SPANS = "array<struct<start:long,end:long>>"
RESULT = f"doc_id long, n_bytes long, repeats {SPANS}, dropped {SPANS}, text string"


def _cut_out(min_words: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for doc, text, places, later in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode("utf-8")
                repeats, dropped = [], []
                if places:
                    place, late = np.array(places, np.int64), np.array(later, bool)
                    hit = place & ((1 << START_BITS) - 1)
                    offsets, raw = np.array([0, len(data)]), np.frombuffer(data, np.uint8)
                    cut = _cuts(offsets, raw)
                    last = _last_chunks(hit, cut[1:], _word_ends(offsets, raw), min_words)
                    end = cut[last + 1]
                    repeats = _runs(hit, end)
                    dropped = _runs(hit[late], end[late])
                if dropped:
                    edges = [0, *(x for d in dropped for x in (d["start"], d["end"])), len(data)]
                    text = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8")
                rows.append((doc, len(data), repeats, dropped, text))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, span, pa.string()))],
                                  names=["doc_id", "n_bytes", "repeats", "dropped", "text"])
    return run


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, repeats and dropped (byte spans of the text), text (without the dropped spans) per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.shiftrightunsigned(F.xxhash64(text_col), 40).alias("mark"))
    found = (rows.filter("doc_id IS NOT NULL").mapInArrow(partial(_passage_rows, min_words=min_words), PASSAGE_SCHEMA)
                 .repartition("key").sortWithinPartitions("key", "doc_id", "place", F.desc("state"))
                 .mapInArrow(_repeats, "doc_id long, place long, later boolean"))
    per_doc = (found.groupBy("doc_id", F.shiftrightunsigned("place", START_BITS).alias("mark"))
                    .agg(F.array_sort(F.collect_list(F.struct("place", "later"))).alias("hits"))
                    .select("doc_id", "mark", F.col("hits.place").alias("places"), F.col("hits.later").alias("later")))
    return (rows.join(per_doc, ["doc_id", "mark"], "left").select("doc_id", "text", "places", "later")
                .mapInArrow(_cut_out(min_words), RESULT))

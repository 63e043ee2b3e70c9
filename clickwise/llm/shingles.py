"""Word-shingle hashes of text columns, vectorised over Arrow buffers.

Words are runs of bytes outside ASCII white space, A-Z folded.  A shingle is the
64-bit hash of n consecutive words; a text with fewer words has one shingle, the
whole sequence.  Everything works on byte arrays, a few MB of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
# One odd factor per word of a shingle.
PLACE = mix(np.arange(300, 364, dtype=np.uint64)) | U(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n, np.uint64)
    up, down = one * U(BASE), one * U(BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 19, 1 << (n - 1).bit_length()))


def slices(texts: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets of the rows, bytes, folded if asked) for SLICE_BYTES of text at
    a time; a longer text is a slice of its own.  Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[row]:offsets[end]]
        yield row, offsets[row:end + 1] - offsets[row], FOLD[part] if fold else part
        row = end


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it stands in."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = ~IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle, sorted by row and hash."""
    word, row = words(offsets, data)
    if not len(word):
        return row, word
    count = np.bincount(row, minlength=len(offsets) - 1)
    m = len(word) - n + 1
    parts, rows = [], []
    if m > 0:
        full = row[:m] == row[n - 1:]
        parts.append(sum((word[k:m + k] * PLACE[k] for k in range(n)), U(0))[full])
        rows.append(row[:m][full])
    first = np.cumsum(count) - count
    for few in range(1, n):
        at = first[count == few]
        parts.append(sum((word[at + k] * PLACE[k] for k in range(few)), PLACE[-few]) + np.zeros(len(at), np.uint64))
        rows.append(np.flatnonzero(count == few))
    token, row = mix(np.concatenate(parts)), np.concatenate(rows)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (row[1:] != row[:-1])]
    return row[keep], token[keep]


def set_names(row: np.ndarray, token: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of tokens and a 128-bit name of the set (two longs)."""
    count = np.bincount(row, minlength=n_rows)
    some = np.flatnonzero(count)
    a, b = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    if len(some):
        begin = (np.cumsum(count) - count)[some]
        a[some] = np.add.reduceat(mix(token ^ U(0x1234567)), begin)
        b[some] = np.add.reduceat(mix(token + U(0x7654321)), begin)
    return count, a.view(np.int64), b.view(np.int64)

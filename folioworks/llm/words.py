"""Words, shingles and lines of whole texts as numpy arrays, for use in Arrow tasks.

Every function takes a batch's text column (nulls count as empty) and works on
its UTF-8 bytes.  Rows are handled in groups of ``GROUP_BYTES``; a longer text
is a group of its own, so a task's memory follows its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 2_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word where white space alone separates words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of a word made of letters and digits; every byte above ASCII counts.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x41:0x5B] = True
ALPHANUMERIC[0x80:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_keys = np.zeros(0, dtype=np.uint64)


def position_keys(n: int) -> np.ndarray:
    """Odd multipliers for the first ``n`` positions of a word."""
    global _keys
    if len(_keys) < n:
        count = np.arange(1, max(n, 256) + 1, dtype=np.uint64)
        _keys = mixed(count * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _keys


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (first, end) with their bytes and offsets, about ``limit`` bytes each."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` bytes; a row's end ends a run."""
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    kept = data[inside].astype(np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(begin, lengths)
    kept += np.uint64(1)
    kept *= position_keys(int(lengths.max()))[place]
    return mixed(np.add.reduceat(kept, begin))


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word (A-Z lowered), and n + 1 word offsets of the rows."""
    lowered = LOWER[data]
    inside = letters[lowered]
    starts, ends = spans(lowered, offsets, inside)
    return span_hashes(lowered, inside, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def word_hash(word: str) -> int:
    """The hash that :func:`words` gives this one word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(span_hashes(LOWER[data], np.ones(len(data), bool), np.array([0]), np.array([len(data)]))[0])


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and the rows' offsets.

    A row with fewer words than ``width`` has its whole sequence as one shingle;
    a row without words has none.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    rows = np.repeat(np.arange(len(counts)), made)
    begin = np.cumsum(made) - made
    place = np.repeat(offsets[:-1], made) + np.arange(len(rows)) - np.repeat(begin, made)
    size = np.minimum(counts, width)[rows]
    keys = position_keys(width)
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        there = size > k
        out[there] += hashes[place[there] + k] * keys[k]
    out = mixed(out)
    order = np.lexsort((out, rows))
    out = out[order]
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[fresh], np.searchsorted(rows[fresh], np.arange(len(counts) + 1))


def reduced(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduceat`` over row ranges in which empty rows give ``empty``."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.full((len(offsets) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[full], axis=0)
    return out

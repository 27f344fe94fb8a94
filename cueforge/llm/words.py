"""Words of many texts at once, as numpy arrays over Arrow buffers.

Everything here works on one slice of a record batch: its texts lie one after another in a single
byte array, and words are (start, end) offsets into that array with the row each belongs to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
#: Bytes of text handled together; keeps the temporary arrays small whatever the batch size.
SLICE_BYTES = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower case.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batches, column="text", limit=SLICE_BYTES):
    """Row slices of record batches with at most `limit` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        row = 0
        while row < n:
            base = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def text_bytes(column, lower=False):
    """(bytes, offsets) of a string column; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def find_words(data, offsets, separators=WHITE):
    """(starts, ends, first): byte offsets of the words, and for each row its first word's index, with the total last."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separators[data]
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[: len(data) - 1] if len(data) else opens[1:]
    rows = offsets[:-1][(offsets[:-1] < offsets[1:])]
    opens[rows] = inside[rows]
    starts = np.flatnonzero(opens)
    closes = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[last] = inside[last]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _odd_powers(n, base):
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD1342543DE82EF95)
_STEP_INVERSE = U64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_tables: dict = {}


def _powers(kind, base, n):
    if kind not in _tables or len(_tables[kind]) < n:
        _tables[kind] = _odd_powers(max(n, 1 << 20), base)
    return _tables[kind][:n]


def mix(x):
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_table(seed):
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_BYTES = {seed: _byte_table(seed) for seed in (1, 2)}


def hash_words(data, starts, ends, seed=1):
    """A 64-bit hash of each word, the same in whatever text and batch the word stands."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[seed][data] * _powers("base", _BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers("inverse", _INVERSE, len(data))[starts] + (ends - starts).astype(U64))


def hash_windows(words, width):
    """A 64-bit hash of every run of `width` words, by the index of its first word."""
    if len(words) < width:
        return np.zeros(0, U64)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * _powers("step", _STEP, len(words)), out=total[1:])
    n = len(words) - width + 1
    return mix((total[width:] - total[:n]) * _powers("step_inverse", _STEP_INVERSE, n) + U64(width))


def rows_of(first):
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(starts, lengths):
    """Indices of the concatenated ranges [start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def marked(at, n):
    """Which of n places are in `at`."""
    out = np.zeros(n, bool)
    out[at] = True
    return out


def most_seen(seen, most):
    """Which places were seen twice or more; of more than `most` of them those seen most often."""
    keep = seen > 1
    if np.count_nonzero(keep) > most:
        keep = marked(np.argsort(-seen, kind="stable")[:most], len(seen))
    return keep

"""Texts of Arrow batches as one array of bytes: no Python object a text, no copy of what isn't looked at.

``parts`` cuts a batch into runs of whole rows of about ``size`` bytes, so that working arrays stay in a core's cache and memory
is bounded by the largest text, whatever a batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_LONG = 256
_kept = False


def keep_memory() -> None:
    """Have the allocator keep what arrays free instead of handing it back: a worker would touch fresh pages for every array."""
    global _kept
    if not _kept:
        _kept = True
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 96 << 20)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):
            pass


def solid(data: np.ndarray) -> np.ndarray:
    """Which bytes are of words; words are parted by space and U+0009 to U+000D."""
    return (data != 0x20) & ((data - np.uint8(0x09)) > 4)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return data | (((data - np.uint8(0x41)) < 26).view(np.uint8) << 5)


def whole(text: str = "text") -> Column:
    """The text column with null as empty, as strings; Arrow carries them as UTF-8."""
    return F.coalesce(F.col(text), F.lit("")).alias(text)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column without nulls as its bytes and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def parts(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows: a slice of the batch, the bytes of its texts one after the other, and n + 1 offsets into these."""
    keep_memory()
    for b in batches:
        data, at = buffer_of(b.column(b.schema.names.index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield b.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def edges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``inside`` start and end; no run crosses from one text to the next."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.empty(n + 1, bool)
    turn[0], turn[n] = inside[0], inside[n - 1]
    np.not_equal(inside[1:], inside[:-1], out=turn[1:n])
    both = np.flatnonzero(turn)
    cut = at[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[inside[cut] & inside[cut - 1]]
    if len(cut):  # a run ends and another starts where texts meet
        both = np.insert(both, np.repeat(np.searchsorted(both, cut), 2), np.repeat(cut, 2))
    return both[::2].copy(), both[1::2].copy()


def n_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words each text has."""
    if not len(data):
        return np.zeros(len(at) - 1, np.int64)
    first = solid(data)
    between = ~first
    starts = at[:-1][np.diff(at) > 0]
    own = first[starts].copy()
    first[1:] &= between[:-1]
    first[starts] = own
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=sums[1:])
    return np.diff(sums[at])


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, little end first; zeros follow the data. The view is not aligned."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range. Lanes are independent."""
    step = _STEP[lane]
    view = loads(data) if view is None else view
    n = end - begin
    h = mix((view[begin] & _MASK[np.minimum(n, 8)]) * step + n.astype(np.uint64))
    more = np.flatnonzero(n > 8)
    k = 8
    while len(more) and k < _LONG:
        h[more] = mix(h[more] * step + (view[begin[more] + k] & _MASK[np.minimum(n[more] - k, 8)]))
        k += 8
        more = more[n[more] > k]
    for i in more.tolist():  # ranges beyond _LONG bytes, one by one
        b, e = int(begin[i]) + _LONG, int(end[i])
        h[i] = _long(data[b:e], h[i], lane)
    return h


def _long(data: np.ndarray, seed: np.uint64, lane: int) -> np.uint64:
    """Folds a long range: words of 8 bytes weighted by mixed places, summed."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    x = padded.view("<u8")
    place = mix(np.arange(1, len(x) + 1, dtype=np.uint64) * _STEP[1 - lane])
    total = np.array([np.add.reduce(mix(x ^ place))], np.uint64) + np.uint64(len(data))
    return mix(total + np.array([seed], np.uint64) * _STEP[lane])[0]

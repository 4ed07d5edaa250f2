"""Word shingles of many texts at once: hashes of runs of words, with A-Z lower-cased."""

from __future__ import annotations

import numpy as np

from tessera.llm import texts as T

_STEP = np.uint64(0x9FB21C651E98DF25)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and n + 1 offsets into them."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return of(*joined(texts), size)


def of(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes sorted within each text, and where each text's begin (one more entry at the end).

    A text of fewer than ``size`` words has one shingle, its whole sequence; a text without words has none.
    """
    data = T.lower(data)
    begin, end = T.edges(T.solid(data), at)
    h = T.hashes(data, begin, end)
    word = np.searchsorted(begin, at)
    first, count = word[:-1], np.diff(word)
    ext = np.concatenate([h, np.zeros(size, np.uint64)])
    g = np.zeros(len(h), np.uint64)
    for j in range(size):
        g *= _STEP
        g += ext[j : j + len(h)]
    ok = np.ones(len(h), bool)
    for j in range(1, size):  # a text's last words start no shingle
        last = word[1:] - j
        ok[last[last >= first]] = False
    short = np.flatnonzero((count > 0) & (count < size))
    whole = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = count[short] > j
        whole[has] = whole[has] * _STEP + h[first[short][has] + j]
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    place = np.concatenate([[0], np.cumsum(n)])
    value = np.empty(place[-1], np.uint64)
    long = np.ones(place[-1], bool)
    long[place[:-1][short]] = False
    value[long] = T.mix(g[ok])
    value[place[:-1][short]] = T.mix(whole + count[short].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    for k in np.flatnonzero(n > 1).tolist():
        value[place[k] : place[k + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[place[:-1][n > 0]] = True
    return value[new], np.concatenate([[0], np.cumsum(new)])[place]

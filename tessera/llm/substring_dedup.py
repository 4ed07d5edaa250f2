"""Substring dedup by level-wise doubling over word windows.

A text that equals an earlier one loses all its words, if it has a window, and takes no further part: the earlier one holds all its windows. Among the others, level 1 finds which windows of ``base`` words occur more than once in the corpus. A window of twice the length is a candidate
only if both its halves did; each level asks only about its candidates, until windows of ``window`` words are decided or no
candidate survives. The last level compares two independent 64-bit hashes of each window and asks which windows start earlier; the levels before it only filter: they
send 32 bits a distinct window within its bucket (a false hit there costs a candidate, never a result).

A block notes which words start its candidates, so a later round hashes the words of those windows alone. Rows and memory: see blocks.py; a window that
very many documents hold is sent once a block.

Defined results: a null or empty text has no words; a text of fewer than ``window`` words stays whole (windows never
cross rows); a text of any length is one block at least, read whole; rows that share a doc_id are one document, its parts in the order of the hashes of their texts, so of equal rows
one keeps its words; a null doc_id is an id of its own, before all others; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import blocks as B
from tessera.llm import texts as T

_LANE = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))
_LOW = np.uint64(0xFFFFFFFF)
#: Bytes of text, and words, that are worked on at a time: their arrays stay in a core's cache.
TEXT, SOME = 1 << 17, 1 << 14


class Words:
    """The words of a block: where they start and end, and their document."""

    def __init__(self, block: B.Block):
        self.block = block
        self.data, at = block.data, block.at
        begin, end, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
        while i < len(block):
            j = max(i + 1, int(np.searchsorted(at, at[i] + TEXT, "right")) - 1)
            b, e = T.edges(T.solid(self.data[at[i] : at[j]]), at[i : j + 1] - at[i])
            begin.append((b + at[i]).astype(np.int32))
            end.append((e + at[i]).astype(np.int32))
            i = j
        self.start, self.end = np.concatenate(begin), np.concatenate(end)
        self.word_at = np.searchsorted(self.start, at)
        self._view = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.block), dtype=np.int32), np.diff(self.word_at))

    def hashes(self, which: np.ndarray | None, lane: int) -> np.ndarray:
        """Hashes of the words ``which`` (None: all)."""
        if self._view is None:
            self._view = T.loads(self.data)
        n = len(self) if which is None else len(which)
        out = np.empty(n, np.uint64)
        for i in range(0, n, SOME):
            some = slice(i, min(i + SOME, n)) if which is None else which[i : i + SOME]
            out[i : i + SOME] = T.hashes(self.data, self.start[some], self.end[some], lane, self._view)
        return out


def _windows(words: np.ndarray, base: int, lane: int) -> np.ndarray:
    """Hashes of the windows of ``base`` neighbours at each place."""
    out = np.zeros(len(words), np.uint64)
    ext = np.concatenate([words, np.zeros(base, np.uint64)])
    for i in range(0, len(words), SOME):
        h = out[i : i + SOME]
        for j in range(base):
            h *= _LANE[lane]
            h += ext[i + j : i + j + len(h)]
        out[i : i + SOME] = T.mix(h)
    return out


def _doubled(h: np.ndarray, half: int, lane: int) -> np.ndarray:
    """Hashes of windows of twice the length, from those of the halves."""
    out = h * _LANE[lane]
    out[:-half] += h[half:]
    return T.mix(out)


class Level:
    """The candidates of a level in a block. Only words that some candidate covers are looked at: ``words`` are their numbers, ``at`` the candidates' places among them."""

    def __init__(self, w: Words, levels: list[int], k: int, start: np.ndarray):
        """``start``: the words that start candidates."""
        self.w, self.levels, self.k = w, levels, k
        self.words = np.flatnonzero(B.covered(start, levels[k]))
        place = np.cumsum(B.covered(start, levels[k]), dtype=np.int64) - 1
        self.start = np.flatnonzero(start)
        self.at = place[self.start]
        self.h = self.lane(0)
        self.own = self.h[self.at]

    def lane(self, lane: int) -> np.ndarray:
        h = _windows(self.w.hashes(None if len(self.words) == len(self.w) else self.words, lane), self.levels[0], lane)
        for half in self.levels[: self.k]:
            h = _doubled(h, half, lane)
        return h

    def note(self) -> bytes:
        mask = np.zeros(len(self.w), bool)
        mask[self.start] = True
        return np.packbits(mask).tobytes()

    def longer(self, again: np.ndarray) -> np.ndarray:
        """Which words start candidates of the next level, if the candidates ``again`` are known elsewhere."""
        length = self.levels[self.k]
        known = np.zeros(len(self.w) + length, bool)
        known[self.start[again]] = True
        both = known[: len(self.w)] & known[length:]
        p = np.flatnonzero(both)
        doc = self.w.doc
        both[p[doc[p] != doc[p + length]]] = False
        return both


def _whole(w: Words, length: int) -> np.ndarray:
    """Which words start a window of ``length`` words of one document; texts that equal an earlier one are left out."""
    ok = np.repeat(~w.block.copies(strict=False), np.diff(w.word_at))
    for j in range(1, length):
        last = w.word_at[1:] - j
        ok[last[last >= w.word_at[:-1]]] = False
    return ok


def _level(block: B.Block, levels: list[int], k: int) -> Level:
    """The candidates of level ``k``; ``block`` has the answers of the round before."""
    w = Words(block)
    if k == 0:
        return Level(w, levels, 0, _whole(w, levels[0]))
    before = _noted(w, levels, k - 1)
    bits = block.bits(k - 1)
    if bits is None:
        return Level(w, levels, k, np.zeros(len(w), bool))
    order, new = B.grouped(before.own)
    again = np.zeros(len(order), bool)
    again[order] = bits.astype(bool)[np.cumsum(new) - 1]
    return Level(w, levels, k, before.longer(again))


def _noted(w: Words, levels: list[int], k: int) -> Level:
    """The candidates of level ``k`` again, as the block noted them (all windows, at the first level)."""
    if k == 0:
        return Level(w, levels, 0, _whole(w, levels[0]))
    return Level(w, levels, k, np.unpackbits(w.block.note(k), count=len(w)).astype(bool) if len(w.block.note(k)) else np.zeros(len(w), bool))


def _sender(levels: list[int], buckets: list[int], k: int):
    last = k == len(levels) - 1

    def send(block: B.Block) -> Iterator[tuple[int, int, bytes]]:
        level = _level(block, levels, k)
        if not len(level.start):
            return
        if k:
            note = level.note()
            yield -1, len(note), note
        if last:
            yield from _final(block, level, buckets[k])
            return
        order, new = B.grouped(level.own)
        lead, _ = B.leads(new)
        h, many = level.own[order[lead]], np.diff(lead, append=len(order)) > 1
        low = (h & _LOW).astype(np.uint32)
        for b, i, j in B.shares(h, buckets[k]):
            yield b, j - i, low[i:j].tobytes() + np.packbits(many[i:j]).tobytes()

    return send


def _firsts(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last level: an order of the candidates by their window, where groups begin, the candidate of each group that starts first in the block, and the second hash."""
    second = level.lane(1)[level.at]
    order, new = B.grouped(level.own, second)
    block = level.w.block
    place = np.empty(len(block), np.int64)
    place[np.lexsort((np.arange(len(block)), block.parts, block.ids))] = np.arange(len(block))
    when = (place[level.w.doc[level.start]] << 32) | level.start
    lead, group = B.leads(new)
    least = np.minimum.reduceat(when[order], lead)
    first = np.empty(len(lead), np.int64)
    is_least = when[order] == least[group]
    first[group[is_least]] = order[is_least]
    return order, new, first, second


def _final(block: B.Block, level: Level, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    _, _, first, second = _firsts(level)
    h, second, doc = level.own[first], second[first], level.w.doc[level.start[first]]
    low = (h & _LOW).astype(np.uint32)
    for b, i, j in B.shares(h, buckets):
        docs, index = np.unique(doc[i:j], return_inverse=True)
        head = np.array([len(docs)], np.uint32).tobytes() + block.ids[docs].tobytes() + block.parts[docs].tobytes()
        yield b, j - i, head + low[i:j].tobytes() + second[i:j].tobytes() + index.astype(np.uint32).tobytes()


def _repeated(got: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """Filter levels: is the window known to more than one block, or twice to its own?"""
    counts = [n for _, n, _ in got]
    low = np.concatenate([np.frombuffer(p, np.uint32, n) for _, n, p in got])
    own = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=4 * n), count=n) for _, n, p in got])
    both = (low.astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64)
    both.sort()
    s = both >> np.uint64(32)
    many = np.zeros(len(s), np.uint8)
    same = s[1:] == s[:-1]
    many[1:] |= same
    many[:-1] |= same
    own[both & _LOW] |= many
    return np.split(own, np.cumsum(counts)[:-1])


def _earlier(got: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """Last level: does another block have the window in a document before the one named, or earlier in the same?"""
    low, second, index, ids, parts, whose, seen = [], [], [], [], [], [], 0
    for k, (_, n, p) in enumerate(got):
        d = int(np.frombuffer(p, np.uint32, 1)[0])
        raw = np.frombuffer(p, np.uint8, offset=4)
        ids.append(raw[: 8 * d].view(np.uint64))
        parts.append(raw[8 * d : 16 * d].view(np.uint64))
        raw = raw[16 * d :]
        low.append(raw[: 4 * n].view(np.uint32))
        second.append(raw[4 * n : 12 * n].view(np.uint64))
        index.append(raw[12 * n :].view(np.uint32).astype(np.int64) + seen)
        whose.append(np.full(d, got[k][0]))
        seen += d
    ids, parts, whose = np.concatenate(ids), np.concatenate(parts), np.concatenate(whose)
    rank = np.empty(seen, np.int64)
    rank[np.lexsort((np.arange(seen), whose, parts, ids))] = np.arange(seen)
    rank = rank[np.concatenate(index)]
    order, new = B.grouped(np.concatenate(second), np.concatenate(low).astype(np.uint64))
    lead, group = B.leads(new)
    out = np.empty(len(order), np.uint8)
    out[order] = np.minimum.reduceat(rank[order], lead)[group] < rank[order]
    return np.split(out, np.cumsum([n for _, n, _ in got])[:-1])


def _finish(levels: list[int], k: int):
    """Cuts the words that windows of the last level cover; without one (``k`` < 0), nothing."""
    last = len(levels) - 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks_of(batches):
            w = Words(block)
            start = np.zeros(len(w), bool)
            bits = block.bits(last) if k == last else None
            if bits is not None and len(bits):
                level = _noted(w, levels, last)
                order, new, first, _ = _firsts(level)
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(new) - 1
                gone = bits.astype(bool)[group]
                gone |= first[group] != np.arange(len(group))
                start[level.start[gone]] = True
            n = np.diff(w.word_at)
            removed = B.covered(start, levels[last]) | np.repeat(block.copies(strict=False) & (n >= levels[last]), n)
            yield pa.RecordBatch.from_arrays(_kept(w, removed), names=["doc_id", "n_words", "n_removed", "text"])

    return finish


def _kept(w: Words, removed: np.ndarray) -> list[pa.Array]:
    at = w.word_at
    sums = np.concatenate([[0], np.cumsum(removed)])
    n_words, n_removed = np.diff(at), np.diff(sums[at])
    # the bytes of kept words and one blank after each, but not after a document's last: that blank ends up where the next text begins
    keep = np.flatnonzero(~removed)
    s, e = w.start[keep].astype(np.int64), w.end[keep].astype(np.int64)
    n = n_words - n_removed
    last = np.cumsum(n)[n > 0] - 1
    blank = np.ones(len(keep), np.int64)
    blank[last] = 0
    size = e - s + blank
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(total[-1], np.uint8)
    for i in range(0, len(keep), SOME):
        j = min(i + SOME, len(keep))
        m = size[i:j]
        where = np.repeat(s[i:j] - (total[i:j] - total[i]), m) + np.arange(total[j] - total[i])
        out[total[i] : total[j]] = w.data[np.minimum(where, len(w.data) - 1)]
    out[total[1:][blank > 0] - 1] = 0x20
    offsets = total[np.concatenate([[0], np.cumsum(n)])]
    text = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
    return [w.block.doc_ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text.cast(pa.string())]


def remove_repeats(docs: DataFrame, window: int = 20, base: int = 5, block_bytes: int = 4 << 20, bucket_bytes: float = 8e6) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space) of every document of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document of smaller doc_id, or earlier
    in the same one. ``window`` is ``base`` times a power of two.
    """
    levels = [base]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window:
        raise ValueError("window must be base times a power of two")
    last = len(levels) - 1
    blocks = B.build(docs, block_bytes)
    total = B.text_bytes(blocks)
    # about 6 bytes of text a word; a distinct window costs 4 bytes at a filter level and 16 at the last
    buckets = [B.number_of_buckets(total / 6 * (16 * 0.4 if k == last else 4 * (0.5 if k else 1)), bucket_bytes) for k in range(len(levels))]
    copies = {"c": B.copies(blocks, strict=False)}
    rounds: dict[int, DataFrame] = {}
    decided = -1
    for k in range(len(levels)):
        found = B.exchange(B.with_answers(blocks, copies | ({k - 1: rounds[k - 1]} if k else {})), _sender(levels, buckets, k), _earlier if k == last else _repeated)
        rounds[k] = found
        if not found.where("n > 0").head(1):  # no candidate, here or at any later level
            break
        decided = k
    return B.with_answers(blocks, copies | ({last: rounds[last]} if decided == last else {})).mapInArrow(_finish(levels, decided), "doc_id bigint, n_words bigint, n_removed bigint, text string")

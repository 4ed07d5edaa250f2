"""Duplicate byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A text that equals one of a smaller document goes whole and takes no further part: the smaller one holds all its strings. All strings of ``length`` bytes that two of the other
documents share are found in three steps.

1. Partition. A string's anchor is the leftmost of its ``GRAM``-byte grams with the smallest hash, so equal strings have equal
   anchors, and the bytes on one side of it in common as well. One exchange of packed hashes of these (see blocks.py) leaves what two documents share.
2. Expansion. The strings with one anchor position form a segment of a document's bytes. A block sends its distinct segments,
   with the smallest document that holds each, to the bucket of the anchor's hash. A segment that all holders of an anchor have alike is one interval as it stands. The others go, each distinct one
   once, into Burrows-Wheeler transforms (of about ``TEXT`` letters of up to 5 bytes, never parting an anchor), whose intervals are
   expanded breadth first: a boundary with common prefix q is carried one character backwards and gives boundaries with common prefix
   q + 1, so common prefixes come out by increasing value; the expansion stops at ``length``. What has no boundary by then
   is a group of equal strings, and the smallest document of each group is known.
3. Removal. The answers are bits a string of each segment; each block marks and cuts its own bytes.

An anchor that ``hot`` blocks or more hold could bring one bucket a segment from every document (a common passage amid differing text). Its
strings are sent one by one to buckets by their own hash instead: equal ones still meet, and no bucket gets more than one entry a block of any string.

Segments are taken as equal where two independent 64-bit hashes, the gram and the size are equal.

Defined results: a null or empty text has no bytes; a document shorter than ``length`` stays whole; a text of any length is read whole, in chunks; matches never cross rows; rows that
share a doc_id are one document and remove nothing from each other; a null doc_id is an id of its own, before all others; an empty table gives an empty table; other columns
are not read, whatever their names. Cut text is bytes, since a cut can split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import blocks as B
from tessera.llm import texts as T

GRAM = 20
#: Bytes of a transform's text, and string starts looked at at a time: their arrays stay in a core's cache.
TEXT, CHUNK = 60_000, 1 << 16
_PLACE = 17
_LOW = np.uint64(0xFFFFFFFF)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    v = T.loads(data)[: len(data) - 7].copy()
    h = v[:n] * _A
    h += v[8 : 8 + n] * _B
    h += v[GRAM - 8 : GRAM - 8 + n] * _C
    h ^= h >> np.uint64(32)
    h *= _D
    h ^= h >> np.uint64(29)
    return h


class Anchors:
    """The segments of a block: runs of string starts [first, last] with one anchor at ``place``, their document and their gram's hash.

    A run's strings have at least ``reach`` bytes before the anchor, or as many behind it, in common: these two halves of a run are what step 1 asks about, by hashes
    of the gram and those bytes. (The gram alone would be shared by chance ever more often as a corpus grows.)
    """

    def __init__(self, block: B.Block, length: int):
        self.block, self.length, self.data = block, length, block.data
        at, n = block.at, len(block.data)
        # strings start where at least ``length`` bytes of the text are left
        size = np.diff(at)
        mark = np.zeros(n + 1, np.int8)
        long = np.flatnonzero((size >= length) & ~block.copies(strict=True))
        mark[at[long]] = 1
        mark[at[long + 1] - length + 1] -= 1
        ok = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
        reach = (length - GRAM + 1) // 2
        first, where_at, gram, before, behind, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], *([np.zeros(0, np.uint64)] for _ in range(3)), []
        low = np.uint32((1 << _PLACE) - 1)
        for s in range(0, n - length + 1, CHUNK):
            e = min(s + CHUNK, n - length + 1)
            h = _grams(self.data[s : e + length - 1])
            # the hash's upper bits, then the place: the smallest is the leftmost gram with the smallest hash
            key = ((h >> np.uint64(32)).astype(np.uint32) & ~low) | np.arange(len(h), dtype=np.uint32)
            where = _sliding_min(key, length - GRAM + 1) & low
            # a run begins where the anchor changes, or a text or the chunk begins
            here = ok[s:e]
            new = np.ones(e - s, bool)
            np.not_equal(where[1:], where[:-1], out=new[1:])
            new[1:] |= ~here[:-1]
            new &= here
            new = np.flatnonzero(new)
            p = where[new].astype(np.int64)
            first.append(new + s)
            where_at.append(p + s)
            own = h[p]
            gram.append(T.mix(own))  # anchors have small hashes; these spread over all buckets
            before.append(T.mix(own * _A + h[np.maximum(p - reach, 0)]))
            behind.append(T.mix(own * _B + h[np.minimum(p + reach, len(h) - 1)]))
            ends.append(e)
        self.first, self.gram, place = np.concatenate(first), np.concatenate(gram), np.concatenate(where_at)
        self.doc = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(np.searchsorted(self.first, at)))
        # and lasts until the next one begins, or its text or chunk has no more strings
        self.last = np.minimum(np.append(self.first[1:], n) - 1, at[self.doc + 1] - length)
        if len(self.first):
            self.last = np.minimum(self.last, np.array(ends)[self.first // CHUNK] - 1)
        # the last string with enough before the anchor, and the halves that have strings: by their runs, those before first
        self.middle = np.minimum(self.last, place - reach)
        self.left, self.right = np.flatnonzero(self.first <= self.middle), np.flatnonzero(self.middle < self.last)
        self.half = np.concatenate([np.concatenate(before)[self.left], np.concatenate(behind)[self.right]])
        # documents by id: rows that share one have one number
        self.ids, number = np.unique(block.ids, return_inverse=True)
        self.number = number.astype(np.int32)

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What step 1 sends: halves of runs in the order of their hashes, where a hash begins, and their documents by id."""
        order, new = B.grouped(self.half)
        return order, new, self.number[self.doc[np.concatenate([self.left, self.right])[order]]]

    def candidates(self, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Step 2's segments after step 1's answers: start, end, document by id, and the key that chooses the bucket. Halves that are both shared make one segment."""
        if codes is None or not codes.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        order, new = B.grouped(self.half)
        code = np.empty(len(order), np.uint8)
        code[order] = codes[np.cumsum(new) - 1]
        halves = np.zeros((2, len(self.first)), np.uint8)
        halves[0, self.left], halves[1, self.right] = code[: len(self.left)], code[len(self.left) :]
        second = np.maximum(self.first, self.middle + 1)
        pick = np.flatnonzero((halves == 1).any(axis=0))
        start = np.where(halves[0, pick] == 1, self.first[pick], second[pick])
        end = np.where(halves[1, pick] == 1, self.last[pick], self.middle[pick]) + self.length
        doc, key = self.number[self.doc[pick]], self.gram[pick]
        runs = [(np.flatnonzero(halves[0] > 1), self.first, self.middle), (np.flatnonzero(halves[1] > 1), second, self.last)]
        for hot, a, z in runs:
            if len(hot):
                n = z[hot] - a[hot] + 1
                s = _ranges(a[hot], n)
                start, end = np.concatenate([start, s]), np.concatenate([end, s + self.length])
                doc = np.concatenate([doc, np.repeat(self.number[self.doc[hot]], n)])
                key = np.concatenate([key, T.mix(T.hashes(self.data, s, s + self.length, 0))])
        return start, end, doc, key

    def distinct(self, start, end, doc, key) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct segment one with the smallest document, in the order of keys; and each candidate's distinct segment."""
        view = T.loads(self.data)
        a, b = (T.hashes(self.data, start, end, lane, view) for lane in (0, 1))
        order, new = B.grouped(key, a, b, (end - start).astype(np.uint64))
        lead, group = B.leads(new)
        index = np.empty(len(order), np.int64)
        index[order] = group
        if not len(order):
            return order, index
        least = np.minimum.reduceat(doc[order], lead)
        one = np.empty(len(lead), np.int64)
        is_least = doc[order] == least[group]
        one[group[is_least]] = order[is_least]
        return one, index


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them) of each."""
    total = np.cumsum(n)
    return np.repeat(start - (total - n), n) + np.arange(total[-1] if len(total) else 0)


def _send_grams(length: int, buckets: int):
    def send(block: B.Block) -> Iterator[tuple[int, int, bytes]]:
        a = Anchors(block, length)
        if not len(a.half):
            return
        order, new, who = a.halves()
        lead, _ = B.leads(new)
        two = np.minimum.reduceat(who, lead) != np.maximum.reduceat(who, lead)
        h = a.half[order[lead]]
        low = (h & _LOW).astype(np.uint32)
        for b, i, j in B.shares(h, buckets):
            yield b, j - i, low[i:j].tobytes() + np.packbits(two[i:j]).tobytes()

    return send


def _shared(hot: int):
    def answer(got: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        """0: one document only, 1: shared, 2: shared by very many blocks."""
        low = np.concatenate([np.frombuffer(p, np.uint32, n) for _, n, p in got])
        two = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=4 * n), count=n) for _, n, p in got])
        both = (low.astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64)
        both.sort()
        s, order = both >> np.uint64(32), (both & _LOW).astype(np.int64)
        lead, group = B.leads(np.concatenate([[True], s[1:] != s[:-1]]))
        blocks = np.diff(lead, append=len(s))
        known = (blocks > 1) | (np.maximum.reduceat(two[order], lead) > 0)
        out = np.empty(len(s), np.uint8)
        out[order] = (known + (blocks >= hot).astype(np.uint8))[group]
        return np.split(out, np.cumsum([n for _, n, _ in got])[:-1])

    return answer


def _noted(start: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[int, bytes]:
    """What a block notes of its candidates: where they start, the distinct segment that each is, and their sizes."""
    note = _squeezed(np.diff(start, prepend=0).astype(np.int32).tobytes() + index.astype(np.uint32).tobytes() + size.astype(np.uint8).tobytes())
    return len(note), note


def _squeezed(data: bytes) -> bytes:
    """Compressed, behind its size."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unsqueezed(data) -> np.ndarray:
    view = memoryview(data)
    return np.frombuffer(pa.decompress(pa.py_buffer(view[8:]), int.from_bytes(view[:8], "little"), "zstd"), np.uint8)


def _send_segments(length: int, buckets: tuple[int, int]):
    def send(block: B.Block) -> Iterator[tuple[int, int, bytes]]:
        a = Anchors(block, length)
        start, end, doc, key = a.candidates(block.bits(0, 2))
        one, index = a.distinct(start, end, doc, key)
        if len(start):
            yield (-1, *_noted(start, end - start, index))
        start, size, doc, key = start[one], (end - start)[one], doc[one], key[one]
        low = (key & _LOW).astype(np.uint32)
        for b, i, j in B.shares(key, buckets[1]):
            docs, index = np.unique(doc[i:j], return_inverse=True)
            head = np.array([len(docs), j - i], np.uint32).tobytes() + a.ids[docs].tobytes()
            body = a.data[_ranges(start[i:j], size[i:j])]
            n = int(size[i:j].sum()) - (j - i) * (length - 1)
            yield b, n, _squeezed(head + low[i:j].tobytes() + index.astype(np.uint32).tobytes() + size[i:j].astype(np.uint8).tobytes() + body.tobytes())

    return send


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` (small ints) in the order of at least their first ``depth`` symbols, by putting ranks of shorter prefixes together."""
    n = len(text)
    width = max(1, int(text.max()).bit_length())
    size, rank = 1, text.astype(np.uint64)
    while True:
        ways = 64 // width
        ext = np.concatenate([rank, np.resize(rank, (ways - 1) * size)])
        key = rank
        for j in range(1, ways):
            key = (key << np.uint64(width)) | ext[j * size : j * size + n]
        size *= ways
        order = np.argsort(key)
        if size >= depth:
            return order
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])).astype(np.uint64)
        width = max(1, int(rank[order[-1]]).bit_length())


def long_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted rotations of ``text`` and whether each begins a group: it shares fewer than ``length`` symbols with the one before.

    Breadth-first backward extension: level q carries the boundaries of common prefix q - 1 one character back through the
    transform. A row p of the sorted matrix is reached from row i with p = LF(i); its common prefix with the row before is q
    if some boundary of level q - 1 lies after the last row before i with the same character, and at or before i. Those boundaries were
    undecided rows a level ago, so a level works on undecided rows alone, counted in their own order: few are left after some levels.
    """
    order = suffix_order(text, length)
    bwt = text[order - 1]
    small = bwt.astype(np.uint16) if text.max() < 1 << 16 else bwt  # sorted by counting
    i = np.argsort(small, kind="stable")  # the row that row p is reached from
    chars = bwt[i]
    found = np.concatenate([[True], chars[1:] != chars[:-1]])  # common prefix 0
    p = np.flatnonzero(~found)
    passed = np.cumsum(found, dtype=np.int32)
    before, here = i[p - 1], i[p]
    hit = passed[here] != passed[before]  # common prefix 1
    # how many undecided rows there are up to the two rows
    low, high = (before + 1 - passed[before]).astype(np.int32), (here + 1 - passed[here]).astype(np.int32)
    for _ in range(1, length):
        if not hit.any():
            break
        found[p[hit]] = True
        passed = np.zeros(len(hit) + 1, np.int32)
        np.cumsum(hit, out=passed[1:])
        stay = np.flatnonzero(~hit)
        p, low, high = p[stay], low[stay], high[stay]
        down, up = passed[low], passed[high]
        hit = down != up
        low -= down
        high -= up
    return order, found


def letter_bytes(length: int) -> int:
    """How many bytes a transform's letter has: strings are whole numbers of letters, and a letter fits a number."""
    return max(k for k in range(1, 6) if length % k == 0)


def smallest_holders(body: np.ndarray, start: np.ndarray, size: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For every string of the segments [start, start + size) of ``body``, segment by segment: the smallest rank of a segment that holds it.

    The transform's text has letters of several bytes, so its intervals reach ``length`` bytes in fewer levels: of each segment, the letters from its first
    byte on, then those from its second byte on, and so on.
    """
    unit = letter_bytes(length)
    k = np.arange(unit)
    letters = np.maximum((size[:, None] - k) // unit, 0)  # of each segment and first byte
    n = (letters + 1).ravel()
    place = np.cumsum(n) - n
    inside = np.repeat((start[:, None] + k).ravel() - place * unit, n) + np.arange(n.sum()) * unit
    last = place + letters.ravel()
    inside[last] = 0
    value = T.loads(body)[inside] & np.uint64((1 << 8 * unit) - 1)
    value[last] = 0
    both = (value << np.uint64(24)) | np.arange(len(value), dtype=np.uint64)
    both.sort()
    place_of = (both & np.uint64(0xFFFFFF)).astype(np.int64)
    both >>= np.uint64(24)
    text = np.empty(len(value), np.int64)
    text[place_of] = np.cumsum(np.concatenate([[True], both[1:] != both[:-1]]))
    text[last] = 0  # parts the runs of letters
    rows, begins = long_groups(text, length // unit)
    # strings start where at least ``length`` bytes of the segment are left
    strings = letters.ravel() - length // unit + 1
    is_string = np.zeros(len(text) + 1, np.int8)
    some = np.flatnonzero(strings > 0)
    is_string[place[some]] = 1
    is_string[place[some] + strings[some]] -= 1
    is_string = np.cumsum(is_string[:-1], dtype=np.int8) > 0
    who = np.repeat(np.repeat(rank, unit), n)
    at = rows[is_string[rows]]
    group = np.cumsum(begins)[is_string[rows]]
    lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    who[at] = np.repeat(np.minimum.reduceat(who[at], lead), np.diff(lead, append=len(at)))
    # back to the order of the bytes: string j of a segment is letter j // unit of the run that starts at byte j % unit
    m = size - length + 1
    j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return who[place[np.repeat(np.arange(len(size)) * unit, m) + j % unit] + j // unit]


def _received(got: list[tuple[int, int, bytes]]):
    """A bucket's segments: low bits of their keys, their documents' ids, sizes and bytes, and how many each sender sent."""
    low, ids, size, body, counts = [], [], [], [], []
    for _, _, p in got:
        raw = _unsqueezed(p)
        d, n = raw[:8].view(np.uint32).tolist()
        table, raw = raw[8 : 8 + 8 * d].view(np.uint64), raw[8 + 8 * d :]
        low.append(raw[: 4 * n].view(np.uint32))
        ids.append(table[raw[4 * n : 8 * n].view(np.uint32)])
        size.append(raw[8 * n : 9 * n])
        body.append(raw[9 * n :])
        counts.append(n)
    return np.concatenate(low), np.concatenate(ids), np.concatenate(size).astype(np.int64), np.concatenate(body), counts


def _expand(length: int):
    def answer(got: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        """For each segment and each string in it: does a smaller document than the segment's smallest hold the string?"""
        low, ids, size, body, counts = _received(got)
        start = np.cumsum(size) - size
        view = T.loads(body)
        a, b = (T.hashes(body, start, start + size, lane, view) for lane in (0, 1))
        # segments that several blocks sent are taken once, with the smallest document, anchor by anchor
        order, new = B.grouped((low.astype(np.uint64) << np.uint64(32)) | (a >> np.uint64(32)), low.astype(np.uint64), a, b, size.astype(np.uint64))
        lead, group = B.leads(new)
        index = np.empty(len(order), np.int64)
        index[order] = group
        least = np.minimum.reduceat(ids[order], lead)
        one = order[lead]
        strings = size[one] - length + 1
        place = np.cumsum(strings) - strings
        smallest = np.repeat(least, strings)
        anchor = low[one]
        begins = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        alone = begins & np.concatenate([begins[1:], [True]])
        differ = np.flatnonzero(~alone)
        for k in _portions(differ, begins[differ], size[one[differ]]):
            smallest[_ranges(place[k], strings[k])] = smallest_holders(body, start[one[k]], size[one[k]], least[k], length)
        # back to every segment that was sent
        n = size - length + 1
        out = (smallest[_ranges(place[index], n)] < np.repeat(ids, n)).astype(np.uint8)
        return np.split(out, np.cumsum([k for _, k, _ in got])[:-1])

    return answer


def _portions(which: np.ndarray, begins: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of segments of about TEXT bytes that part no anchor."""
    total = np.concatenate([[0], np.cumsum(size + 1)])
    cuts = np.concatenate([np.flatnonzero(begins), [len(which)]])
    i = 0
    while i < len(which):
        c = cuts[max(0, int(np.searchsorted(total[cuts], total[i] + TEXT, "right")) - 1)]
        j = int(c) if c > i else int(cuts[np.searchsorted(cuts, i, "right")])
        yield which[i:j]
        i = j


def _finish(length: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks_of(batches):
            gone, bits, note = np.zeros(0, np.int64), block.bits(1), block.note(1)
            copies = np.flatnonzero(block.copies(strict=True) & (np.diff(block.at) >= length))
            if bits is not None and len(note):
                note = _unsqueezed(note)
                m = len(note) // 9
                start, index = np.cumsum(note[: 4 * m].view(np.int32), dtype=np.int64), note[4 * m : 8 * m].view(np.uint32).astype(np.int64)
                n = note[8 * m :].astype(np.int64) - length + 1
                number = np.unique(block.ids, return_inverse=True)[1]
                doc = number[np.searchsorted(block.at, start, "right") - 1]
                # of each distinct segment: how many strings it has, and its smallest document
                order = np.argsort(index, kind="stable")
                lead = np.flatnonzero(np.diff(index[order], prepend=-1))
                strings, least = n[order[lead]], np.minimum.reduceat(doc[order], lead)
                place = np.cumsum(strings) - strings
                # a candidate's strings: an earlier document than the segment's smallest has it, or that smallest is not this one
                hit = bits[_ranges(place[index], n)].astype(bool) | np.repeat(doc > least[index], n)
                gone = _ranges(start, n)[hit]
            if len(copies):  # all strings of theirs
                gone = np.concatenate([gone, _ranges(block.at[copies], np.diff(block.at)[copies] - length + 1)])
            gone.sort()
            yield pa.RecordBatch.from_arrays(_cut(block, gone, length), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return finish


def _cut(block: B.Block, gone: np.ndarray, length: int) -> list[pa.Array]:
    """The block's texts less the bytes of the strings that start at ``gone``, in order."""
    at, size = block.at, np.diff(block.at)
    # runs of strings that touch, each within a text
    parted = np.ones(len(gone) + 1, bool)
    np.greater(gone[1:] - gone[:-1], length, out=parted[1:-1])
    parted[np.searchsorted(gone, at[1:-1])] = True
    parted[-1] = True
    begin, end = gone[parted[:-1]], gone[parted[1:]] + length
    run_at = np.searchsorted(begin, at)
    total = np.concatenate([[0], np.cumsum(end - begin)])[run_at]
    removed, spans = np.diff(total), np.diff(run_at)
    offsets = np.concatenate([[0], np.cumsum(size - removed)])
    view = memoryview(block.data)
    body = b"".join(view[i:j] for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(block.data)], strict=True))
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])
    return [block.doc_ids, *(pa.array(x, pa.int64()) for x in (size, removed, spans)), kept.cast(pa.binary())]


def remove_shared(docs: DataFrame, length: int = 50, hot: int = 128, block_bytes: int = 4 << 20, bucket_bytes: float = 8e6) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document of smaller doc_id. ``length`` is 2 * GRAM
    to 128 (a segment's size fits a byte).
    """
    if not 2 * GRAM <= length <= 128:
        raise ValueError(f"length must be {2 * GRAM} to 128")
    blocks = B.build(docs, block_bytes)
    total = B.text_bytes(blocks)
    # an anchor every 16 bytes or so, two halves of 4 bytes each; then about a quarter of them again with segments of 75 bytes
    buckets = (B.number_of_buckets(total / 16 * 8, bucket_bytes), B.number_of_buckets(total / 16 * 0.25 * 75, bucket_bytes))
    known = {"c": B.copies(blocks, strict=True)}
    shared = B.exchange(B.with_answers(blocks, known), _send_grams(length, buckets[0]), _shared(hot), 2)
    found = B.exchange(B.with_answers(blocks, known | {0: shared}), _send_segments(length, buckets), _expand(length))
    return B.with_answers(blocks, known | {1: found}).mapInArrow(_finish(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

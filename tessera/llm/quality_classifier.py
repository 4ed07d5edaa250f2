"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed for many texts at once in numpy: sizes, shares of kinds of characters, repetition of words, and
the worst value of some of them over segments of ``SEGMENT`` words, so that a bad passage shows in a long text (a segment of fewer than a quarter of that counts as 0
there, so texts of under 12 words have no worst values). The trees are fitted on the driver from the
statistics of at most ``max_rows`` labelled documents (a documented bound: the rows with the smallest hashes of their ids); every document is scored.

Defined results: a null or empty text has all statistics 0 and gets a score like any other; a text of any length is measured whole, by itself if it is longer than
a portion; equal texts score alike; rows that repeat a doc_id are scored one by one; unlabelled rows and null labels are not learned from; without any labelled row all
scores are 0.5; an empty table gives an empty table; other columns are not read, whatever their names, and ``keep_good`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import gbt
from tessera.llm import shingles as S
from tessera.llm import texts as T

SEGMENT = 48
PORTION = 1 << 17
_KINDS = {
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "symbol": b"#*$%&<>@^~_\\{}=+",
    "bar": b"|",
    "mark": b"!?",
    "stop": b".,;:",
    "wide": range(0x80, 0x100),
    "line": b"\n",
}
_WORST = ("upper", "digit", "symbol", "bar", "mark", "stop")
FEATURES = ["bytes", "words", "word_size", *_KINDS, "distinct", "same_as_last", "repeated_3", "top_word", "short_words", "long_words", *(f"worst_{k}" for k in _WORST), "worst_same", "worst_distinct"]


_CLASS = np.zeros(256, np.uint8)
for _k, _members in enumerate(_KINDS.values(), 1):
    _CLASS[list(_members)] = _k


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _largest(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """The largest value of each group, 0 where it has none; groups are in order."""
    out = np.zeros(groups)
    if len(group):
        lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[lead]] = np.maximum.reduceat(value, lead)
    return out


def _times(group: np.ndarray, value: np.ndarray, groups: int):
    """Distinct values a group, values that occur again, and the most frequent one's count. Values are compared by as many leading bits as the groups leave."""
    bits = np.uint64(max(groups - 1, 1).bit_length())
    key = np.sort((group.astype(np.uint64) << (np.uint64(64) - bits)) | (value >> bits))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    lead = np.flatnonzero(new)
    count = np.diff(lead, append=len(key))
    g = (key[lead] >> (np.uint64(64) - bits)).astype(np.int64)
    return np.bincount(g, minlength=groups), np.bincount(g, count * (count > 1), groups), _largest(g, count, groups)


def statistics(texts: list[bytes]) -> np.ndarray:
    return measures(*S.joined(texts))


def measures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(at) - 1
    begin, end = T.edges(T.solid(data), at)
    size, length = np.diff(at), end - begin
    words = np.diff(np.searchsorted(begin, at))
    doc = np.repeat(np.arange(n), words)
    first = np.cumsum(words) - words
    h = T.hashes(data, begin, end)
    inner = np.arange(len(h)) - first[doc]
    # segments of words, numbered through the texts; the last one of a text may be short
    segments = -(-words // SEGMENT)
    seg = (np.cumsum(segments) - segments)[doc] + inner // SEGMENT
    seg_doc = np.repeat(np.arange(n), segments)
    seg_words = np.bincount(seg, minlength=len(seg_doc))

    def worst(per_segment: np.ndarray) -> np.ndarray:
        return _largest(seg_doc, per_segment * (seg_words >= SEGMENT // 4), n)

    # bytes of some kind are a tenth of a text or so: they alone are counted, by text and by segment
    kind = _CLASS.take(data)
    some = np.flatnonzero(kind > 0)
    kind = kind[some].astype(np.int64) - 1
    m = len(_KINDS)
    of_doc = np.bincount((np.searchsorted(at, some, "right") - 1) * m + kind, minlength=n * m).reshape(n, m)
    word = np.searchsorted(begin, some, "right") - 1
    inside = kind != list(_KINDS).index("line")
    of_seg = np.bincount(seg[word[inside]] * m + kind[inside], minlength=len(seg_doc) * m).reshape(len(seg_doc), m)
    seg_bytes = np.bincount(seg, length, len(seg_doc))

    cols = [np.log1p(size), np.log1p(words), _ratio(np.bincount(doc, length, n), words)]
    bad = []
    for k, name in enumerate(_KINDS):
        cols.append(_ratio(of_doc[:, k], size if name in ("upper", "digit", "wide") else words))
        if name in _WORST:
            bad.append(worst(_ratio(of_seg[:, k], seg_bytes)))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, _, most = _times(doc, h, n)
    has3 = np.flatnonzero(inner + 2 < words[doc])
    step = np.uint64(0x9FB21C651E98DF25)
    _, again, _ = _times(doc[has3], T.mix((h[has3] * step + h[has3 + 2]) * step + h[has3 + 1]), n)
    seg_distinct, _, _ = _times(seg, h, len(seg_doc))
    cols += [_ratio(distinct, words), _ratio(np.bincount(doc, same, n), words), _ratio(again, words), _ratio(most, words)]
    cols += [_ratio(np.bincount(doc, length == 1, n), words), _ratio(np.bincount(doc, length > 20, n), words)]
    cols += bad
    cols += [worst(_ratio(np.bincount(seg, same, len(seg_doc)), seg_words)), worst(1 - _ratio(seg_distinct, seg_words))]
    return np.stack(cols, axis=1)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """doc_id, text, y of at most ``max_rows`` labelled documents with ``learn``, by the hash of their ids; both classes alike if they exceed the bound."""
    own = labels.where(F.col(label).isNotNull() & learn).select("doc_id", F.col(label).cast("int").alias("y"))
    half = max_rows // 2
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = own.where("y = 1").orderBy(*order).limit(half).union(own.where("y = 0").orderBy(*order).limit(half))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # max_rows of two numbers


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in T.parts(batches, PORTION):
        x = measures(data, at)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*rows.columns[:2], lists], names=["doc_id", "y", "x"])


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = gbt.Trees(*shared.value)
        for rows, data, at in T.parts(batches, PORTION):
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(trees.score(measures(data, at)))], names=["doc_id", "row", "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, max_rows: int = 20000, **kw) -> gbt.Trees:
    learn = F.lit(True) if learn is None else learn
    rows = sample(docs, labels, label, learn, max_rows).select("doc_id", F.col("y").cast("bigint").alias("y"), T.whole())
    got = rows.mapInArrow(_measured, "doc_id bigint, y bigint, x array<double>").toPandas().sort_values("doc_id")
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    return gbt.fit(x, got["y"].to_numpy(np.float64), **kw)


def score(docs: DataFrame, trees: gbt.Trees) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.leaf, trees.base))  # some 100 kB whatever the input
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), T.whole()).mapInArrow(_scored(shared), "doc_id bigint, row bigint, score double")


def _good(shared, at_least: float):
    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = gbt.Trees(*shared.value)
        for rows, data, at in T.parts(batches, PORTION):
            yield rows.filter(pa.array(trees.score(measures(data, at)) >= at_least))

    return good


def keep_good(docs: DataFrame, trees: gbt.Trees, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``at_least``. Rows go through as they are, null texts too."""
    shared = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.leaf, trees.base))
    return docs.mapInArrow(_good(shared, at_least), docs.schema)

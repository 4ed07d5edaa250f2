"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes of the word with a mark at both ends) and itself, hashed to ``BUCKETS`` rows of an embedding table; its
vector is their mean, a segment's is the mean of its words', and a two-class linear softmax over that is trained jointly with the table in numpy (AdaGrad on mini-batches).
A misspelling never seen shares most n-grams with the word it comes from.

A few words in a long text vanish in its mean, so texts are read in segments of ``SEGMENT`` words that overlap by half, and a text's score is that of its most
toxic segment: training starts from all segments with their text's label, then keeps, for toxic texts, the segments that the model finds most toxic (the others may
be harmless), and for clean texts all. A last logistic fit on texts turns the largest segment score into a probability. At inference the table and the softmax collapse into
one number a bucket.

The model learns from at most ``max_rows`` labelled texts of ``max_bytes`` bytes together (documented bounds; both classes alike; texts of all lengths, whole); every whole text is scored.

Defined results: a null or empty text scores as a segment without words; a text of any length is read whole, segment by segment; equal texts score alike; rows that repeat
a doc_id are scored one by one; unlabelled rows and null labels are not learned from; without rows of both classes all scores are 0.5; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm import texts as T
from tessera.llm.quality_classifier import sample
from tessera.session import cut

PORTION = 1 << 18

BUCKETS, DIM, SEGMENT = 1 << 16, 8, 16
SIZES = (3, 4, 5)


class Bag:
    """The words of some texts: distinct words with their bytes' n-gram buckets, and for each word of each text its index."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = T.lower(data)
        # blanks, controls and ASCII punctuation part words
        begin, end = T.edges(((data - np.uint8(0x30)) < 10) | ((data - np.uint8(0x61)) < 26) | (data >= 0x80), at)
        self.n = len(at) - 1
        self.doc = np.repeat(np.arange(self.n), np.diff(np.searchsorted(begin, at)))
        h = T.hashes(data, begin, end)
        fresh = np.ones(len(h), bool)  # a word said over and over counts once, or its score would fill a segment
        fresh[1:] = (h[1:] != h[:-1]) | (self.doc[1:] != self.doc[:-1])
        begin, end, self.doc = begin[fresh], end[fresh], self.doc[fresh]
        self.hash, first, word = np.unique(h[fresh], return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        self._data, self._begin, self._end = data, begin[first], end[first]

    def grams(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the distinct words ``pick``, and where each word's begin (one more entry at the end); its own hash is the first."""
        b, e = self._begin[pick], self._end[pick]
        size = e - b + 2
        total = np.cumsum(size)
        marked = np.full(total[-1] if len(size) else 0, 0x3C, np.uint8)  # < and > as marks, which no word has
        marked[total - 1] = 0x3E
        inside = np.ones(len(marked), bool)
        inside[total - 1] = inside[total - size] = False
        n = e - b
        marked[inside] = self._data[np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        view = T.loads(marked)
        owner, value = [np.arange(len(pick))], [self.hash[pick]]
        last = np.repeat(total, size)
        who = np.repeat(np.arange(len(pick)), size)
        at = np.arange(len(marked))
        for g in SIZES:
            ok = at[at + g <= last]
            owner.append(who[ok])
            value.append(T.mix((view[ok] & np.uint64((1 << 8 * g) - 1)) + np.uint64(g << 56)))
        owner, value = np.concatenate(owner), np.concatenate(value)
        order = np.argsort(owner, kind="stable")
        return (value[order] % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(owner[order], np.arange(len(pick) + 1))

    def all_grams(self, portion: int = 20000) -> tuple[np.ndarray, np.ndarray]:
        """``grams`` of all distinct words, worked out in portions."""
        parts = [self.grams(np.arange(i, min(i + portion, len(self.hash)))) for i in range(0, len(self.hash), portion)]
        sizes = np.concatenate([np.diff(at) for _, at in parts]) if parts else np.zeros(0, np.int64)
        return np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, last word + 1 and text of every segment; a text's last segment ends with it, and a text without words has none."""
        count = np.bincount(self.doc, minlength=self.n)
        first = np.cumsum(count) - count
        step = SEGMENT // 2
        k = np.where(count > 0, np.maximum(1, -(-(count - step) // step)), 0)
        doc = np.repeat(np.arange(self.n), k)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * step
        return first[doc] + at, first[doc] + np.minimum(at + SEGMENT, count[doc]), doc


def _means(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)


class Known:
    """Scores of words seen before, one a slot; a newer word takes an older one's slot."""

    def __init__(self, bits: int = 18):
        self.low = np.uint64((1 << bits) - 1)
        self.hash = np.arange(1, (1 << bits) + 1, dtype=np.uint64)  # no word with this hash has this slot
        self.score = np.zeros(1 << bits)

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and which words have none yet."""
        slot = words & self.low
        return self.score[slot], np.flatnonzero(self.hash[slot] != words)

    def put(self, words: np.ndarray, score: np.ndarray) -> None:
        slot = words & self.low
        self.hash[slot], self.score[slot] = words, score


class Model:
    """One number a bucket, an offset, and the last logistic fit."""

    def __init__(self, table: np.ndarray, offset: float, slope: float, shift: float):
        self.table, self.offset, self.slope, self.shift = table, offset, slope, shift

    def word_scores(self, bag: Bag, known: Known | None = None) -> np.ndarray:
        """The mean of each distinct word's buckets. ``known`` remembers words between calls."""
        out, new = (np.empty(len(bag.hash)), np.arange(len(bag.hash))) if known is None else known.look(bag.hash)
        for i in range(0, len(new), 20000):
            part = new[i : i + 20000]
            g, at = bag.grams(part)
            out[part] = np.add.reduceat(self.table[g], at[:-1]) / np.diff(at)
        if known is not None:
            known.put(bag.hash[new], out[new])
        return out

    def largest(self, bag: Bag, known: Known | None = None) -> np.ndarray:
        lo, hi, doc = bag.segments()
        z = np.zeros(bag.n)
        if len(doc):
            lead = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            z[doc[lead]] = np.maximum.reduceat(_means(self.word_scores(bag, known)[bag.word], lo, hi), lead)
        return z + self.offset

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.rate(Bag(*S.joined(texts)))

    def rate(self, bag: Bag, known: Known | None = None) -> np.ndarray:
        z = self.slope * self.largest(bag, known) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(emb, soft, bias, g, weight, owner, label):
    """Of the cross-entropy of some segments: its mean's by the softmax and its offset, and its sum's by the rows of the table that occur (their numbers and gradients).

    Segment ``owner`` has bucket ``g`` with ``weight``, an entry each.
    """
    n = len(label)
    vec = np.add.reduceat(emb[g] * weight[:, None], np.searchsorted(owner, np.arange(n)))
    p = vec @ soft + bias
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), label.astype(int)] -= 1
    back = p @ soft.T
    rows, inv = np.unique(g, return_inverse=True)
    each = np.stack([np.bincount(inv, back[owner, j] * weight, len(rows)) for j in range(emb.shape[1])], axis=1).astype(emb.dtype)
    return vec.T @ p / n, p.sum(axis=0) / n, rows, each


def train(texts: list[bytes], y: np.ndarray, epochs: int = 8, rate: float = 0.5, batch: int = 256, seed: int = 5) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0)
    rng = np.random.default_rng(seed)
    bag = Bag(*S.joined(texts))
    grams, at = bag.all_grams()
    sizes = np.diff(at)
    lo, hi, doc = bag.segments()
    label = y[doc] > 0
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    sq_emb, sq_soft = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
    yes, no = np.flatnonzero(label), np.flatnonzero(~label)
    per_epoch = 20000
    for epoch in range(epochs):
        pos = yes
        if epoch:  # of each toxic text, the quarter of its segments that look most toxic now, one at least
            z = _segment_scores(emb, soft, grams, at, bag, lo, hi)
            order = yes[np.lexsort((-z[yes], doc[yes]))]
            d = doc[order]
            lead = np.concatenate([[True], d[1:] != d[:-1]])
            n = np.bincount(d, minlength=bag.n)
            place = np.arange(len(d)) - np.flatnonzero(lead)[np.cumsum(lead) - 1]
            pos = order[place < np.maximum(1, n[d] // 4)]
            hard = rng.choice(no[np.argsort(-z[no])[: len(no) // 20 + 1]], per_epoch // 4)
            neg = np.concatenate([rng.choice(no, per_epoch // 4), hard])
        else:
            neg = rng.choice(no, per_epoch // 2)
        pick = np.concatenate([rng.choice(pos, per_epoch // 2), neg])
        rng.shuffle(pick)
        for i in range(0, len(pick), batch):
            s = pick[i : i + batch]
            n = hi[s] - lo[s]
            words = bag.word[np.repeat(lo[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            k = sizes[words]
            g = grams[np.repeat(at[words] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            weight = np.repeat(1.0 / (k * np.repeat(n, n)), k).astype(np.float32)
            owner = np.repeat(np.repeat(np.arange(len(s)), n), k)
            grad, tilt, rows, each = gradients(emb, soft, bias, g, weight, owner, label[s])
            sq_soft += grad**2
            soft -= rate * grad / np.sqrt(sq_soft)
            bias -= 0.1 * tilt
            sq_emb[rows] += each**2
            emb[rows] -= 0.1 * rate * each / np.sqrt(sq_emb[rows])
    table = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    model = Model(table, float(bias[1] - bias[0]), 1.0, 0.0)
    model.slope, model.shift = _logistic(model.largest(bag), y)
    return model


def _segment_scores(emb, soft, grams, at, bag, lo, hi) -> np.ndarray:
    per = emb @ (soft[:, 1] - soft[:, 0])
    return _means((np.add.reduceat(per[grams], at[:-1]) / np.diff(at))[bag.word], lo, hi)


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge logistic fit of y on z, with both classes weighted alike, by Newton's method."""
    scale = max(float(np.abs(z).max()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * w)
    return float(w[0] / scale), float(w[1])


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(*shared.value), Known()
        for rows, data, at in T.parts(batches, PORTION):
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(model.rate(Bag(data, at), known))], names=["doc_id", "row", "score"])

    return score


def lessons(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int, max_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Whole texts to learn from and their labels: of each class the texts with the smallest hashes of their ids, up to half of ``max_rows`` rows and of ``max_bytes`` bytes.

    Ids are picked by label alone, whatever the length of their texts; where the next text would pass the bound on bytes, its class ends (the first is taken in any case).
    """
    picked = cut(sample(docs, labels, label, learn, max_rows).select("doc_id", "y", T.whole()))
    sizes = picked.select("doc_id", "y", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).orderBy("h", "doc_id", "n").toPandas()  # max_rows rows of four numbers
    before = sizes.groupby("y")["n"].cumsum() - sizes["n"]
    taken = sizes[(before == 0) | (before + sizes["n"] <= max_bytes // 2)]
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in taken["doc_id"].unique()], "doc_id bigint")
    got = picked.join(F.broadcast(ids), "doc_id", "left_semi").toPandas().sort_values(["doc_id", "text"])
    return [t.encode() for t in got["text"]], got["y"].to_numpy(np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, max_rows: int = 8000, max_bytes: int = 24 << 20, **kw) -> Model:
    return train(*lessons(docs, labels, label, F.lit(True) if learn is None else learn, max_rows, max_bytes), **kw)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.offset, model.slope, model.shift))  # 256 kB whatever the input
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), T.whole()).mapInArrow(_scored(shared), "doc_id bigint, row bigint, score double")

"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents are partitioned by how many shingles they have, in classes whose upper bound u doubles. A class hashes shingles into u
bins and keeps the minimum of each bin, so however long a document is, a shingle of an item that it holds is its bin's minimum with
probability 0.63 or more. Every item is signed once for each class, with that class's bins. Documents that agree with an item in
some bin of any of ``ROUNDS`` independent hashes are its candidates: at 75 % containment an item of more than ``FEW`` shingles has 7 chances a round, so it is
missed with probability 0.37^(7 * ROUNDS) < 1e-9. Items of up to ``FEW`` shingles are looked up by the shingles themselves. Candidates are
verified by exact containment of the item's distinct shingles. An item of fewer words than a shingle has is one shingle, its whole sequence, as a document of so few
words is: it is found where it is the whole text, never within a longer one.

The items are broadcast where their texts are at most ``broadcast_bytes`` (a worker's tables take up to some 70 times that, with a table for each class that its documents
need, built once a worker); beyond that, signatures meet by a join on (class, round, bin, value).

Defined results: null or empty texts hold nothing and items without words match nothing; a text of any length is searched whole; rows that repeat an item_id count as items of their own;
rows that repeat a doc_id are looked at one by one, and each (doc_id, item_id) is returned once, with the largest containment (equal ones: with the most shingles found); null ids are
returned as null; without documents or items nothing is found. Other columns are not read, whatever their names; ``drop_contaminated`` passes them through.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm import texts as T
from tessera.session import cut

ROUNDS = 3
FEW = 8
PORTION = 1 << 17
_SEED = np.random.default_rng(11).integers(0, 2**64, ROUNDS, dtype=np.uint64)


def size_class(n: int) -> int:
    """The smallest c with n <= 2^c."""
    return max(0, math.ceil(math.log2(n))) if n > 1 else 0


def signature(value: np.ndarray, c: int, r: int) -> np.ndarray:
    """The minima of the 2^c bins (bins without shingles are left out), each as one number that holds its bin too; sorted."""
    h = np.sort(T.mix(value ^ _SEED[r]))
    if c == 0:
        return h[:1]
    b = h >> np.uint64(64 - c)
    return h[np.concatenate([[True], b[1:] != b[:-1]])]


class Items:
    """All items: their shingles, and for each class and round the sorted minima with the items that have them."""

    def __init__(self, ids: list, texts: list[bytes], size: int):
        self.ids, self.size = ids, size
        self.value, self.at = S.shingles(texts, size) if texts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self._tables: dict = {}

    def set(self, i: int) -> np.ndarray:
        return self.value[self.at[i] : self.at[i + 1]]

    def table(self, c: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        if (c, r) not in self._tables:
            parts = [signature(self.set(i), c, r) for i in range(len(self.ids)) if self.at[i + 1] - self.at[i] > FEW]
            who = [np.full(len(p), i) for p, i in zip(parts, [i for i in range(len(self.ids)) if self.at[i + 1] - self.at[i] > FEW], strict=True)]
            self._tables[c, r] = _sorted(parts, who)
        return self._tables[c, r]

    def few(self) -> tuple[np.ndarray, np.ndarray]:
        if "few" not in self._tables:
            short = [i for i in range(len(self.ids)) if 0 < self.at[i + 1] - self.at[i] <= FEW]
            self._tables["few"] = _sorted([self.set(i) for i in short], [np.full(self.at[i + 1] - self.at[i], i) for i in short])
        return self._tables["few"]


def _sorted(parts: list, who: list) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v, w = np.concatenate(parts), np.concatenate(who)
    order = np.argsort(v, kind="stable")
    return v[order], w[order]


def _lookup(table: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Items that have one of ``values``."""
    v, who = table
    i, j = np.searchsorted(v, values, "left"), np.searchsorted(v, values, "right")
    return np.unique(np.concatenate([who[a:b] for a, b in zip(i[j > i], j[j > i], strict=True)])) if (j > i).any() else np.zeros(0, np.int64)


def candidates(items: Items, value: np.ndarray) -> np.ndarray:
    """Items that a document with the distinct shingles ``value`` may hold."""
    c = size_class(len(value))
    found = [_lookup(items.few(), value)]
    for r in range(ROUNDS):
        found.append(_lookup(items.table(c, r), signature(value, c, r)))
    return np.unique(np.concatenate(found))


_loaded: dict = {}


def _items(shared, size: int) -> Items:
    """The items of a broadcast, with the tables that searches have needed so far: built once a worker."""
    key = (shared.value[0], size)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Items(*shared.value[1:], size)
    return _loaded[key]


def _held(items: Items, own: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
    """(item, shingles found, shingles of the item) of the items that a document with the distinct shingles ``own`` holds."""
    for i in candidates(items, own) if len(own) else ():
        s = items.set(i)
        n = int(np.isin(s, own, assume_unique=True).sum())
        if 100 * n >= percent * len(s):
            yield i, n, len(s)


def _search(shared, size: int, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared, size)
        for rows, data, texts_at in T.parts(batches, PORTION):
            value, at = S.of(data, texts_at, size)
            out = [(doc, items.ids[i], n, m) for k, doc in enumerate(rows.column(0).to_pylist()) for i, n, m in _held(items, value[at[k] : at[k + 1]], percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "n_found", "n_item"])

    return search


def _clean(shared, size: int, percent: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared, size)
        for rows, data, texts_at in T.parts(batches, PORTION):
            value, at = S.of(data, texts_at, size)
            yield rows.filter(pa.array([next(_held(items, value[at[k] : at[k + 1]], percent), None) is None for k in range(rows.num_rows)], pa.bool_()))

    return clean


PAIR = "doc_id bigint, item_id bigint, n_found bigint, n_item bigint"


def _postings(size: int, document: bool):
    """(class, round, value, row): a document's in its own class, an item's in every class; class -1 has whole sets, for items of few shingles."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, texts_at in T.parts(batches, PORTION):
            value, at = S.of(data, texts_at, size)
            cs, rs, vs, ks = [], [], [], []
            for k, row in enumerate(rows.column(0).to_pylist()):
                own = value[at[k] : at[k + 1]]
                if not len(own):
                    continue
                if document or len(own) <= FEW:
                    _add(cs, rs, vs, ks, -1, 0, own, row)
                if document or len(own) > FEW:
                    for c in [size_class(len(own))] if document else range(48):
                        for r in range(ROUNDS):
                            _add(cs, rs, vs, ks, c, r, signature(own, c, r), row)
            if cs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (cs, rs)] + [pa.array(np.concatenate(vs).view(np.int64)), pa.array(np.concatenate(ks), pa.int64())], names=["c", "r", "v", "row"]
                )

    return post


def _add(cs, rs, vs, ks, c, r, v, row):
    cs.append(np.full(len(v), c, np.int32))
    rs.append(np.full(len(v), r, np.int32))
    vs.append(v)
    ks.append(np.full(len(v), row, np.int64))


def _contained(size: int, percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, item, texts, tests = (c.to_pylist() for c in b.columns)
            value, at = S.shingles([x.encode() for pair in zip(texts, tests, strict=True) for x in pair], size)
            out = []
            for k in range(len(doc)):
                own, s = value[at[2 * k] : at[2 * k + 1]], value[at[2 * k + 1] : at[2 * k + 2]]
                n = int(np.isin(s, own, assume_unique=True).sum())
                if len(s) and 100 * n >= percent * len(s):
                    out.append((doc[k], item[k], n, len(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "n_found", "n_item"])

    return check


def _broadcast(tests: DataFrame, broadcast_bytes: int):
    """The items for every worker, or None where they are too large for that."""
    total = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if total > broadcast_bytes:
        return None
    got = tests.collect()  # bounded: the items alone, however many documents there are
    return tests.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r.item_id for r in got], [r.text.encode() for r in got]))


def find(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, n_found, n_item, containment: documents that hold at least ``percent`` of an item's distinct ``size``-word shingles."""
    tests = items.select("item_id", T.whole())
    rows = docs.select("doc_id", T.whole())
    shared = _broadcast(tests, broadcast_bytes)
    if shared is not None:
        pairs = rows.mapInArrow(_search(shared, size, percent), PAIR)
    else:
        keyed = cut(tests.withColumn("row", F.monotonically_increasing_id()))
        doc = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        post = "c int, r int, v bigint, row bigint"
        a = doc.select("row", "text").mapInArrow(_postings(size, True), post)
        b = keyed.select("row", "text").mapInArrow(_postings(size, False), post)
        met = a.join(b.withColumnRenamed("row", "item"), ["c", "r", "v"]).select("row", "item").distinct()
        full = met.join(doc, "row").join(keyed.toDF("item_id", "test", "item"), "item")
        pairs = full.select("doc_id", "item_id", "text", "test").mapInArrow(_contained(size, percent), PAIR)
    most = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_item")).alias("containment"), "n_found", "n_item")).alias("m"))
    return most.select("doc_id", "item_id", "m.n_found", "m.n_item", "m.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. Each row is judged by itself, whatever its id."""
    shared = _broadcast(items.select("item_id", T.whole()), broadcast_bytes)
    if shared is not None:
        return docs.mapInArrow(_clean(shared, size, percent), docs.schema)
    numbered = cut(docs.withColumn("_dc_row", F.monotonically_increasing_id()))
    found = find(numbered.select(F.col("_dc_row").alias("doc_id"), "text"), items, size, percent, broadcast_bytes).select(F.col("doc_id").alias("_dc_row")).distinct()
    return numbered.join(found, "_dc_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

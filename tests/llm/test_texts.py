"""Byte arrays of texts, hashes, shingles, blocks' numbers and groups against plain Python."""

import re

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import shingles as S
from tessera.llm import texts as T

some_texts = st.lists(st.text(alphabet="ab \t\nXé|", max_size=30), max_size=6)


@settings(max_examples=80, deadline=None)
@given(some_texts)
def test_words(texts):
    data, at = S.joined([t.encode() for t in texts])
    assert T.n_words(data, at).tolist() == [len(brute.WORD.findall(t)) for t in texts]
    begin, end = T.edges(T.solid(data), at)
    words = [w.encode() for t in texts for w in brute.WORD.findall(t)]
    assert [data[b:e].tobytes() for b, e in zip(begin, end)] == words
    h = T.hashes(data, begin, end).tolist()
    assert len(set(h)) == len(set(words)) and len(set(zip(words, h))) == len(set(words))
    assert T.lower(data).tobytes() == "".join(brute.lower(t) for t in texts).encode()


def test_long_ranges():
    data = np.frombuffer(b"x" * 700 + b"y" + b"x" * 700, np.uint8)
    ranges = [(0, 300), (1, 301), (0, 301), (500, 800), (701, 1001), (0, 700), (701, 1401)]
    begin, end = (np.array(x) for x in zip(*ranges))
    h = T.hashes(data, begin, end).tolist()
    assert h[0] == h[1] == h[4] and h[5] == h[6] and len(set(h)) == 4
    assert T.hashes(data, begin, end, 1).tolist() != h


@settings(max_examples=60, deadline=None)
@given(some_texts, st.integers(1, 4))
def test_shingles(texts, size):
    value, at = S.shingles([t.encode() for t in texts], size)
    sets = [brute.shingle_set(t, size) for t in texts]
    got = [value[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
    assert [len(x) for x in got] == [len(x) for x in sets] and all(x == sorted(set(x)) for x in got)
    for a, x in zip(sets, got):
        for b, y in zip(sets, got):
            assert len(a & b) == len(set(x) & set(y))


def test_parts_of_batches():
    texts = ["a b", "", None, "c" * 50, "d", "é e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "text"]).slice(1)
    seen = [(r.column(0).to_pylist(), [data[i:j].tobytes().decode() for i, j in zip(at[:-1], at[1:])]) for r, data, at in T.parts(iter([batch]), 8)]
    assert [k for ks, _ in seen for k in ks] == [1, 2, 3, 4, 5]
    assert [t for _, ts in seen for t in ts] == ["", "", "c" * 50, "d", "é e"] and len(seen) > 1
    assert list(T.parts(iter([batch.slice(0, 0)]), 8)) == []


def test_numbers_fall_into_one_bucket(spark):
    ids = [x for task in (0, 3, 11) for x, _ in zip(B.numbers(task, 7), range(40))]
    got = spark.createDataFrame([(x,) for x in ids], "x bigint").select("x", F.pmod(F.hash("x"), F.lit(7)).alias("b")).collect()
    assert len(set(ids)) == 120 and ids == sorted(ids)
    assert [r.b for r in got] == [0] * 40 + [3] * 40 + [4] * 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2)), min_size=1, max_size=40))
def test_groups(pairs):
    """Entries are grouped by all keys, also where the first differs in its low bits alone."""
    a, b = (np.array(x, np.uint64) for x in zip(*pairs))
    order, new = B.grouped(a, b)
    groups = np.split(order, np.flatnonzero(new)[1:])
    assert sorted(sorted(g.tolist()) for g in groups) == sorted([i for i, p in enumerate(pairs) if p == q] for q in set(pairs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 9))
def test_covered(marks, length):
    got = B.covered(np.array(marks, bool), length).tolist()
    assert got == [any(marks[max(0, i - length + 1) : i + 1]) for i in range(len(marks))]


def test_codes_are_packed():
    codes = np.array([0, 3, 1, 2, 2, 0, 1, 3, 3], np.uint8)
    assert B.unpacked(B.packed(codes, 2), 9, 2).tolist() == codes.tolist()
    assert re.fullmatch("[01]+", "".join(map(str, B.unpacked(B.packed(codes & 1, 1), 9, 1))))

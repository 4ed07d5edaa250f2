"""Line, substring, suffix and near-duplicate operators against plain models."""

import brute
import pytest
from helpers import SCHEMA, collected, corpus
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import line_dedup, near_dedup, substring_dedup, suffix_dedup


def test_substring(docs, rows, clashing, empty):
    want = brute.nulls_first(brute.substring(rows, 20))
    assert collected(substring_dedup.remove_repeats(docs)) == want
    assert collected(substring_dedup.remove_repeats(clashing, block_bytes=2000)) == want
    assert collected(substring_dedup.remove_repeats(empty)) == []
    assert collected(substring_dedup.remove_repeats(docs, window=8, base=2)) == brute.nulls_first(brute.substring(rows, 8))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, window=20, base=3)


def test_substring_stops_early(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h"), (2, "i j k l m n o p")], "doc_id bigint, text string")
    assert collected(substring_dedup.remove_repeats(d, window=4, base=2)) == [(1, 8, 0, "a b c d e f g h"), (2, 8, 0, "i j k l m n o p")]


def test_suffix(docs, rows, clashing, empty):
    want = brute.nulls_first(brute.suffix(rows, 50))
    assert collected(suffix_dedup.remove_shared(docs)) == want
    # every anchor that two blocks share is hot, so its strings travel alone
    assert collected(suffix_dedup.remove_shared(clashing, hot=2, block_bytes=2000)) == want
    assert collected(suffix_dedup.remove_shared(empty)) == []
    assert collected(suffix_dedup.remove_shared(docs, length=64)) == brute.nulls_first(brute.suffix(rows, 64))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(2, 9))
def test_interval_expansion(letters, length):
    """Groups of equal strings are those of plain sorting."""
    import numpy as np

    text = np.array([*letters, 0], np.uint16)
    rows, begins = suffix_dedup.long_groups(text, length)
    group = dict(zip(rows.tolist(), np.cumsum(begins).tolist()))
    n = len(letters) - length + 1
    for i in range(n):
        for j in range(i):
            assert (group[i] == group[j]) == (letters[i : i + length] == letters[j : j + length])


def test_near(docs, rows, clashing, empty, monkeypatch):
    want = brute.nulls_first(brute.near(rows))
    assert collected(near_dedup.link(docs).drop("row", "row_b")) == want
    monkeypatch.setattr(near_dedup, "SMALL", 2)  # nearly every list goes through the components of its centre
    monkeypatch.setattr(near_dedup, "CELL", 4)
    assert collected(near_dedup.link(clashing).drop("row", "row_b")) == want
    assert collected(near_dedup.link(empty)) == []


def test_one_a_component(spark, docs, rows):
    """Equal rows, near copies under one doc_id and groups without ids leave one row each; texts without words stay."""
    w = ["t%d" % i for i in range(60)]
    near = lambda p, k=0: " ".join(p + x for x in w[:-1]) + " end%d" % k
    groups = [[(1, near("a"))] * 3 + [(4, near("a", 1))], [(2, near("b", k)) for k in range(3)], [(None, near("c", k)) for k in (0, 0, 1)], [(None, near("d")), (9, near("d", 1))], [(None, near("e"))]]
    made = [r for g in groups for r in g] + [(7, ""), (7, ""), (None, None)]
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    got = [tuple(r) for r in near_dedup.one_a_component(d).collect()]
    assert [sum(r in g for r in got) for g in groups] == [1] * 5 and (1, near("a")) in got and (9, near("d", 1)) in got
    assert sorted(str(r) for r in got if not r[1]) == sorted(map(str, made[-3:])) and len(got) == 8
    want = {r[0] for r in brute.near(rows) if r[3]}
    out = near_dedup.one_a_component(docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and set(ids) == want and len(ids) == len(want)
    assert near_dedup.one_a_component(docs.limit(0)).count() == 0


def test_near_chain(spark):
    """Links chain, and a large group of near copies stays whole."""
    import random

    rng = random.Random(3)
    base = ["t%d" % i for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 80):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(100)] = "n%d_%d" % (i, rng.randrange(9))
        rows.append((i, " ".join(w)))
    step = list(base)
    for i in range(100, 112):  # each text is near the one before alone
        step = step[4:] + ["s%d_%d" % (i, k) for k in range(4)]
        rows.append((i, " ".join(step)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collected(near_dedup.link(d).drop("row", "row_b")) == brute.nulls_first(brute.near(rows))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a bigint, b bigint")
    assert collected(near_dedup.components(e)) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100), (102, 100)]


def test_lines(docs, rows, clashing, empty):
    want = brute.nulls_first(brute.line_dedup(rows, 5))
    cols = ["doc_id", "n_lines", "n_dropped", "text"]
    assert collected(line_dedup.dedup_lines(docs, min_docs=5).select(*cols)) == want
    assert collected(line_dedup.dedup_lines(clashing, min_docs=5, batches=7, fanout=2).select(*cols)) == want
    out = line_dedup.dedup_lines(empty)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "text", "n_lines", "n_dropped"]
    assert collected(out) == []


def test_line_runs(spark):
    """Runs are compacted, settled keys are not counted on, and sums are those of all batches."""
    runs = line_dedup.LineRuns(spark, limit=5, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 3), (10 + k, 0, 1), (3, 3, 1)], "a bigint, b bigint, n bigint"))
    n = {r.a: r.n for r in runs.counts().collect()}
    assert n[1] == 6 and n[3] == 5 and n[13] == 1
    assert sum(map(len, runs.levels)) <= 3
    assert {r.a for r in runs.settled().collect()} == {1, 3}
    # another session goes on with the same store
    again = line_dedup.LineRuns(spark, limit=5, fanout=2, folder=runs.folder)
    assert [len(x) for x in again.levels] == [len(x) for x in runs.levels]
    again.add(spark.createDataFrame([(13, 0, 4)], "a bigint, b bigint, n bigint"))
    assert {r.a for r in again.settled().collect()} == {1, 3, 13}
    # a batch is dealt and sorted once, the runs are read as they lie
    more = again.fresh(spark.createDataFrame([(1, 1, 1), (77, 0, 2)], "a bigint, b bigint, n bigint"))
    plan = more._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1 and plan.count("SortMergeJoin") == sum(map(len, again.levels)) >= 1, plan
    assert [tuple(r) for r in more.collect()] == [(77, 0, 2)]


def test_other_corpus(spark):
    rows = corpus(seed=9, n=40)
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert collected(suffix_dedup.remove_shared(d, block_bytes=1500)) == brute.nulls_first(brute.suffix(rows, 50))
    assert collected(near_dedup.link(d).drop("row", "row_b")) == brute.nulls_first(brute.near(rows))


def test_repeated_and_missing_ids(spark):
    """Rows that share an id are one document, null is an id of its own: the same meaning for bytes, words and lines."""
    w = ["u%d" % i for i in range(60)]
    a, b = " ".join(w), " ".join(w[:40])
    rows = [(1, a), (1, a), (None, b), (None, b + "\nline"), (7, a + "\nline"), (7, "line"), (7, "line"), (8, "line"), (-3, None), (9, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for got in (suffix_dedup.remove_shared(d), suffix_dedup.remove_shared(d, hot=2, block_bytes=100)):
        assert collected(got) == brute.nulls_first(brute.suffix(rows, 50))
    for got in (substring_dedup.remove_repeats(d), substring_dedup.remove_repeats(d, block_bytes=100)):
        assert sorted((r[0] or -99, r[1]) for r in collected(got)) == sorted((i or -99, len((t or "").split())) for i, t in rows)
        kept = [r for r in collected(got) if r[0] == 1]
        assert [r[2] for r in kept] == [60, 40] or [r[2] for r in kept] == [40, 60]  # of equal rows one keeps what no smaller document has
    cols = ["doc_id", "n_lines", "n_dropped", "text"]
    assert collected(line_dedup.dedup_lines(d, min_docs=3).select(*cols)) == brute.nulls_first(brute.line_dedup(rows, 3))


def test_very_long_texts(spark):
    """One text of some megabytes: several chunks, one block."""
    import random

    rng = random.Random(4)
    vocab = ["v%d" % i for i in range(5000)]
    long = " ".join(rng.choices(vocab, k=300_000))
    part = long[1_000_000:1_000_400]
    rows = [(1, "x" * 60 + part), (2, long), (3, "y" * 700 + " z")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_shared(d).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 400, 1, 0)
    assert bytes(got[2].kept).decode() == long[:1_000_000] + long[1_000_400:]
    words = {r.doc_id: r for r in substring_dedup.remove_repeats(d).collect()}
    assert words[2].n_words == 300_000 and 60 <= words[2].n_removed <= 85
    assert near_dedup.link(d).count() == 3 and line_dedup.dedup_lines(d).count() == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=10, max_size=40), min_size=1, max_size=6), st.sampled_from([4, 5, 6, 10]))
def test_smallest_holders(segments, length):
    """Through letters of several bytes, each string's smallest holder is the plain one."""
    import numpy as np

    body = np.frombuffer("".join(segments).encode(), np.uint8)
    size = np.array([len(x) for x in segments])
    rank = np.arange(len(segments))[::-1].astype(np.uint64)
    got = suffix_dedup.smallest_holders(body, np.cumsum(size) - size, size, rank, length).tolist()
    strings = [(x[i : i + length], int(r)) for x, r in zip(segments, rank) for i in range(len(x) - length + 1)]
    assert got == [min(r for t, r in strings if t == s) for s, _ in strings]

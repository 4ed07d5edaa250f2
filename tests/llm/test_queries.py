"""Registered queries against SQL or plain models on the smallest tables, and the pipeline stage by stage."""

import os

import brute
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_names():
    from tessera.llm import queries

    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLE) <= set(names)


@pytest.mark.parametrize("op", [2, 3, 6, 7, 9, 10])
def test_against_sql(spark, con, op):
    from tessera.llm import queries

    name = next(n for n in queries.QUERIES if n.startswith(f"op{op}_"))
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_scores(spark):
    from tessera.llm import queries

    for op, held in ((queries.op1_quality_classifier, lambda c: c % 3 == 1), (queries.op4_toxicity, lambda c: c % 5 == 0)):
        import zlib

        for r in op(spark, SF).collect():
            assert r.held_out == held(zlib.crc32(str(r.doc_id).encode())) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_pipeline(spark):
    import corpus_pipeline as P
    from tessera.session import table

    docs = table(spark, SF, "documents")
    kept = {}
    for k, (_, f) in enumerate(P.STAGES):
        before = docs
        docs = f(spark, docs, SF).cache()
        if k + 1 < len(P.STAGES):
            assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
        kept[k] = [(r.doc_id, r.text) for r in docs.collect()] if k < 4 else docs.toPandas()
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    ids = {i for i, _ in kept[0]}
    labelled = [i for i in quality]
    assert sum((i in ids) == bool(quality[i]) for i in labelled) >= 0.95 * len(labelled)
    assert sorted(kept[1]) == sorted((i, t) for i, _, _, t in brute.line_dedup(kept[0], 10))
    assert {i for i, _ in kept[2]} == {r[0] for r in brute.near(kept[1]) if r[3]}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert {i for i, _ in kept[3]} == {i for i, _ in kept[2]} - {r[0] for r in brute.contained(kept[2], items)}
    n = {i: len(brute.WORD.findall(t)) for i, t in kept[3]}
    assert kept[4].groupby("doc_id")["length"].sum().to_dict() == {i: k for i, k in n.items() if k}


def test_pipeline_takes_awkward_rows(spark, clashing):
    """Nulls, repeated rows, columns with clashing names, and no rows at all."""
    import corpus_pipeline as P
    from tessera.session import cut

    for docs in (clashing, clashing.limit(0)):
        for k, (_, f) in enumerate(P.STAGES):
            before, docs = docs, cut(f(spark, docs, SF))
            if k + 1 < len(P.STAGES):
                assert docs.columns == before.columns and docs.count() <= before.count()
        assert (docs.count() > 0) == (before.count() > 0)

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import plugins as P
from tessera.functions import vectors as V
from tessera.operators import aggregate as A
from tessera.operators import index as I
from tessera.operators import search as S
from tessera.operators.rank import global_rank
from tessera.operators.service import KEPT_QUERIES, Corpus

DOCS = [(1, "apple pear apple"), (2, "pear"), (3, ""), (4, "apple plum plum fig")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def test_bm25(docs):
    got = {r.doc_id: r.bm25 for r in S.bm25(I.postings(docs), I.doc_stats(docs), ["apple", "pear", "apple", "zzz"]).collect()}
    scan = {r.doc_id: r.bm25 for r in S.bm25_scan(docs, ["apple", "pear", "apple", "zzz"]).collect()}
    assert scan == got and S.bm25_scan(docs, []).count() == 0
    assert got == {1: pytest.approx(1.418939, abs=1e-6), 2: pytest.approx(0.894383, abs=1e-6), 4: pytest.approx(0.478033, abs=1e-6)}


def test_fusion(spark, docs):
    vec = spark.createDataFrame([(1, [0.2, 0.0]), (2, [0.9, 0.0]), (3, [0.8, 0.0]), (4, [0.1, 0.0])], "doc_id bigint, embedding array<float>")
    q = spark.createDataFrame([([2.0, 0.0],)], "embedding array<float>")
    scores = S.bm25(I.postings(docs), I.doc_stats(docs), ["apple", "pear"])
    got = [(r.doc_id, r.vrank, r.brank, round(r.rrf, 6)) for r in S.hybrid_search(vec, q, scores).orderBy(F.desc("rrf")).collect()]
    assert got == [(2, 1, 2, 0.032522), (1, 3, 1, 0.032266), (3, 2, 4, 0.031754), (4, 4, 3, 0.031498)]
    assert [r.doc_id for r in S.keyword_search(scores, 10).collect()] == [1, 2, 4]


def test_global_rank_is_row_number(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0.0, 0.0, 0.5, -0.25, rng.random()])) for i in range(500)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k bigint, s double")
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.k: r.rank for r in global_rank(d, "s", "k", "rank").collect()} == want
    for buckets in (2, 16):
        assert {r.k: r.rank for r in global_rank(d, "s", "k", "rank", buckets, one_task=0).collect()} == want


def test_context(spark):
    many = spark.createDataFrame([(i, "x" * 1000) for i in range(21)], "rank int, text string")
    got = S.context(many, "rank").collect()
    assert len(got) == 20 and {r.used for r in got} == {900}
    few = spark.createDataFrame([(i, "x" * 400) for i in range(3)], "rank int, text string")
    assert [r.used for r in S.context(few, "rank").collect()] == [400] * 3
    assert sum(r.used for r in S.context(few, "rank", total=1000).collect()) == 1000


def test_centroid(spark):
    d = spark.createDataFrame([(1.0, 0.0, 1.0), (3.0, 2.0, 0.5), (9.0, 9.0, -4.0)], "x double, y double, sim double")
    r = S.centroid(d).first()
    assert (r.x, r.y) == (pytest.approx(2.5 / 1.5), pytest.approx(1 / 1.5))
    assert tuple(S.centroid(d.limit(0)).first()) == (0.5, 0.5)


def test_digest_and_stale(spark):
    import hashlib

    d = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "g string, o int, h string")
    got = {r.g: r.digest for r in I.digest(d, "g", "o", F.col("h")).collect()}
    assert got["a"] == hashlib.sha256(b"xy").hexdigest()
    now = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m")], "k string, digest string, model string")
    assert [r.k for r in I.stale(now, now.where("k = 'a'"), ["k", "digest", "model"]).collect()] == ["b"]


def test_box(spark):
    d = spark.createDataFrame([(float(x), 0.0) for x in (0, 1, 2, 3, 1000)], "x double, y double")
    got = I.robust_box(d, "x", "y").collect()
    assert all(0 <= r.x <= 1 and r.y == 0.5 for r in got) and max(r.x for r in got) <= 1
    same = I.robust_box(d.select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), "x", "y").first()
    assert tuple(same) == (0.5, 0.5)


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    r = d.select(V.dot("a", "b").alias("d"), V.l2("a").alias("n"), V.unit("a").alias("u"), V.cosine("a", "b").alias("c"), V.preview("a", 1).alias("p")).first()
    assert (r.d, r.n, r.c, r.p) == (24.0, 5.0, pytest.approx(0.96), [3.0]) and r.u == [0.6, 0.8]


def test_map_reduce(spark):
    rows = spark.createDataFrame([("a", 1, "good growth\nbad"), ("a", 2, "growth growth"), ("b", 1, "nothing"), ("c", 1, None), ("d", 1, "boom")], "g string, rank int, text string")

    def extract(passages):
        if passages[0] == "boom":
            raise ValueError("no")
        return A.extractive(["growth", "good"])(passages)

    got = {r.g: r for r in A.map_groups(rows, "g", extract).collect()}
    assert {g: r.state for g, r in got.items()} == {"a": "relevant", "b": "irrelevant", "c": "empty", "d": "error"}
    assert got["a"].answer == "good growth" and got["a"].citations == [1]
    m = A.map_groups(rows, "g", extract)
    assert tuple(A.reduce_groups(m, "g").first()) == (1, 1, 1, 1, "[1] a: good growth")
    assert A.reduce_groups(m.where("g = 'b'"), "g").first().conclusions == "nothing relevant"
    assert [(r.g, r.number) for r in A.numbered(m, "g").collect()] == [("a", 1)]


def test_service(spark):
    texts = ["revenue grew strongly this year", "cash flow fell", "board met twice", "revenue fell in the north"]
    base = spark.createDataFrame([(i, t, "co%d" % (i % 2), 2024, "ch", i, "c#%d" % i) for i, t in enumerate(texts)], "doc_id bigint, text string, company string, report_year int, chapter string, page int, chunk_id string")
    c = Corpus(P.encoded(base, "text", P.hashing_encoder).cache(), P.hashing_encoder())
    n, rows = c.retrieve("revenue grew", 3)
    top = rows.orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2, 3] and top[0].doc_id == 0 and math.isclose(top[0].rrf, 2 / 61)
    events = list(c.answer(n))
    assert [e["type"] for e in events if e["type"] != "token"] == ["start", "citations", "done"] and events[-2]["ids"][0] == 0
    assert "revenue" in " ".join(e["text"] for e in events if e["type"] == "token")
    assert c.context(n).first().context.startswith("[1] co0 2024 ch P0\nrevenue grew")
    assert len(c.query_vector(n).first().preview) == 8
    mapped, reduced = c.aggregate("revenue")
    assert {r.company: r.state for r in mapped.collect()} == {"co0": "relevant", "co1": "relevant"} and reduced.first().n_relevant == 2
    assert [r.company for r in c.aggregate("revenue", only=["co1"])[0].collect()] == ["co1"]
    assert c.chunk(2, "c#2").first().state == "ok" and c.chunk(2, "old").first().state == "stale" and c.chunk(99).count() == 0
    assert c.meta().first().companys == ["co0", "co1"] and [r.doc_id for r in c.keyword("zzz").collect()] == []
    for k in range(KEPT_QUERIES + 3):
        c.queries[1000 + k] = {}
    c.retrieve("cash", 1)
    assert len(c.queries) == KEPT_QUERIES
    assert P.question("x").endswith("\nQuery: x") and len(P.circle(2)) == 2


def test_drift_and_layout(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(9)], "k bigint, embedding array<float>")
    r = I.drift(v, v, "k").first()
    assert r.ok and r.min_cosine == pytest.approx(1)
    assert I.pca_layout(v, "k").count() == 9
    a = I.alignment(v.withColumn("g", F.lit("x")), v.where("k > 0"), "g", "k").first()
    assert (a.n_chunks, a.n_vectors, a.aligned) == (9, 8, False)
    assert I.homogeneous(v.withColumn("d", F.size("embedding")), ["d"]).first().ok


def test_keywords_need_no_vector(spark, tmp_path):
    from tessera.plans import catalogue as K

    texts = ["a clown here", "idiot and clown and clown", "nothing of it", "one scum alone"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = {n: sorted(r.doc_id for r in K.QUERIES[n](spark, str(tmp_path)).collect()) for n in ("q33_bm25", "q33_bm25_indexed", "q34_keyword")}
    assert ids == {"q33_bm25": [0, 1], "q33_bm25_indexed": [0, 1], "q34_keyword": [0, 1, 3]}
    df = {r.term: r.df for r in K.QUERIES["q33_term_stats"](spark, str(tmp_path)).collect()}
    assert df["clown"] == 2 and df["scum"] == 1 and len(df) == len({w for t in texts for w in t.split() if len(w) > 1})

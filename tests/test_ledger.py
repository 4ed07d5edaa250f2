from pyspark.sql import functions as F

from tessera.operators import ledger as L
from tessera.operators import quality as Q
from tessera.operators.select import chosen, with_artifact


def test_companies(spark):
    raw = [(0, "# note", "x", "", "", "", "", ""), (1, "600519.SH", " A ", "", "", "否", "", "边界 case"), (2, "'703'", "B", "sz", "o9", "", "核心", ""), (3, "600519", "again", "", "", "", "", ""), (4, "bad", "", "", "", "", "", "")]
    df = spark.createDataFrame(raw, "ord int, code string, name string, market string, org_id string, enabled string, quota string, note string")
    got = [tuple(r) for r in L.companies(df).orderBy("code").collect()]
    assert got == [("000703", "B", "SZ", "o9", True, "", "核心"), ("600519", "A", "SH", "", False, "边界 case", "边界")]
    seeds = L.seed_list(spark.createDataFrame([("920077", "C", "北交所", ""), ("600063", "D", "核心", "")], "code string, name string, quota string, note string"))
    assert [(r.code, r.market, r.enabled) for r in L.companies(df.where("code = 'bad'"), seeds).orderBy("code").collect()] == [("600063", "SH", True), ("920077", "BJ", False)]


def test_latest(spark):
    rows = [("c", "2024年年度报告", 5, 10, "a", 0), ("c", "关于2024年年度报告", 5, 99, "b", 1), ("c", "2024年年度报告", 5, 20, "x", 2), ("c", "2024年年度报告", 5, 20, "y", 3), ("c", "2024年年度报告摘要", 9, 20, "z", 4), ("c", "2023年年度报告", 1, 1, "o", 5)]
    a = spark.createDataFrame(rows, "code string, title string, ts_ms long, size_kb int, ann_id string, ord int")
    got = {r.year: (r.ann_id, r.n_alternatives, r.alternatives) for r in L.pick_reports(a).collect()}
    assert got == {2024: ("x", 3, ["y", "a", "b"]), 2023: ("o", 0, None)}


def test_upsert(spark):
    f = lambda d: spark.createDataFrame(list(d.items()), "k string, v int")
    got = {r.k: r.v for r in L.upsert(f({"a": 1, "b": 2, "c": 3}), f({"b": 9, "d": 4}), ["k"], f({"c": 0})).collect()}
    assert got == {"a": 1, "b": 9, "d": 4}
    assert {r.k: r.v for r in L.upsert(f({"a": 1}), f({"a": 5}), ["k"], f({"a": 0})).collect()} == {"a": 5}


def test_paths_and_files(spark):
    led = spark.createDataFrame([("p1", "x/a.pdf"), ("p2", "gone"), ("p3", "gone")], "pdf_id string, stated string")
    files = spark.createDataFrame([("x/a.pdf",), ("p2.pdf",)], "path string")
    assert {r.pdf_id: r.path for r in L.resolve_paths(led, files).collect()} == {"p1": "x/a.pdf", "p2": "p2.pdf", "p3": None}


def test_streaks(spark):
    e = spark.createDataFrame([(1, t, c == "x") for t, c in enumerate("xxoxxxoxxxxx")], "u int, t int, bad boolean")
    got = sorted((r.f.t, r.l.t, r.length) for r in L.streaks(e, ["u"], ["t"], F.col("bad"), 3).collect())
    assert got == [(3, 5, 3), (7, 11, 5)]


def test_quantiles(spark):
    d = spark.range(1, 11).withColumnRenamed("id", "v")
    assert tuple(Q.index_quantiles(d, "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()) == (2, 6, 10)


def test_selection(spark):
    d = spark.createDataFrame([(i, "k%d" % i) for i in range(6)], "n int, k string")
    assert [r.n for r in chosen(d, "k", "n", resume_from="k2", most=2).orderBy("n").collect()] == [2, 3]
    assert [r.n for r in chosen(d, "k", "n", only=["k1", "k9"]).collect()] == [1]
    assert with_artifact(d, d.where("n > 3"), "k").count() == 2

import json
import struct

import pytest
from pyspark.sql import functions as F

from tessera.config import from_environment
from tessera.sources import announcements as AN
from tessera.sources import files as FI
from tessera.streaming import incremental as N


def test_csv(spark, tmp_path):
    p = tmp_path / "list.csv"
    p.write_text('﻿代码,简称,口径\n# x,,\n600519,"A, B",\n703,,核心\n', encoding="utf-8")
    got = FI.read_companies(spark, str(p)).orderBy("ord").collect()
    assert [(r.code, r.name, r.quota, r.note) for r in got] == [("# x", "", "", ""), ("600519", "A, B", "", ""), ("703", "", "核心", "")]
    out = str(tmp_path / "out")
    FI.write_csv(spark.createDataFrame([("1", "x", "y")], "`序号` string, `状态` string, extra string"), out, ["序号", "状态"])
    assert FI.read_csv(spark, out, ["序号", "状态", "备注"]).first().asDict() == {"序号": "1", "状态": "x", "备注": ""}
    FI.write_template(spark.range(1), str(tmp_path / "t"))
    with pytest.raises(Exception, match="exist"):
        FI.write_template(spark.range(1), str(tmp_path / "t"))
    FI.write_template(spark.range(1), str(tmp_path / "t"), force=True)


def test_manifest(spark):
    rows = [("2", "600519", "A", "SH", "2024", "t", "d", "9", "f.pdf", "1", "成功", ""), ("1", "600519", "A", "SH", "2024", "t", "d", "8", "g.pdf", "1", "已存在", ""), ("3", "1", "B", "SZ", "2024", "t", "d", "7", "", "", "失败", "")]
    got = FI.ledger_manifest(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in FI.LEDGER))).collect()
    assert [(r.pdf_id, r.stated, r.report_year, r.anno_id) for r in got] == [("600519_2024", "g.pdf", 2024, "8")]


def test_json_and_org_ids(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert FI.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").count() == 2
    cache = tmp_path / "m.json"
    cache.write_text(json.dumps({"fetched_at": 1000.0, "map": {"a": "1"}}))
    read = lambda now, fetch=None: FI.read_org_ids(spark, str(cache), now, fetch=fetch)

    def fails():
        raise OSError

    assert read(1001.0)[0].first()["map"] == {"a": "1"} and read(1001.0)[1]
    assert read(1e9, lambda: {"b": "2"})[0].first()["map"] == {"b": "2"}
    got, fresh = read(1e9, fails)
    assert got.first()["map"] == {"a": "1"} and not fresh
    assert FI.read_org_ids(spark, str(tmp_path / "none.json"), 0.0, fetch=fails)[0].first()["map"] == {}


def test_files(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-" + b"x" * 100 + b"%%EOF\n")
    (tmp_path / "cut.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    (tmp_path / "html.pdf").write_bytes(b"<html>" + b"x" * 100)
    (tmp_path / "tiny.pdf").write_bytes(b"%PDF-")
    got = {r.name: r.reason for r in FI.file_checks(spark, str(tmp_path), 50).collect()}
    assert got == {"ok.pdf": "ok", "cut.pdf": "bad tail", "html.pdf": "bad head", "tiny.pdf": "too small"}
    assert FI.listing(spark, str(tmp_path), "*.pdf").count() == 4

    def extract(name, content):
        if name == "tiny.pdf":
            raise ValueError("broken")
        yield {"doc": name, "n": len(content)}

    rows = {r.doc: (r.n, r.error) for r in FI.extract_pages(spark, str(tmp_path), extract, "doc string, n double").collect()}
    assert rows["ok.pdf"] == (111.0, "") and rows[None][1] == "tiny.pdf: broken"


def test_vectors_and_frames(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "k int, embedding array<float>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(Exception, match="not of size"):
        FI.read_vectors(spark, str(tmp_path / "v"), 2).collect()
    b = FI.coordinate_frame([(0.5, 0.25, 1, 300, 0), (1.0, 0.0, 2, 3, 1)])
    assert struct.unpack("<3I", b[:12])[1:] == (2, 2) and struct.unpack("<4f", b[32:48]) == (0.5, 0.25, 1.0, 0.0) and b[48:] == bytes([1, 2, 255, 3, 0, 1])
    assert json.loads(next(FI.event_lines(spark.range(1)))) == {"id": 0}
    FI.write_marked(spark.range(3), str(tmp_path / "m"))
    assert (tmp_path / "m" / "_SUCCESS").exists()
    FI.write_index(spark.createDataFrame([(1, 2023), (2, 2024)], "k int, report_year int"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).where("report_year = 2024").first().k == 2
    FI.write_postings(spark.createDataFrame([("b", 1), ("a", 2)], "term string, tf int"), str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def _fetcher():
    """A function of its own, since workers don't have this module."""
    from tessera.sources.announcements import Refused

    def fetch(code, page):
        if code == "bad":
            raise Refused(403)
        if code == "none":
            return {"total": 0, "rows": None}
        n = 30 if page < 3 else 5
        return {"total": 65, "rows": [{"title": f"{code} {page}", "ts_ms": 1, "ann_id": page} for _ in range(n)]}

    return fetch


def test_announcements(spark):
    spark.dataSource.register(AN.source(_fetcher(), ["a", "none", "bad"]))
    rows = spark.read.format("announcements").load()
    assert {r.code: r["count"] for r in rows.where("error IS NULL").groupBy("code").count().collect()} == {"a": 65}
    assert [r.error for r in rows.where("error IS NOT NULL").collect()] == ["status 403"]


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise AN.Refused(503)
        return {"ok": 1}

    assert AN.with_retries(call, sleep=waits.append, jitter=lambda: 0.5) == {"ok": 1} and waits == [1.5, 2.5]
    with pytest.raises(AN.Refused):
        AN.with_retries(lambda: _fetcher()("bad", 1), sleep=waits.append)
    assert len(waits) == 2


def test_environment(tmp_path):
    (tmp_path / "e").write_text("# c\nA = 'x'\nTESSERA_K=1\n\nbad\n")
    assert from_environment({"TESSERA_K": "2", "HOME": "h"}, str(tmp_path / "e")) == {"A": "x", "TESSERA_K": "2"}


def test_stream_in_batches(spark, tmp_path):
    """Files that arrive one after the other: a later run goes on from the table, older rows never win."""
    src = str(tmp_path / "in")
    for k, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 3, "d"), (2, 0, "old")], [(3, 1, "e")]]):
        spark.createDataFrame(rows, "k bigint, v bigint, t string").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("k bigint, v bigint, t string").option("maxFilesPerTrigger", 1).parquet(src)
    got = N.stream_upsert(s, ["k"], ["v"], "k bigint, v bigint, t string")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, "d"), (2, 1, "b"), (3, 1, "e")]
    h = N.run_to_table(N.stream_hashes(spark.readStream.schema("k bigint, v bigint, t string").parquet(src), "k", "t"))
    assert h.count() == 6


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """With one base, a later run reads only what is new, and keeps what the earlier run wrote."""
    src, base, schema = str(tmp_path / "in"), str(tmp_path / "table"), "k bigint, v bigint, t string"
    for k, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(2, 2, "c"), (5, 1, "d")], [(2, 1, "old"), (1, 9, "e")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = N.stream_upsert(spark.readStream.schema(schema).parquet(src), ["k"], ["v"], schema, base=base)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 9, "e"), (2, 2, "c"), (5, 1, "d")]
    assert sorted(r.k for r in N.Versions(spark, ["k"], schema, base).read().collect()) == [1, 2, 5]


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2024-01-01 01:00:00' AS ts, 'x' AS event_type UNION ALL SELECT timestamp_ntz'2024-01-05 01:00:00', 'x'").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "e"))
    got = N.run_to_table(N.windowed_counts(s, "ts").select(F.col("window.start").alias("s"), "event_type", "n"))
    assert got.count() <= 2


def test_sql_surface(spark):
    from tessera.sql import register

    register(spark)
    r = spark.sql("SELECT tess_dot(array(1F, 2F), array(3F, 4F)) AS d, tess_canon('2024 年 1') AS c, tess_tokens('Ab c 12') AS t, tess_rrf(1, 1) AS r, size(tess_embed('a b')) AS e").first()
    assert (r.d, r.c, r.t, r.e) == (11.0, "#年#", ["ab", "12"], 64) and r.r == pytest.approx(2 / 61)
    assert spark.sql("SELECT * FROM tess_windows('abcdef', 4, 3)").count() == 2

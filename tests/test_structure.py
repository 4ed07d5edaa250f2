import random

import models
import pytest
from pyspark.sql import functions as F

from tessera.config import LATIN, ChunkParams
from tessera.operators import structure as S

CASES = [
    ([100] * 12, [1] * 12, [(0, 6), (5, 11)]),
    ([100] * 12, [0] * 12, [(0, 6), (5, 11)]),
    ([900, 50, 50], [0, 0, 1], [(0, 0), (1, 2)]),
    ([300, 300, 50, 400, 300], [0, 1, 0, 0, 1], [(0, 1), (1, 3), (3, 4)]),
    ([100] * 10, [0] * 6 + [1] + [0] * 3, [(0, 6), (5, 9)]),
    ([200, 200, 200, 150, 30, 400, 400], [0, 0, 0, 1, 0, 0, 0], [(0, 3), (3, 5), (5, 5), (6, 6)]),
    ([100] * 7, [0] * 5 + [1, 0], [(0, 5), (4, 5), (5, 5), (6, 6)]),
]


def _atoms(spark, cases):
    rows = []
    for d, (lengths, stops) in enumerate(cases):
        at = 0
        for i, (n, s) in enumerate(zip(lengths, stops)):
            rows.append((d, 0, i, "x" * (n - 1) + ("。" if s else "x"), 1, 1, at, at + n))
            at += n + 1
    return spark.createDataFrame(rows, "doc int, section int, idx int, text string, page int, page_end int, start long, end long")


def test_ranges_golden_and_random(spark):
    rng = random.Random(0)
    cases = [(a, b) for a, b, _ in CASES]
    for _ in range(60):
        n = rng.randrange(1, 25)
        cases.append(([rng.choice([1, 10, 60, 130, 210, 420, 900]) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]))
    got = {}
    for r in S.ranges(_atoms(spark, cases), ChunkParams()).orderBy("doc", "first").collect():
        got.setdefault(r.doc, []).append((r.first, r.last))
    for d, (lengths, stops) in enumerate(cases):
        want = CASES[d][2] if d < len(CASES) else models.chunk_ranges(lengths, stops)
        assert got[d] == want == models.chunk_ranges(lengths, stops), (d, lengths, stops)


def test_paragraphs_random(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for d in range(40):
        texts = ["".join(rng.choice("abcdef") for _ in range(rng.choice([3, 9, 10, 60, 150, 430]))) + rng.choice(["", "", ".", "! "]) for _ in range(rng.randrange(1, 15))]
        want[d] = models.paragraphs(texts, LATIN.sentence_ends)
        rows += [(d, 0, i, i, "line", t) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "doc int, section int, item_idx int, page int, kind string, text string").withColumn("chapter_no", F.lit(None).cast("int")).withColumn("chapter_name", F.lit(None).cast("string"))
    got = {}
    for r in S.paragraphs(items, LATIN).orderBy("doc", "par").collect():
        got.setdefault(r.doc, []).append(r.text)
    assert got == want


def test_split_long_random(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc。,！，x") for _ in range(rng.randrange(0, 200))) for _ in range(80)] + ["y" * 95]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit in (10, 37):
        got = [r.p for r in df.select("i", S.split_long(F.col("t"), limit).alias("p")).orderBy("i").collect()]
        assert got == [models.pieces(t, limit) for t in texts]


@pytest.mark.parametrize(("numbers", "want"), [([1, 2, 9, 3, 4], [1, 2, 3, 4]), ([4, 1, 2], [1, 2]), ([1, 1, 4, 8], [1, 4])])
def test_chapter_gate(spark, numbers, want):
    c = spark.createDataFrame([("d", i, i, n, "x") for i, n in enumerate(numbers)], "doc string, item_idx int, page int, no int, name string")
    assert [r.no for r in S.chapters(c).orderBy("item_idx").collect()] == want


def test_contents_page_gives_no_heading(spark):
    rows = [("d", i, 1 if i < 3 else 2, "line", f"第{c}节 {n}") for i, (c, n) in enumerate([("一", "公司治理"), ("二", "重要事项"), ("三", "财务报告"), ("一", "公司治理")])]
    items = spark.createDataFrame(rows, "doc string, item_idx int, page int, kind string, text string")
    assert [(r.item_idx, r.no) for r in S.heading_candidates(items).collect()] == [(3, 1)]


def test_chunks_end_to_end(spark):
    body = "This is a sentence of some length about revenue. " * 30
    lines = [("cover page line", 1), ("第一节 公司治理", 2), (body, 2), ("第二节 重要事项", 3), ("【表格】", 3), ("a | b", 3), ("【/表格】", 3), ("第三节 财务报告", 4)]
    kinds = ["line"] * 4 + ["table"] * 3 + ["line"]
    items = spark.createDataFrame([("d", i, p, k, t) for i, ((t, p), k) in enumerate(zip(lines, kinds))], "doc string, item_idx int, page int, kind string, text string")
    meta = spark.createDataFrame([("d", "600000_2024", "Co", "600000", 2024)], "doc string, pdf_id string, company string, stock_code string, report_year int")
    got = S.chunked(items, LATIN, meta).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in got] == [f"600000_2024#{i:04d}" for i in range(1, len(got) + 1)]
    assert got[0].chapter == "前置" and got[0].is_front and got[0].text == "cover page line"
    assert got[1].chapter == "第1节 公司治理" and got[1].sec_chunk_index == 1 and got[1].embed_text.startswith("Co 2024年年度报告 第1节")
    # short bodies outside front matter join the chunk before, and what follows from the text is worked out anew
    assert "第二节 重要事项" in got[-1].text and got[-1].has_table and got[-1].n_table_rows == 1 and got[-1].char_len == len(got[-1].text)
    assert got[-1].page_end == 4


def test_flatten(spark):
    row = [("p", [(1, [("line", "a", 1, 9.0), ("line", " ", 1, 9.0)]), (2, [("line", "b", 2, 9.0)])])]
    d = spark.createDataFrame(row, "pdf_id string, pages array<struct<page:int,items:array<struct<kind:string,text:string,page:int,size:double>>>>")
    assert [(r.item_idx, r.page, r.text) for r in S.flatten_documents(d).orderBy("item_idx").collect()] == [(0, 1, "a"), (1, 2, "b")]

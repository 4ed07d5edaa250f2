import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.ledger_queries import TITLES


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_titles(spark):
    assert values(spark, [t for t, _ in TITLES], T.title_year) == [y for _, y in TITLES]
    assert values(spark, [None, ""], T.title_year) == [None, None]


def test_markets(spark):
    assert values(spark, ["600519", "000703", "300777", "688295", "601233", "920077", "830001", "430001", "123456"], T.market) == ["SH", "SZ", "SZ", "SH", "SH", "BJ", "BJ", "BJ", "UNKNOWN"]


def test_numerals(spark):
    assert values(spark, ["一", "九", "十", "十一", "二十", "二十三", "一二", "x", ""], T.numeral) == [1, 9, 10, 11, 20, 23, 0, 0, 0]


def test_codes_and_names(spark):
    assert values(spark, [" '600519' ", "703.sz", "1234567", None, "abc"], T.stock_code) == ["600519", "000703", "", "", ""]
    assert values(spark, ["a/b:c", "con", "x. ", None, "  .x ", "NUL.txt", "a\t b\u3000 c"], T.file_name) == ["abc", "_con", "x", "", ".x", "_NUL.txt", "a b c"]
    assert values(spark, ["\t x\u3000", "\x1cy\xa0", None], T.strip) == ["x", "y", ""]
    assert values(spark, ["a ...... 3\t", "\u3000a ...... 3"], T.is_dot_leader) == [True, True]
    assert values(spark, ["a%20b+c", "%E4%B8%AD", "100%"], T.unquoted) == ["a b+c", "中", "100%"]
    assert values(spark, ["/x?a=1&b=&a=2+3&c=%26#d=4", "no", None], T.query_values) == [{"a": "2 3", "c": "&"}, {}, {}]
    assert values(spark, ["0", "否", "Yes", None, "?"], T.truth) == [False, False, True, True, True]


def test_canon(spark):
    assert values(spark, ["2024 年 第 12 页", None, "a　1b22"], T.canon) == ["#年第#页", "", "a#b#"]
    assert values(spark, ["第一节 | 释义"], T.norm) == ["第一节释义"]
    assert values(spark, ["第一节 概览 ......... 3", "第一节 概览", "12 / 30", "第 3 页"], T.is_dot_leader) == [True, False, False, False]
    assert values(spark, [" 12 / 30 ", "第 3 页", "12345", "x 1"], T.is_page_number) == [True, True, False, False]


@pytest.mark.parametrize(("text", "want"), [("好" * 79, "ok"), ("§" * 5, "empty"), ("a" * 80 + "§" * 20, "garbled"), ("a" * 85 + "§" * 15, "ok"), ("", "empty"), (None, "empty"), ("a" * 7, "empty")])
def test_page_quality(spark, text, want):
    assert values(spark, [text], T.page_quality) == [want]


def test_joins_and_gaps(spark):
    rows = [("3,925.", "60", ""), ("归属于", "股东", ""), ("net", "profit", " "), ("net", "5", ""), ("", "x", "")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.y == r.want for r in df.select("want", T.joined(F.col("a"), F.col("b")).alias("y")).collect())
    assert values(spark, ["公 司 net profit"], T.without_cjk_gaps) == ["公司 net profit"]


def test_dates_and_tokens(spark):
    assert values(spark, [1704038400000, 1704034800000], T.announcement_date, "bigint") == ["2024-01-01", "2023-12-31"]
    assert values(spark, ["The a 12 的 我们 x1, THE", None], T.tokens) == [["the", "12", "x1", "the"], []]


def test_chunk_stats_of_all_documents(spark, tmp_path):
    from tessera.plans import text_queries as K

    texts = ["word. " * 5, "Some sentence that is long enough. " * 900]
    cols = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], cols).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.chunks: (r.docs, r.chars) for r in K.q21_chunk_stats(spark, str(tmp_path)).collect()}
    many = max(got)
    assert many > 20 and got[many][0] == 1 and got[many][1] >= len(texts[1]) // 2
    assert got[0] == (1, 0)  # the earlier row of a document that is gone

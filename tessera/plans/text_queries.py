"""Text, structure and quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import LATIN
from tessera.functions import text as T
from tessera.operators import furniture as FU
from tessera.operators import layout
from tessera.operators import ledger as L
from tessera.operators import quality as Q
from tessera.operators import structure as S
from tessera.session import cut, table

#: Lines and the headings in them (number, name).
HEADINGS = [
    ("第一节 重要提示、目录和释义", 1, "重要提示、目录和释义"),
    ("公司董事会保证本报告内容真实。", None, None),
    ("第二节", 2, "公司简介"),
    ("公司简介", None, None),
    ("第一节 重要提示、目录和释义 ......... 3", None, None),
    ("详见第三节之十一、其他", None, None),
    ("第十章规定的事项", None, None),
    ("第八节七、长期股权投资", None, None),
    ("某某股份有限公司2024年年度报告第八节优先股相关情况其他文字", 8, "优先股相关情况"),
    ("第二十三节 | 其他事项说明", 23, "其他事项说明"),
    ("第十节 财务报告及附注", 10, "财务报告"),
]
#: Words of two small pages: a table with a wrapped cell and number, and a label in three rows.
WORDS = [
    ("d", 1, 0, 10.0, 10.0, 60.0, 20.0, "Title"),
    ("d", 1, 1, 10.0, 40.0, 60.0, 50.0, "归属于"),
    ("d", 1, 2, 100.0, 40.0, 160.0, 50.0, "3,925."),
    ("d", 1, 3, 10.0, 52.0, 60.0, 62.0, "股东"),
    ("d", 1, 4, 100.0, 52.0, 160.0, 62.0, "60"),
    ("d", 1, 5, 10.0, 80.0, 60.0, 90.0, "net"),
    ("d", 1, 6, 100.0, 80.0, 160.0, 90.0, "12.5%"),
    ("d", 2, 0, 10.0, 10.0, 60.0, 20.0, "label"),
    ("d", 2, 1, 100.0, 30.0, 160.0, 40.0, "1"),
    ("d", 2, 2, 200.0, 30.0, 260.0, 40.0, "2"),
    ("d", 2, 3, 10.0, 50.0, 60.0, 60.0, "tail"),
]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.lines_as_items(table(spark, d, "documents"))


def _line_atoms(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("doc").orderBy("item_idx")
    a = _lines(spark, d).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return a.select(
        "doc", F.lit(0).alias("section"), F.lit(None).cast("int").alias("chapter_no"), F.lit(None).cast("string").alias("chapter_name"), F.col("item_idx").alias("idx"), "text", "page",
        F.col("page").alias("page_end"), "start", (F.col("start") + F.length("text")).alias("end"),
    )


def _line_chunks(spark: SparkSession, d: str) -> DataFrame:
    a = cut(_line_atoms(spark, d))  # read three times
    return S.chunks(a, S.ranges(a, LATIN), LATIN)


def _window_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 420 characters, 300 apart, as chunks."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    at = F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(300))).alias("k", "at")
    w = docs.select(F.col("doc_id").alias("doc"), "source", "text", at)
    return w.select(
        "doc", F.col("source").alias("chapter"), (F.floor(F.col("k") / 4) + 1).alias("page"), (F.floor(F.col("k") / 4) + 1).alias("page_start"), (F.floor(F.col("k") / 4) + 1).alias("page_end"),
        (F.col("k") + 1).alias("chunk_index"), F.substring(F.col("text"), F.col("at"), F.lit(420)).alias("text"), F.lit(False).alias("has_table"),
    )


def q10_extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("doc").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"), F.count_if(F.contains("text", F.lit(" | "))).alias("table_rows"))


def q11_page_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.page_quality(F.col("text")).alias("quality"))


def q12_line_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, d).select("doc", "item_idx", T.canon(t).alias("canon"), T.is_page_number(t).alias("page_number"), T.is_dot_leader(t).alias("dot_leader"))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("n", F.count("*").over(W.partitionBy("doc")))
    rows = rows.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    band = F.when(F.col("item_idx") == 0, "top").when(F.col("item_idx") == F.col("n") - 1, "bottom")
    return rows.select(F.col("source").alias("doc"), F.col("doc").alias("page"), "item_idx", "text", band.alias("band"), T.canon(F.col("text")).alias("canon"))


def q13_furniture(spark: SparkSession, d: str) -> DataFrame:
    return FU.repeated(_bands(spark, d), share=0.02)


def q13_without_furniture(spark: SparkSession, d: str) -> DataFrame:
    b = _bands(spark, d)
    return FU.without_furniture(b, FU.repeated(b, share=0.02)).groupBy("doc").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


def q14_line_sizes(spark: SparkSession, d: str) -> DataFrame:
    a = _line_atoms(spark, d)
    lines = a.select("doc", F.lit(1).alias("page"), F.col("idx").alias("line_no"), F.col("start").cast("double").alias("y0"), F.col("end").cast("double").alias("y1"), (F.length("text") % 7 + 8.0).alias("size"), "text")
    total = a.groupBy("doc").agg(F.max("end").alias("n"))
    rows = total.select("doc", F.lit(1).alias("page"), F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n"), F.lit(200).cast("bigint"))).alias("row", "at"))
    rows = rows.select("doc", "page", "row", F.col("at").cast("double").alias("y0"), (F.col("at") + 200.0).alias("y1"))
    sized = FU.attach_sizes(rows, lines)
    return sized.join(FU.body_size(lines), "doc").groupBy("doc", "body_size").agg(F.count("*").alias("rows"), F.sum("size").alias("total"), F.count_if(F.col("size") > F.col("body_size")).alias("larger"))


def q15_layout(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame(WORDS, "doc string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    return layout.page_items(words)


def q16_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("d", i, i, "line", t) for i, (t, *_) in enumerate(HEADINGS)], "doc string, item_idx int, page int, kind string, text string")
    return S.heading_candidates(rows).select("item_idx", "no", "name")


def q17_chapters(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    cand = c.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("item_idx"), F.floor(F.length("text") / 80).cast("int").alias("page"), ((F.col("turn") * 7 + F.length("text")) % 9 + 1).cast("int").alias("no"), F.col("role").alias("name"))
    cand = cand.withColumn("n", F.count("*").over(W.partitionBy("doc", "page"))).where("n <= 2").drop("n")
    return S.chapters(cand).select("doc", "item_idx", "no")


def q18_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    items = _lines(spark, d).select("*", F.lit(0).alias("section"), F.lit(None).cast("int").alias("chapter_no"), F.lit(None).cast("string").alias("chapter_name"))
    out = S.paragraphs(items, LATIN)
    return out.select("doc", F.col("par").cast("bigint").alias("par"), F.length("text").alias("chars"), "page", "page_end", F.sha1("text").alias("sha1"))


def q19_chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    return S.ranges(_line_atoms(spark, d), LATIN).select("doc", "first", "last")


def q20_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _line_chunks(spark, d).select("doc", "chunk_index", "page_start", "page_end", "char_len", "n_table_rows", "chunk_sha1")


def q20_chunks_full(spark: SparkSession, d: str) -> DataFrame:
    """All of chunking: headings, sections, paragraphs, atoms, ranges, assembly."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("pdf_id"), F.col("source").alias("company"), F.lit("").alias("stock_code"), F.lit(2024).alias("report_year"))
    return S.chunked(_lines(spark, d), LATIN, docs).select("chunk_id", "doc", "chapter", "chapter_no", "page_start", "page_end", "chunk_index", "sec_chunk_index", "char_len", "has_table", "n_table_rows", "chunk_sha1", F.sha1("embed_text").alias("embed_sha1"))


def q21_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """The new counts of all documents over an earlier state that also holds documents which are gone."""
    now = _window_chunks(spark, d).groupBy("doc").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    zero = F.lit(0).cast("bigint")
    before = now.where("chunks > 2").select("doc", zero.alias("chunks"), zero.alias("chars"))
    gone = now.where("chunks > 20").select((-1 - F.col("doc")).alias("doc"), zero.alias("chunks"), zero.alias("chars"))
    return L.upsert(before.union(gone), now, ["doc"]).groupBy("chunks").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))


def q22_length_quantiles(spark: SparkSession, d: str) -> DataFrame:
    c = _window_chunks(spark, d).withColumn("n", F.length("text").cast("bigint"))
    q = Q.index_quantiles(c, "n", {"least": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "most": 1.0})
    return q.join(c.agg(F.round(F.count_if(F.col("n") <= 400) / F.count("*"), 6).alias("share_400")))


def q23_quality_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.report(_window_chunks(spark, d), LATIN).select("doc", "metric", F.round("value", 6).alias("value"), "hard", "ok")


def q23_label_checks(spark: SparkSession, d: str) -> DataFrame:
    """Labels, embedding prefixes and empty documents: German rows lack a company, and every seventh chunk's text to encode lacks its prefix."""
    docs = table(spark, d, "documents")
    about = docs.select(F.col("doc_id").alias("doc"), F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("company"))
    chunks = _window_chunks(spark, d).join(about, "doc").withColumn("embed_text", F.when(F.col("chunk_index") % 7 == 0, F.lit("?")).otherwise(F.concat("company", F.lit(" "), "text")))
    rows = Q.report(chunks, LATIN, docs=about)
    return rows.where("metric IN ('missing_labels', 'embed_prefix', 'empty_file')").groupBy("metric", "hard", "ok").agg(F.count("*").alias("docs"), F.sum("value").alias("total"))


def q24_overlap_rate(spark: SparkSession, d: str) -> DataFrame:
    r = Q.report(_line_chunks(spark, d), LATIN).where("metric IN ('overlap_rate', 'sentence_end_rate')")
    return r.groupBy("metric").agg(F.count("*").alias("docs"), F.count_if("ok").alias("good"))


QUERIES = {
    f.__name__: f
    for f in (
        q10_extraction_stats, q11_page_quality, q12_line_flags, q13_furniture, q13_without_furniture, q14_line_sizes, q15_layout, q16_headings, q17_chapters, q18_paragraphs, q19_chunk_ranges, q20_chunks,
        q20_chunks_full, q21_chunk_stats, q22_length_quantiles, q23_quality_report, q23_label_checks, q24_overlap_rate,
    )
}

# Lines that aren't blank: doc, item_idx, page, text; with offsets: start, end (one newline between two lines).
_LINES = """
ln AS (SELECT doc_id AS doc, i - 1 AS line_no, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
li AS (SELECT doc, (row_number() OVER w - 1)::INTEGER AS item_idx, (line_no // 10 + 1)::INTEGER AS page, text FROM ln WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
pos AS (SELECT doc, item_idx AS idx, page, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM li),
a AS (SELECT *, s + length(text) AS e, regexp_matches(rtrim(text, E' \\t\\n\\r'), '[。！？；!?;….]$') AS stop, count(*) OVER (PARTITION BY doc) AS n FROM pos)
"""
# The chunks of the state machine: from each atom, how far, back to a sentence, on to the next; followed from 0.
_RANGES = f"""
WITH RECURSIVE {_LINES},
j AS (SELECT x.doc, x.idx, any_value(x.s) AS s, any_value(x.n) AS n, greatest(x.idx, max(y.idx)) AS j FROM a x JOIN a y ON x.doc = y.doc AND y.idx >= x.idx AND (y.e - x.s <= 800 OR y.idx = x.idx) GROUP BY x.doc, x.idx),
c AS (SELECT j.doc, j.idx, j.n, coalesce(max(k.idx), j.j) AS cut FROM j JOIN a z ON z.doc = j.doc AND z.idx = j.j
  LEFT JOIN a k ON k.doc = j.doc AND k.idx BETWEEN j.idx AND j.j AND k.e >= z.e - 200 AND k.stop GROUP BY j.doc, j.idx, j.n, j.j),
nx AS (SELECT c.doc, c.idx, c.cut, CASE WHEN c.cut >= c.n - 1 THEN NULL ELSE coalesce(min(p.idx), greatest(c.cut, c.idx + 1)) END AS nxt FROM c JOIN a z ON z.doc = c.doc AND z.idx = c.cut
  LEFT JOIN a p ON p.doc = c.doc AND p.idx > c.idx AND p.idx < c.cut AND p.e >= z.e - 120 GROUP BY c.doc, c.idx, c.cut, c.n),
o AS (SELECT doc, idx, cut, nxt FROM nx WHERE idx = 0 UNION ALL SELECT nx.doc, nx.idx, nx.cut, nx.nxt FROM o JOIN nx ON nx.doc = o.doc AND nx.idx = o.nxt)
"""
_WINDOWS = """
WITH w AS (SELECT doc_id AS doc, source AS chapter, k // 4 + 1 AS page, k + 1 AS chunk_index, substr(text, 300 * k + 1, 420) AS text
  FROM (SELECT *, unnest(range(0, (length(text) + 299) // 300)) AS k FROM documents WHERE length(text) > 0))
"""
_BANDS = f"""
WITH {_LINES}, b AS (SELECT source AS doc, a.doc AS page, text, canon, CASE WHEN idx = 0 THEN 'top' WHEN idx = n - 1 THEN 'bottom' END AS band
  FROM (SELECT *, regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[0-9]+', '#', 'g') AS canon FROM a) a JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = a.doc),
f AS (SELECT doc, band, canon, count(*) AS n FROM b WHERE band IS NOT NULL AND length(canon) BETWEEN 4 AND 100 GROUP BY ALL),
g AS (SELECT f.* FROM f JOIN (SELECT doc, count(DISTINCT page) AS p FROM b GROUP BY doc) USING (doc) WHERE n >= greatest(3.0, 0.02 * p))
"""
_READABLE = r"[^一-鿿＀-￯　-〿A-Za-z0-9 \n\r\t.,;:%()\[\]（）【】・·—–\-+/=]"
_PAGE_NUMBER = r"^\s*([0-9]{1,4}|[0-9]{1,4}\s*/\s*[0-9]{1,4}|第\s*[0-9]+\s*页|共\s*[0-9]+\s*页)\s*$"

ORACLE = {
    "q10_extraction_stats": f"WITH {_LINES} SELECT doc, count(DISTINCT page) AS pages, count(*) AS items, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE contains(text, ' | ')) AS table_rows FROM li GROUP BY doc",
    "q11_page_quality": f"""
WITH q AS (SELECT doc_id, text, trim(text, E' \\t\\n\\r') AS s FROM documents),
r AS (SELECT *, length(regexp_replace(text, '{_READABLE}', '', 'g')) / greatest(length(text), 1) AS share, length(regexp_replace(s, '{_READABLE}', '', 'g')) / greatest(length(s), 1) AS own FROM q)
SELECT doc_id, CASE WHEN length(text) >= 80 AND share >= 0.85 THEN 'ok' WHEN length(s) >= 8 AND own >= 0.85 THEN 'ok' WHEN length(text) < 80 THEN 'empty' ELSE 'garbled' END AS quality FROM r
""",
    "q12_line_flags": f"""
WITH {_LINES} SELECT doc, item_idx, regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[0-9]+', '#', 'g') AS canon, regexp_matches(text, '{_PAGE_NUMBER}') AS page_number,
  regexp_matches(trim(text), '^.{{2,60}}(\\.{{4,}}|…{{2,}})\\s*[0-9]+$') AS dot_leader FROM li
""",
    "q13_furniture": _BANDS + "SELECT doc, band, canon, n FROM g",
    "q13_without_furniture": _BANDS
    + f"""SELECT doc, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM b WHERE NOT (band IS NOT NULL AND regexp_matches(text, '{_PAGE_NUMBER}'))
  AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc = b.doc AND g.band = b.band AND g.canon = b.canon) GROUP BY doc""",
    "q14_line_sizes": f"""
WITH {_LINES}, l AS (SELECT doc, idx, s, e, length(text) AS c, length(text) % 7 + 8.0 AS size FROM a),
r AS (SELECT doc, k AS row, 200 * k AS y0, 200 * k + 200 AS y1 FROM (SELECT doc, unnest(range(0, max(e) // 200 + 1)) AS k FROM l GROUP BY doc)),
h AS (SELECT r.doc, r.row, arg_max(l.size, (least(y1, e) - greatest(y0, s), -idx)) AS size FROM r JOIN l ON l.doc = r.doc AND least(y1, e) > greatest(y0, s) GROUP BY ALL),
z AS (SELECT doc, arg_max(size, (n, -size)) AS body_size FROM (SELECT doc, size, sum(c) AS n FROM l GROUP BY ALL) GROUP BY doc)
SELECT r.doc, body_size::DOUBLE AS body_size, count(*) AS rows, sum(coalesce(size, 0))::DOUBLE AS total, count(*) FILTER (WHERE coalesce(size, 0) > body_size) AS larger
FROM r LEFT JOIN h ON h.doc = r.doc AND h.row = r.row JOIN z ON z.doc = r.doc GROUP BY r.doc, body_size
""",
    "q16_headings": "SELECT i::INTEGER AS item_idx, no::INTEGER AS no, name FROM (VALUES "
    + ", ".join(f"({i}, {no}, '{name}')" for i, (_, no, name) in enumerate(HEADINGS) if no)
    + ") AS t(i, no, name)",
    "q17_chapters": """
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) // 80 AS page, (turn * 7 + length(text)) % 9 + 1 AS no FROM conversations),
k AS (SELECT conv_id AS doc, turn, no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, page) AS n FROM c) WHERE n <= 2),
f AS (SELECT doc, turn, no, i, no <= 3 AS ok, CASE WHEN no <= 3 THEN no ELSE 0 END AS cur FROM k WHERE i = 1
  UNION ALL SELECT k.doc, k.turn, k.no, k.i, k.no > cur AND k.no <= cur + 3, CASE WHEN k.no > cur AND k.no <= cur + 3 THEN k.no ELSE cur END FROM f JOIN k ON k.doc = f.doc AND k.i = f.i + 1)
SELECT doc, turn::INTEGER AS item_idx, no::INTEGER AS no FROM f WHERE ok
""",
    "q18_paragraphs": f"""
WITH RECURSIVE {_LINES},
b AS (SELECT *, coalesce(NOT lag(stop) OVER (PARTITION BY doc ORDER BY idx) AND length(text) >= 10
  AND NOT regexp_matches(text, '^(第[一二三四五六七八九十]+[节章]|[一二三四五六七八九十]+[、.]|（[一二三四五六七八九十0-9]+）|\\([一二三四五六七八九十0-9]+\\)|[0-9]+[、.])'), false) AS may FROM a),
p AS (SELECT doc, idx, text, page, 0::BIGINT AS par, length(text) AS acc FROM b WHERE idx = 0
  UNION ALL SELECT b.doc, b.idx, b.text, b.page, CASE WHEN may AND acc < 420 THEN par ELSE par + 1 END, CASE WHEN may AND acc < 420 THEN acc ELSE 0 END + length(b.text) FROM p JOIN b ON b.doc = p.doc AND b.idx = p.idx + 1)
SELECT doc, par, sum(length(text))::INTEGER AS chars, min(page) AS page, max(page) AS page_end, sha1(string_agg(text, '' ORDER BY idx)) AS sha1 FROM p GROUP BY doc, par
""",
    "q19_chunk_ranges": _RANGES + "SELECT doc, idx AS first, cut AS last FROM o",
    "q20_chunks": _RANGES
    + """, t AS (SELECT o.doc, o.idx, regexp_replace(string_agg(a.text, chr(10) ORDER BY a.idx), '^\\s+|\\s+$', '', 'g') AS text, arg_min(a.page, a.idx) AS page_start, arg_max(a.page, a.idx) AS page_end
  FROM o JOIN a ON a.doc = o.doc AND a.idx BETWEEN o.idx AND o.cut GROUP BY o.doc, o.idx)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY idx))::INTEGER AS chunk_index, page_start, page_end, length(text)::INTEGER AS char_len, ((length(text) - length(replace(text, ' | ', ''))) // 3)::INTEGER AS n_table_rows, sha1(text) AS chunk_sha1
FROM t WHERE length(text) >= 10
""",
    "q21_chunk_stats": _WINDOWS
    + """, n AS (SELECT doc, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM w GROUP BY doc), m AS (SELECT chunks, chars FROM n UNION ALL SELECT 0, 0 FROM n WHERE chunks > 20)
SELECT chunks, count(*) AS docs, sum(chars)::BIGINT AS chars FROM m GROUP BY chunks""",
    "q22_length_quantiles": _WINDOWS
    + """, r AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM w)
SELECT max(v) FILTER (WHERE i = 0) AS least, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.1::DOUBLE))) AS p10, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(v) FILTER (WHERE i = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90,
  max(v) AS most, round(count(*) FILTER (WHERE v <= 400) / count(*), 6) AS share_400 FROM r""",
    "q23_quality_report": _WINDOWS
    + """, x AS (SELECT *, lag(page) OVER d AS prev, row_number() OVER d AS rn, lead(text) OVER (PARTITION BY doc, chapter ORDER BY chunk_index) AS nxt FROM w WINDOW d AS (PARTITION BY doc ORDER BY chunk_index)),
m AS (SELECT doc, count(*) FILTER (WHERE chapter IS NULL)::DOUBLE AS missing_labels, count(*) FILTER (WHERE chunk_index <> rn)::DOUBLE AS index_gaps, count(*) FILTER (WHERE page < prev)::DOUBLE AS page_decreases,
  0::DOUBLE AS page_range, count(*) FILTER (WHERE contains(chapter, '章'))::DOUBLE AS chapter_name,
  CASE WHEN count(nxt) > 0 THEN count(*) FILTER (WHERE nxt IS NOT NULL AND regexp_matches(rtrim(text, E' \\t\\n\\r'), '[。！？；!?;….]$')) / count(nxt) ELSE 1 END AS sentence_end_rate,
  CASE WHEN count(nxt) > 0 THEN count(*) FILTER (WHERE nxt IS NOT NULL AND contains(substr(nxt, 1, 420), right(text, 120))) / count(nxt) ELSE 1 END AS overlap_rate FROM x GROUP BY doc)
SELECT doc, metric, round(value, 6) AS value, metric NOT IN ('sentence_end_rate', 'overlap_rate') AS hard,
  CASE metric WHEN 'sentence_end_rate' THEN value >= 0.90::DOUBLE WHEN 'overlap_rate' THEN value >= 0.99::DOUBLE ELSE value = 0 END AS ok FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (doc)) INTO NAME metric VALUE value)
""",
    "q23_label_checks": _WINDOWS
    + """, c AS (SELECT doc, chunk_index, chapter, CASE WHEN lang = 'de' THEN '' ELSE source END AS company FROM w JOIN documents ON doc_id = doc),
m AS (SELECT doc, count(*) FILTER (WHERE company = '' OR coalesce(chapter, '') = '')::DOUBLE AS missing, count(*) FILTER (WHERE chunk_index % 7 = 0 AND company <> '')::DOUBLE AS prefix FROM c GROUP BY doc),
r AS (SELECT 'missing_labels' AS metric, TRUE AS hard, missing AS value FROM m UNION ALL SELECT 'embed_prefix', TRUE, prefix FROM m
  UNION ALL SELECT 'empty_file', FALSE, 1 FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc FROM w)))
SELECT metric, hard, value = 0 AS ok, count(*) AS docs, sum(value) AS total FROM r GROUP BY ALL""",
    "q24_overlap_rate": _RANGES
    + """, t AS (SELECT o.doc, o.idx, regexp_replace(string_agg(a.text, chr(10) ORDER BY a.idx), '^\\s+|\\s+$', '', 'g') AS text FROM o JOIN a ON a.doc = o.doc AND a.idx BETWEEN o.idx AND o.cut GROUP BY o.doc, o.idx),
x AS (SELECT *, lead(text) OVER (PARTITION BY doc ORDER BY idx) AS nxt FROM t WHERE length(text) >= 10),
m AS (SELECT doc, CASE WHEN count(nxt) > 0 THEN count(*) FILTER (WHERE nxt IS NOT NULL AND contains(substr(nxt, 1, 420), right(text, 120))) / count(nxt) ELSE 1 END AS o,
  CASE WHEN count(nxt) > 0 THEN count(*) FILTER (WHERE nxt IS NOT NULL AND regexp_matches(rtrim(text, E' \\t\\n\\r'), '[。！？；!?;….]$')) / count(nxt) ELSE 1 END AS s FROM x GROUP BY doc)
SELECT 'overlap_rate' AS metric, count(*) AS docs, count(*) FILTER (WHERE o >= 0.99::DOUBLE) AS good FROM m UNION ALL SELECT 'sentence_end_rate', count(*), count(*) FILTER (WHERE s >= 0.90::DOUBLE) FROM m
""",
}

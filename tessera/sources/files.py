"""Sources and sinks over files: CSV lists and ledgers, JSON lines, nested text documents, PDF bytes, listings, vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the ledger and the failure list, in their order.
LEDGER = ["序号", "股票代码", "股票简称", "交易所", "报告期", "公告标题", "公告日期", "公告ID", "文件路径", "字节数", "状态", "备注"]
FAILURES = ["股票代码", "股票简称", "报告期", "公告标题", "公告ID", "PDF链接", "错误信息", "尝试次数", "记录时间"]
COMPANY = {"代码": "code", "简称": "name", "交易所": "market", "orgId": "org_id", "启用": "enabled", "口径": "quota", "备注": "note"}

CHUNK = (
    "chunk_id string, pdf_id string, company string, stock_code string, report_year int, chapter string, chapter_no int, is_front boolean, page int, page_start int, page_end int, chunk_index int, "
    "sec_chunk_index int, char_len int, has_table boolean, n_table_rows int, text string, embed_text string, chunk_sha1 string"
)
MANIFEST = "pdf_id string, stock_code string, company string, exchange string, report_year int, pdf_path string, anno_id string"
TEXT_DOC = (
    "pdf_id string, meta struct<stock_code:string,company:string,exchange:string,report_year:int,anno_id:string>, "
    "pages array<struct<page:int,source:string,items:array<struct<kind:string,text:string,page:int,size:double>>,ocr_error:string>>, "
    "stats struct<text:int,ocr:int,items:int,chars:bigint,tables:int,header_lines:int,body_size:double>"
)


def read_csv(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """A CSV with a header as strings; a byte-order mark is left out, missing ``fields`` are empty, and blanks are empty, not null."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    fields = fields or df.columns
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields])


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """A user's company list with line numbers in ``ord``, ready for ``operators.ledger.companies``."""
    df = read_csv(spark, path, list(COMPANY)).toDF(*COMPANY.values())
    return df.withColumn("ord", F.monotonically_increasing_id())  # one small file, read in order


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The stated columns only. A job's files appear when it has succeeded, so readers never see half a table."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_template(df: DataFrame, path: str, force: bool = False) -> None:
    """Fails if the target is there, unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines by a stated schema; blank lines are left out, and a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_org_ids(spark: SparkSession, path: str, now: float, ttl: float = 3 * 86400, fetch: Callable[[], dict] | None = None) -> tuple[DataFrame, bool]:
    """(map<code, org_id>, fresh): the cached map while it is young; otherwise what ``fetch`` gives, or the old map if that fails, or an empty one."""
    schema = "fetched_at double, map map<string,string>"
    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path).collect()  # one row
    except Exception:  # no cache yet
        rows = []
    old = rows[0]["map"] if rows else {}
    if rows and now - rows[0]["fetched_at"] < ttl:
        return spark.createDataFrame([(old,)], "map map<string,string>"), True
    try:
        got = fetch() if fetch else None
    except Exception:
        got = None
    return spark.createDataFrame([(got if got is not None else old or {},)], "map map<string,string>"), got is not None


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Vectors of the stated size; others raise when they are read."""
    df = spark.read.parquet(path)
    ok = F.assert_true(F.size("embedding") == dim, F.lit(f"a vector is not of size {dim}")).isNull()
    return df.where(ok)


def ledger_manifest(ledger: DataFrame) -> DataFrame:
    """Ledger rows with a file as manifest rows, the first of each pdf_id."""
    from tessera.operators.ledger import OK_STATUS, first_wins

    rows = ledger.where(F.col("状态").isin(OK_STATUS)).withColumn("pdf_id", F.concat_ws("_", "股票代码", "报告期"))
    rows = first_wins(rows, ["pdf_id"], [F.col("序号").cast("int")])
    return rows.select(
        "pdf_id", F.col("股票代码").alias("stock_code"), F.col("股票简称").alias("company"), F.col("交易所").alias("exchange"), F.col("报告期").cast("int").alias("report_year"),
        F.col("文件路径").alias("stated"), F.col("公告ID").alias("anno_id"),
    )


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, bytes of files: no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def file_checks(spark: SparkSession, path: str, min_bytes: int = 200 * 1024) -> DataFrame:
    """name, bytes, reason of PDF files: size, head and tail (the last 2 KB)."""
    from tessera.operators.ledger import file_reason

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    head, tail = F.decode(F.substring("content", 1, 5), "ISO-8859-1"), F.decode(F.expr("substring(content, -2048)"), "ISO-8859-1")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), file_reason(F.col("length"), head, tail, min_bytes, "%PDF-", "%%EOF").alias("reason"))


def extract_pages(spark: SparkSession, path: str, extractor: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``extractor(name, bytes)`` yields for each file. One file's failure is a row with its error, not the job's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                name = name.rsplit("/", 1)[-1]
                try:
                    rows = [r | {"error": ""} for r in extractor(name, content)]
                except Exception as e:
                    rows = [{"error": f"{name}: {e}"[:200]}]
                if rows:
                    yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    names = [c.split()[0] for c in schema.split(", ")] + ["error"]
    full = schema + ", error string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, full)


def write_marked(df: DataFrame, path: str) -> None:
    """Data with its digest columns in one commit; the success file that Spark writes last stands for a finished marker."""
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)


def write_postings(posts: DataFrame, path: str, partitions: int) -> None:
    """Postings sorted by term within hash partitions of the term: a query's terms skip most row groups."""
    posts.repartition(partitions, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_index(rows: DataFrame, path: str, by: str = "report_year") -> None:
    """The merged index, a folder a value of ``by``, so that a filter on it reads those folders alone."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def event_lines(df: DataFrame) -> Iterator[str]:
    """Rows as JSON lines, a partition at a time on the driver."""
    for r in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        yield r["line"]


def coordinate_frame(points: list[tuple[float, float, int, int, int]], magic: int = 0x56495A31) -> bytes:
    """A header of 8 32-bit words (magic, n, 2, zeros), then x and y as 32-bit floats, then three bytes a point: group, company, flags."""
    import struct

    n = len(points)
    head = struct.pack("<8I", magic, n, 2, 0, 0, 0, 0, 0)
    xy = struct.pack(f"<{2 * n}f", *[v for p in points for v in p[:2]])
    return head + xy + b"".join(bytes(min(255, p[k]) for p in points) for k in (2, 3, 4))

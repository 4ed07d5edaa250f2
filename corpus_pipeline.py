"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and read again.
All stages but the last return the columns of ``documents``; the last returns where each piece of each document is packed.

Defined results, in every stage: a null text counts as empty (and stays null until line dedup makes it empty); a text of any length is worked on whole; of equal rows all are kept
or none, but near-dedup keeps one of them; rows that share a doc_id are judged by themselves, but count as one document where lines are counted; ties go to the least doc_id (nulls
last), then to the least hash of the row; an empty table gives an empty table; other columns go through untouched, whatever their names,
but n_chars follows the text, and columns named n_lines or n_dropped are replaced by line dedup's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, line_dedup, near_dedup, packing, quality_classifier
from tessera.session import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of ``documents`` that op1 learns from."""
    learn = ~quality_classifier.held_out(F.col("doc_id"), 3, 1)
    trees = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", learn)
    return quality_classifier.keep_good(docs, trees)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents hold go from all of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_docs=10)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.one_a_component(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier; tests/llm hold the pipeline against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

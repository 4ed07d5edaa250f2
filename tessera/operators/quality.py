"""Quality assertions over chunks: a row a document and metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import ChunkParams
from tessera.functions import text as T


def flags(chunks: DataFrame, p: ChunkParams) -> DataFrame:
    """Chunks with what the metrics need of their neighbours."""
    w = W.partitionBy("doc").orderBy("chunk_index")
    in_chapter = W.partitionBy("doc", "chapter").orderBy("chunk_index")
    following = F.lead("text").over(in_chapter)
    judged = ~F.col("has_table") & following.isNotNull()
    return (
        chunks.withColumn("_prev", F.lag("page").over(w))
        .withColumn("_n", F.row_number().over(w))
        .withColumn("_judged", judged)
        .withColumn("_ends", judged & T.ends_sentence(F.col("text"), p.sentence_ends))
        .withColumn("_pairs", following.isNotNull())
        .withColumn("_overlaps", following.isNotNull() & F.contains(F.substring(following, 1, 420), F.right("text", F.lit(120))))
    )


def report(chunks: DataFrame, p: ChunkParams = ChunkParams(), least_ends: float = 0.90, least_overlap: float = 0.99, docs: DataFrame | None = None) -> DataFrame:
    """doc, metric, value, hard, ok.

    A label is missing where it is null, empty or 0. ``company`` and ``embed_text`` are looked at where ``chunks`` has them; a document of ``docs`` without
    chunks gets one row, ``empty_file`` (not hard: there is nothing wrong in it).
    """
    f = flags(chunks, p)
    rate = lambda hit, of: F.when(F.count_if(of) > 0, F.count_if(hit) / F.count_if(of)).otherwise(1.0)
    bad = lambda c: F.count_if(c).cast("double")
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    missing = blank("chapter") | blank("page") | (F.col("page") == 0) | blank("chunk_index") | (F.col("chunk_index") == 0)
    counts = {}
    if "company" in chunks.columns:
        missing = missing | blank("company")
        if "embed_text" in chunks.columns:
            counts["embed_prefix"] = bad(~F.coalesce(F.startswith("embed_text", "company"), F.lit(False)))
    counts |= {
        "missing_labels": bad(missing),
        "index_gaps": bad(F.col("chunk_index") != F.col("_n")),
        "page_decreases": bad(F.col("page") < F.col("_prev")),
        "page_range": bad(F.col("page_start") > F.col("page_end")),
        "chapter_name": bad(F.col("chapter").contains("章")),
    }
    rates = {"sentence_end_rate": (rate(F.col("_ends"), F.col("_judged")), least_ends), "overlap_rate": (rate(F.col("_overlaps"), F.col("_pairs")), least_overlap)}
    per = f.groupBy("doc").agg(*(c.alias(m) for m, c in counts.items()), *(c.alias(m) for m, (c, _) in rates.items()))
    row = lambda m, hard, ok: F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(hard).alias("hard"), ok.alias("ok"))
    rows = [row(m, True, F.col(m) == 0) for m in counts] + [row(m, False, F.col(m) >= least) for m, (_, least) in rates.items()]
    out = per.select("doc", F.explode(F.array(*rows)).alias("r")).select("doc", "r.*")
    if docs is None:
        return out
    empty = docs.select("doc").distinct().join(chunks.select("doc").distinct(), "doc", "left_anti")
    return out.union(empty.select("doc", F.lit("empty_file").alias("metric"), F.lit(1.0).alias("value"), F.lit(False).alias("hard"), F.lit(False).alias("ok")))


def passed(rows: DataFrame) -> bool:
    """Whether no hard metric of a report failed: a run's exit state."""
    return not rows.where(F.col("hard") & ~F.col("ok")).head(1)


def index_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share p the value at place min(n - 1, int(n * p)) of the sorted values.

    Values are counted first, so what is sorted in one place is the distinct values (lengths: few), not the rows.
    """
    by = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = W.orderBy("v")
    cum = by.select("v", F.sum("n").over(w).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * p)), F.col("v"))).alias(k) for k, p in shares.items()]
    return cum.agg(*picks)

"""Dense, keyword, hybrid, grouped and filtered search, and context assembly.

Scores are computed for all rows; texts are joined only for the rows that a query returns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import config as C
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators.rank import ONE_TASK, global_rank, top_per_group
from tessera.session import cut


def similarity(corpus: DataFrame, query: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sim of every row: dot product with the (normalised) query vector. ``query`` is one row."""
    q = query.select(V.unit("embedding").alias("_q"))
    return corpus.join(F.broadcast(q)).withColumn("sim", F.round(V.dot("embedding", "_q"), 9)).drop("_q")


def vector_search(corpus: DataFrame, query: DataFrame, k: int = C.TOP_K, key: str = "doc_id", where: Column | None = None) -> DataFrame:
    """The k most similar rows that ``where`` lets through (it applies before the cut, so fewer rows may come back)."""
    rows = corpus if where is None else corpus.where(where)
    return similarity(rows, query, key).orderBy(F.desc("sim"), key).limit(k)


def bm25(posts: DataFrame, stats: DataFrame, terms: list[str], key: str = "doc_id", p: C.Bm25Params = C.Bm25Params()) -> DataFrame:
    """key, bm25 of the rows that hold a query term. Only the terms' postings are read; each term counts once."""
    terms = sorted(set(terms))
    mine = posts.where(F.col("term").isin(terms))
    corpus = stats.agg(F.count("*").alias("_n"), F.avg("doc_len").alias("_avg"))
    df = mine.groupBy("term").agg(F.count("*").alias("_df"))  # a row a query term
    w = mine.join(F.broadcast(df), "term").join(stats, key).join(F.broadcast(corpus))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    avg = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)
    part = idf * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("doc_len") / avg))
    return w.groupBy(key).agg(F.round(F.sum(part), 9).alias("bm25"))


def bm25_scan(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", tokenize=T.tokens, p: C.Bm25Params = C.Bm25Params()) -> DataFrame:
    """What ``bm25`` gives, without an index: texts are tokenized once, into a written table of lengths and of the query's own counts.

    No term is shuffled; the corpus's size, mean length and the terms' document frequencies are a few numbers.
    """
    terms = sorted(set(terms))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("bm25")).limit(0)
    own = docs.select(key, tokenize(F.col(text)).alias("_t"))
    own = own.select(key, F.size("_t").cast("bigint").alias("_len"), F.filter("_t", lambda x: x.isin(terms)).alias("_hits"))
    equals = lambda t: lambda x: x == t
    counts = [F.size(F.filter("_hits", equals(t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    rows = cut(own.select(key, "_len", *counts))
    n, avg, *df = rows.agg(F.count("*"), F.avg("_len"), *[F.count_if(F.col(f"_tf{i}") > 0) for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i, d in enumerate(df):
        tf = F.col(f"_tf{i}")
        idf = math.log(1 + (n - d + 0.5) / (d + 0.5))
        score = score + F.when(tf > 0, F.lit(idf) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * F.col("_len") / F.lit(avg or 1.0)))).otherwise(0.0)
    hit = F.greatest(F.lit(0), *[F.col(f"_tf{i}") for i in range(len(terms))]) > 0
    return rows.where(hit).select(key, F.round(score, 9).alias("bm25"))


def keyword_search(scores: DataFrame, k: int = C.TOP_K, key: str = "doc_id") -> DataFrame:
    """The k best rows by BM25, those without a positive score left out."""
    return scores.orderBy(F.desc("bm25"), key).limit(k).where("bm25 > 0")


def fused(rows: DataFrame, rrf_k: int = C.RRF_K) -> Column:
    return 1.0 / (rrf_k + F.col("vrank")) + 1.0 / (rrf_k + F.col("brank"))


def hybrid_search(corpus: DataFrame, query: DataFrame, scores: DataFrame, k: int = C.TOP_K, key: str = "doc_id", one_task: int = ONE_TASK) -> DataFrame:
    """key, sim, bm25, vrank, brank, rrf: reciprocal rank fusion over the whole corpus; rows without a query term have BM25 0 and take part.

    ``one_task``: see ``global_rank``.
    """
    both = similarity(corpus.select(key, "embedding"), query, key).select(key, "sim").join(scores, key, "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    both = cut(both.select(key, "sim", "bm25"))  # three numbers a row, read once for each rank's bounds and once for the ranks
    ranked = global_rank(global_rank(both, "sim", key, "vrank", one_task=one_task), "bm25", key, "brank", one_task=one_task)
    return ranked.withColumn("rrf", fused(ranked)).orderBy(F.desc("rrf"), key).limit(k)


def grouped_hybrid(corpus: DataFrame, query: DataFrame, scores: DataFrame, group: str, k: int = C.GROUP_K, key: str = "doc_id") -> DataFrame:
    """The k best rows of each group, with ranks within the group."""
    both = similarity(corpus.select(key, group, "embedding"), query, key).select(key, group, "sim").join(scores, key, "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    rank = lambda c: F.row_number().over(W.partitionBy(group).orderBy(F.desc(c), key)).cast("bigint")
    ranked = both.withColumn("vrank", rank("sim")).withColumn("brank", rank("bm25"))
    return top_per_group(ranked.withColumn("rrf", fused(ranked)), [group], [F.desc("rrf"), F.col(key)], k)


def centroid(rows: DataFrame, x: str = "x", y: str = "y", weight: str = "sim") -> DataFrame:
    """x, y: the mean of neighbours weighted by their similarity, negative ones left out; the middle where there are none."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    total = F.sum(w)
    mean = lambda c: F.when(F.count("*") == 0, 0.5).otherwise(F.sum(w * F.col(c)) / F.when(total > 0, total).otherwise(1.0))
    return rows.agg(mean(x).alias("x"), mean(y).alias("y"))


def context(rows: DataFrame, order: str, text: str = "text", each: int = C.CONTEXT_EACH, total: int = C.CONTEXT_TOTAL, group: list[str] | None = None) -> DataFrame:
    """Rows in order with ``used`` characters each until the budget is spent, and the ``passage``."""
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)  # the k rows of one query
    size = F.least(F.length(text), F.lit(each))
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    out = rows.withColumn("_before", before).where(F.col("_before") < total)
    used = F.least(size, F.lit(total) - F.col("_before"))
    return out.withColumn("used", used.cast("bigint")).withColumn("passage", F.substring(F.col(text), F.lit(1), F.col("used").cast("int"))).drop("_before")


def neighbours(found: DataFrame, texts: DataFrame, key: str = "doc_id", size: int = C.SNIPPET) -> DataFrame:
    """Found rows with a snippet: texts meet only the rows that were found."""
    return found.join(texts.select(key, F.substring("text", 1, size).alias("snippet")), key)


def lookup(index: DataFrame, chunks: DataFrame, row: int) -> DataFrame:
    """The chunk at a row of the index; nothing if the row is out of range or the chunk is gone."""
    return index.where(F.col("row") == row).join(chunks, "doc_id")


def all_pairs(vectors: DataFrame, key: str, among: Column) -> DataFrame:
    """a, b, cosine of the stated vectors (a small set: a demonstration's) with each other."""
    few = vectors.where(among).select(key, "embedding")
    a, b = few.select(F.col(key).alias("a"), F.col("embedding").alias("va")), few.select(F.col(key).alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", V.cosine("va", "vb").alias("cosine"))

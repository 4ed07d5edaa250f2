"""Total ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of two numbers that one task sorts in a second; more are ranked in buckets.
ONE_TASK = 1_000_000


def global_rank(df: DataFrame, score: str, key: str, name: str, buckets: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """``df`` with ``name``: 1..N by ``score`` descending, ties by numeric ``key`` ascending.

    Rows are cut into ordered buckets at approximate quantiles (of the score; of the key where the score is 0, since a sparse score is 0 almost
    everywhere), numbered within their bucket, and shifted by the rows of the buckets before. Only the bounds and a count a bucket leave the executors.
    Up to ``one_task`` rows are sorted in one task instead, which gives the same ranks. ``df`` is read more than once, so it should be a written table.
    """
    if df.count() <= one_task:
        return df.withColumn(name, F.row_number().over(W.orderBy(F.col(score).desc(), key)).cast("bigint"))
    shares = [i / buckets for i in range(1, buckets)]
    s, k = F.col(score), F.col(key)
    cuts = df.agg(F.percentile_approx(F.when(s != 0, s), shares, 10000).alias("s"), F.percentile_approx(F.when(s == 0, k), shares, 10000).alias("k")).first()
    by_score = sorted({float(x) for x in cuts["s"] or []}, reverse=True)
    by_key = sorted({int(x) for x in cuts["k"] or []})
    above = lambda bounds, col, over: sum((F.when(over(col, F.lit(b)), 1).otherwise(0) for b in bounds), F.lit(0))
    # positive scores first, zeros by key, negative ones last; bounds are counted, so a row's bucket never depends on its task
    place = F.when(s != 0, above(by_score, s, lambda a, b: a < b)).otherwise(above([b for b in by_score if b > 0], s, lambda a, b: a < b))
    inner = F.when(s == 0, above(by_key, k, lambda a, b: a > b)).otherwise(0)
    dealt = df.withColumn("_sign", F.when(s > 0, 0).when(s == 0, 1).otherwise(2)).withColumn("_place", place).withColumn("_inner", inner)
    parts = ["_sign", "_place", "_inner"]
    before = dealt.groupBy(*parts).agg(F.count("*").alias("_n"))
    before = before.select(*parts, F.coalesce(F.sum("_n").over(W.orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*parts).orderBy(s.desc(), k))
    numbered = dealt.withColumn("_in", inside)
    # at most buckets^2 rows, in practice about two times buckets
    return numbered.join(F.broadcast(before), parts).withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint")).drop(*parts, "_in", "_before")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)

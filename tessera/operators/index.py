"""The index: BM25 statistics, content digests, stale detection, merging with vectors, facets and layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import config as C
from tessera.functions import text as T
from tessera.functions import vectors as V


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenize=T.tokens) -> DataFrame:
    """term, key, tf. Terms are counted within each task before the shuffle."""
    terms = docs.select(key, F.explode(tokenize(F.col(text))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").cast("int").alias("tf"))


def doc_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenize=T.tokens) -> DataFrame:
    """key, doc_len; documents without tokens count too."""
    return docs.select(key, F.size(tokenize(F.col(text))).cast("bigint").alias("doc_len"))


class StoredIndex:
    """A keyword index in a folder, which queries read: ``postings`` (term, key, tf, doc_len), a folder a share of the terms and in their order within a file; ``terms`` (term, df) likewise; ``corpus`` (one row: n, avg).

    A query reads the folders of its terms, and in them the row groups that hold these. Lengths stand with the postings, so scoring joins nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key
        self._postings, self._terms = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms"))
        self.n, self.avg, self.shares = spark.read.parquet(f"{path}/corpus").first()

    @staticmethod
    def _share(term: Column, shares: int) -> Column:
        return F.pmod(F.hash(term), F.lit(shares))

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenize=T.tokens, shares: int = 16) -> StoredIndex:
        """Texts are tokenized once. ``shares``: folders; some hundred megabytes each are a good size."""
        own = docs.select(key, tokenize(F.col(text)).alias("_t")).select(key, "_t", F.size("_t").alias("doc_len"))
        # counted within a document first: a row a term of it, however often it says it
        counted = own.select(key, "doc_len", F.explode("_t").alias("term")).groupBy(key, "doc_len", "term").agg(F.count("*").cast("int").alias("tf"))
        placed = counted.withColumn("share", cls._share(F.col("term"), shares))
        placed.repartition(F.col("share"), F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("share", "term", key).write.mode("overwrite").partitionBy("share").parquet(f"{path}/postings")
        posts = docs.sparkSession.read.parquet(f"{path}/postings")
        terms = posts.groupBy("share", "term").agg(F.count("*").alias("df"))
        terms.repartition("share").sortWithinPartitions("share", "term").write.mode("overwrite").partitionBy("share").parquet(f"{path}/terms")
        n = F.lit(docs.count())  # documents without tokens count too
        sizes = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).select(n.alias("n"), (F.col("tokens") / F.greatest(n, F.lit(1))).alias("avg"), F.lit(shares).alias("shares"))
        sizes.write.mode("overwrite").parquet(f"{path}/corpus")
        return cls(docs.sparkSession, path, key)

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        shares = self.spark.range(1).select(F.array(*[self._share(F.lit(t), self.shares) for t in terms]).alias("s")).first()["s"]
        return table.where(F.col("share").isin(sorted(set(shares))) & F.col("term").isin(terms))

    def scores(self, terms: list[str], p: C.Bm25Params = C.Bm25Params()) -> DataFrame:
        """key, bm25 of the rows that hold a query term; each term counts once."""
        terms = sorted(set(terms))
        if not terms:
            return self._postings.select(self.key, F.lit(0.0).alias("bm25")).limit(0)
        df = {r["term"]: r["df"] for r in self._of(self._terms, terms).collect()}  # a row a query term
        idf = F.lit(0.0)
        for t, d in sorted(df.items()):
            idf = F.when(F.col("term") == t, F.lit(math.log(1 + (self.n - d + 0.5) / (d + 0.5)))).otherwise(idf)
        tf, avg = F.col("tf"), F.lit(float(self.avg or 1.0))
        part = idf * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * F.col("doc_len") / avg))
        return self._of(self._postings, terms).groupBy(self.key).agg(F.round(F.sum(part), 9).alias("bm25"))


def term_stats(posts: DataFrame, n_docs: Column) -> DataFrame:
    """term, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def digest(chunks: DataFrame, by: str, order: str, sha: Column) -> DataFrame:
    """by, digest, n: SHA-256 over the rows' hashes in order. A group is a document: its hashes fit an array."""
    inputs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), sha.alias("h"))))
    return chunks.groupBy(by).agg(F.sha2(F.array_join(F.transform(inputs, lambda x: x["h"]), ""), 256).alias("digest"), F.count("*").alias("n"))


def stale(current: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Current rows that no finished marker matches on all of ``key``."""
    return current.join(done.select(*key), key, "left_anti")


def homogeneous(markers: DataFrame, cols: list[str]) -> DataFrame:
    """One row: how many distinct parameter sets there are, and whether they may be merged."""
    n = F.count_distinct(F.struct(*cols))
    return markers.agg(n.alias("n_sets"), F.count("*").alias("n_rows"), (n <= 1).alias("ok"))


def merged(chunks: DataFrame, vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """Chunks with their vectors of the right size; a chunk without one is left out and counted by ``alignment``."""
    return chunks.join(vectors.where(F.size("embedding") == dim), key)


def alignment(chunks: DataFrame, vectors: DataFrame, group: str, key: str) -> DataFrame:
    """group, n_chunks, n_vectors, aligned."""
    both = chunks.select(group, key).join(vectors.select(key, F.lit(1).alias("_v")), key, "left")
    return both.groupBy(group).agg(F.count("*").alias("n_chunks"), F.count("_v").alias("n_vectors"), (F.count("*") == F.count("_v")).alias("aligned"))


def with_rows(chunks: DataFrame, doc: str = "pdf_id", order: str = "chunk_index") -> DataFrame:
    """Chunks with their row of the index: 0..N-1 by document, then ``order``. Only a count a document is put in order in one place."""
    before = W.orderBy(doc).rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.groupBy(doc).agg(F.count("*").alias("_n")).select(doc, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(doc).orderBy(order)) - 1
    return chunks.withColumn("_in", inside).join(offsets, doc).withColumn("row", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_in", "_before")


def ordinals(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of ``col`` numbered from 0 in their order. Values are a dimension: few."""
    values = df.select(col).distinct()
    return values.withColumn(name, (F.row_number().over(W.orderBy(col)) - 1).cast("bigint"))


def robust_box(df: DataFrame, x: str, y: str, percent: float = 0.99, pad: float = 1.05, clip: float = 1.2) -> DataFrame:
    """``df`` with x and y in [0, 1]: centred on the medians, scaled by one radius (that share of all deviations of both axes), clipped."""
    med = df.agg(F.median(x).alias("mx"), F.median(y).alias("my"))
    off = df.join(F.broadcast(med)).withColumn("_dx", F.abs(F.col(x) - F.col("mx"))).withColumn("_dy", F.abs(F.col(y) - F.col("my")))
    pooled = off.select(F.explode(F.array("_dx", "_dy")).alias("d"))
    radius = pooled.agg(F.percentile("d", F.lit(percent)).alias("r"), F.max("d").alias("m"))
    radius = radius.select(F.when(F.col("r") > 0, F.col("r")).when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("r"))
    scaled = lambda c, m: (F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(m)) / (F.col("r") * pad))) + clip) / (2 * clip)
    return off.join(F.broadcast(radius)).withColumn(x, scaled(x, "mx")).withColumn(y, scaled(y, "my")).drop("_dx", "_dy", "mx", "my", "r")


def drift(a: DataFrame, b: DataFrame, key: str, most: float = 1e-2) -> DataFrame:
    """One row: mean and least cosine of two versions of the same vectors, and whether they are the same within ``most``."""
    both = a.select(key, F.col("embedding").alias("va")).join(b.select(key, F.col("embedding").alias("vb")), key).withColumn("c", V.cosine("va", "vb"))
    return both.agg(F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"), F.count("*").alias("n"), (F.max(1 - F.col("c")) < most).alias("ok"))


def pca_layout(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, x, y: the first two principal components, signs fixed by the largest loading. Only the dim x dim covariance reaches the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    p = vector_to_array("_p")
    return model.transform(rows).select(key, (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y"))

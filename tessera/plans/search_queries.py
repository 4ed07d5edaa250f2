"""Index and search queries, with their SQL: over all documents, or over those that have a vector where one is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config as C
from tessera.functions import vectors as V
from tessera.operators import aggregate as A
from tessera.operators import index as I
from tessera.operators import search as S
from tessera.session import scratch_dir, table

TERMS = ["the", "clown", "idiot", "licensed", "reserved", "zzz"]
R = 6


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    docs, vec = table(spark, d, "documents"), table(spark, d, "embeddings")
    return docs.join(vec.withColumnRenamed("vec_id", "doc_id"), "doc_id")


def _query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Only ids and vectors: similarity needs no text."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


def _scores(spark: SparkSession, d: str, terms=TERMS) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return S.bm25_scan(c, terms)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, R))
    return df


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return S.hybrid_search(_vectors(spark, d), _query(spark, d), _scores(spark, d))


def q01_entry_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: a hybrid question with snippets."""
    return _rounded(S.neighbours(_hybrid(spark, d), table(spark, d, "documents")), "sim", "bm25", "rrf")


def q25_facets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents")
    by = c.groupBy("source").agg(F.count("*").alias("n"), F.max_by("lang", "doc_id").alias("label"), F.bit_or(F.when(F.col("text").contains(" | "), 1).otherwise(0)).alias("flags"))
    return by.join(I.ordinals(c, "source", "ordinal"), "source")


def q25_build_meta(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.count_distinct("source").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


def q26_group_rows(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("rows"))


def q27_homogeneous(spark: SparkSession, d: str) -> DataFrame:
    return I.homogeneous(table(spark, d, "embeddings").withColumn("dim", F.size("embedding")), ["dim"])


def q28_digests(spark: SparkSession, d: str) -> DataFrame:
    return I.digest(table(spark, d, "documents"), "source", "doc_id", F.sha1("text"))


def q29_stale(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "documents").select("doc_id", "lang", F.sha1("text").alias("digest"), F.lit("m1").alias("model"))
    # the last run read French texts with another model and has not seen German ones
    done = now.where("lang != 'de'").withColumn("model", F.when(F.col("lang") == "fr", "m0").otherwise(F.col("model")))
    return I.stale(now, done, ["doc_id", "digest", "model"]).select("doc_id", "lang")


def q30_alignment(spark: SparkSession, d: str) -> DataFrame:
    vec = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return I.alignment(table(spark, d, "documents"), vec, "source", "doc_id")


def q30_norms(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("norm", V.l2("embedding"))
    return _rounded(v.agg(F.avg("norm").alias("mean_norm"), F.min("norm").alias("min_norm"), F.count("*").alias("n")), "mean_norm", "min_norm")


def q30_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.with_rows(_vectors(spark, d).select("doc_id", "source"), "source", "doc_id")


def q31_lookup(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("vec_id").alias("doc_id"))
    docs = table(spark, d, "documents")
    return S.lookup(index, docs, 7).unionByName(S.lookup(index, docs, -1)).select("row", "doc_id", "lang", "source", F.sha1("text").alias("sha1"))


def q32_dense(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.vector_search(_vectors(spark, d).select("doc_id", "embedding"), _query(spark, d)).select("doc_id", "sim"), "sim")


def q33_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Scores over all documents: keywords need no vector."""
    return _rounded(S.bm25_scan(table(spark, d, "documents").select("doc_id", "text"), TERMS), "bm25")


_stored: dict[tuple[str, str], I.StoredIndex] = {}


def _index(spark: SparkSession, d: str) -> I.StoredIndex:
    """The stored keyword index of a folder's documents: built by the application's first question, read by those that follow."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _stored:
        _stored[at] = I.StoredIndex.build(table(spark, d, "documents").select("doc_id", "text"), scratch_dir(spark))
    return _stored[at]


def q33_bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same scores from the stored index."""
    return _rounded(_index(spark, d).scores(TERMS), "bm25")


def q33_bm25_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same scores by joining postings and lengths."""
    c = table(spark, d, "documents").select("doc_id", "text")
    return _rounded(S.bm25(I.postings(c), I.doc_stats(c), TERMS), "bm25")


def q33_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every term, the rare ones too."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _rounded(I.term_stats(I.postings(docs), F.lit(docs.count())), "idf")


def q34_keyword(spark: SparkSession, d: str) -> DataFrame:
    scores = S.bm25_scan(table(spark, d, "documents").select("doc_id", "text"), ["clown", "idiot", "scum"])
    return _rounded(S.keyword_search(scores), "bm25")


def q35_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_hybrid(spark, d).select("doc_id", "sim", "bm25", "vrank", "brank", "rrf"), "sim", "bm25", "rrf")


def q35_hybrid_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The same with ranks counted in ordered buckets, as for tables beyond what one task sorts."""
    found = S.hybrid_search(_vectors(spark, d), _query(spark, d), _scores(spark, d), one_task=0)
    return _rounded(found.select("doc_id", "sim", "bm25", "vrank", "brank", "rrf"), "sim", "bm25", "rrf")


def q36_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = (F.col("lang") == "en") & F.col("source").contains("1")
    return _rounded(S.vector_search(_vectors(spark, d), _query(spark, d), where=where).select("doc_id", "sim"), "sim")


def q37_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A demonstration's matrix: the vectors of one label with each other."""
    return _rounded(S.all_pairs(table(spark, d, "embeddings"), "vec_id", F.col("label") == 3), "cosine")


def q37_drift(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    coarse = v.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("embedding"))
    return _rounded(I.drift(v, coarse, "vec_id"), "mean_cosine", "min_cosine")


def q38_centroid(spark: SparkSession, d: str) -> DataFrame:
    top = S.vector_search(_vectors(spark, d), _query(spark, d)).select("sim", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return _rounded(S.centroid(top), "x", "y")


def q39_robust_box(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return _rounded(I.robust_box(v, "x", "y"), "x", "y")


def q39_pca_layout(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.robust_box(I.pca_layout(table(spark, d, "embeddings"), "vec_id"), "x", "y"), "x", "y")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return S.grouped_hybrid(_vectors(spark, d), _query(spark, d), _scores(spark, d), "source")


def q40_grouped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_grouped(spark, d).select("source", "rank", "doc_id", "vrank", "brank", "rrf"), "rrf")


def q41_map_reduce(spark: SparkSession, d: str) -> DataFrame:
    found = _grouped(spark, d).select("source", "rank", "doc_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return A.map_groups(found, "source", A.extractive(["clown", "idiot"]), each=C.GROUP_EACH).select("source", "state", F.length("answer").alias("chars"), F.concat_ws(",", "citations").alias("citations"))


def q41_reduced(spark: SparkSession, d: str) -> DataFrame:
    found = _grouped(spark, d).select("source", "rank", "doc_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return A.reduce_groups(A.map_groups(found, "source", A.extractive(["clown", "idiot"]), each=C.GROUP_EACH), "source")


def q42_context(spark: SparkSession, d: str) -> DataFrame:
    top = S.vector_search(_vectors(spark, d).select("doc_id", "embedding"), _query(spark, d), 40).select("doc_id", "sim")
    ranked = S.top_per_group(top.withColumn("g", F.lit(0)), ["g"], [F.desc("sim"), F.col("doc_id")], 40)
    texts = ranked.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return S.context(texts, "rank").select("rank", "doc_id", "used", F.sha1("passage").alias("sha1"))


QUERIES = {
    f.__name__: f
    for f in (
        q01_entry_hybrid, q25_facets, q25_build_meta, q26_group_rows, q27_homogeneous, q28_digests, q29_stale, q30_alignment, q30_norms, q30_rows, q31_lookup, q32_dense, q33_bm25, q33_bm25_indexed, q33_bm25_joined, q33_term_stats, q34_keyword, q35_hybrid, q35_hybrid_bucketed,
        q36_filtered, q37_all_pairs, q37_drift, q38_centroid, q39_robust_box, q39_pca_layout, q40_grouped, q41_map_reduce, q41_reduced, q42_context,
    )
}

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]{2,}')"


def _bm25(terms) -> str:
    return f"""
c AS (SELECT doc_id, lang, source, text, embedding, {_TOKENS} AS t FROM documents JOIN embeddings ON vec_id = doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM c) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM c),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ({", ".join(repr(t) for t in terms)}) GROUP BY term),
sc AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avg))), 9) AS bm25
  FROM tf JOIN df USING (term) JOIN c USING (doc_id), st GROUP BY doc_id),
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
qu AS (SELECT list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS q FROM qv),
si AS (SELECT doc_id, lang, source, text, embedding, round(list_inner_product(embedding::DOUBLE[], q), 9) AS sim, coalesce(bm25, 0) AS bm25 FROM c LEFT JOIN sc USING (doc_id), qu)
"""


def _bm25_all(terms) -> str:
    """The scores of ``_bm25`` over all documents, with a vector or without."""
    return f"""
c AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM c) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM c),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ({", ".join(repr(t) for t in terms)}) GROUP BY term),
sc AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avg))), 9) AS bm25
  FROM tf JOIN df USING (term) JOIN c USING (doc_id), st GROUP BY doc_id)
"""


_HYBRID = f"""WITH {_bm25(TERMS)}, rk AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS vrank, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS brank FROM si),
h AS (SELECT *, 1.0::DOUBLE / (60 + vrank) + 1.0::DOUBLE / (60 + brank) AS rrf FROM rk ORDER BY rrf DESC, doc_id LIMIT 20)
"""
_GROUPED = f"""WITH {_bm25(TERMS)}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, doc_id) AS vrank, row_number() OVER (PARTITION BY source ORDER BY bm25 DESC, doc_id) AS brank FROM si),
h AS (SELECT *, 1.0::DOUBLE / (60 + vrank) + 1.0::DOUBLE / (60 + brank) AS rrf FROM rk), g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rrf DESC, doc_id) AS rank FROM h QUALIFY rank <= 6)
"""
_MAPPED = (
    _GROUPED
    + """, l AS (SELECT source, rank, i, ls[i] AS line, (CASE WHEN contains(lower(ls[i]), 'clown') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(ls[i]), 'idiot') THEN 1 ELSE 0 END) AS n
  FROM (SELECT source, rank, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT source, rank, string_split(substr(text, 1, 1000), chr(10)) AS ls FROM g))),
b AS (SELECT source, max(n) AS n, arg_max(line, (n, -rank, -i)) AS line, arg_max(rank, (n, -rank, -i)) AS rank FROM l GROUP BY source)
"""
)

ORACLE = {
    "q01_entry_hybrid": _HYBRID + "SELECT doc_id, round(sim, 6) AS sim, round(bm25, 6) AS bm25, vrank, brank, round(rrf, 6) AS rrf, substr(text, 1, 160) AS snippet FROM h",
    "q25_facets": "SELECT source, count(*) AS n, arg_max(lang, doc_id) AS label, max(contains(text, ' | ')::INTEGER) AS flags, dense_rank() OVER (ORDER BY source) - 1 AS ordinal FROM documents GROUP BY source",
    "q25_build_meta": "SELECT count(*) AS n, max(len(embedding))::INTEGER AS dim, count(DISTINCT source) AS n_sources, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents JOIN embeddings ON vec_id = doc_id",
    "q26_group_rows": "SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS rows FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY source",
    "q27_homogeneous": "SELECT count(DISTINCT len(embedding)) AS n_sets, count(*) AS n_rows, count(DISTINCT len(embedding)) <= 1 AS ok FROM embeddings",
    "q28_digests": "SELECT source, sha256(string_agg(sha1(text), '' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY source",
    "q29_stale": "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')",
    "q30_alignment": "SELECT source, count(*) AS n_chunks, count(vec_id) AS n_vectors, count(*) = count(vec_id) AS aligned FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source",
    "q30_norms": "SELECT round(avg(n), 6) AS mean_norm, round(min(n), 6) AS min_norm, count(*) AS n FROM (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "q30_rows": "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS row FROM documents JOIN embeddings ON vec_id = doc_id",
    "q31_lookup": "SELECT vec_id AS row, doc_id, lang, source, sha1(text) AS sha1 FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id = 7",
    "q32_dense": f"WITH {_bm25(TERMS)} SELECT doc_id, round(sim, 6) AS sim FROM si ORDER BY si.sim DESC, doc_id LIMIT 20",
    "q33_bm25": f"WITH {_bm25_all(TERMS)} SELECT doc_id, round(bm25, 6) AS bm25 FROM sc",
    "q33_bm25_indexed": f"WITH {_bm25_all(TERMS)} SELECT doc_id, round(bm25, 6) AS bm25 FROM sc",
    "q33_bm25_joined": f"WITH {_bm25_all(TERMS)} SELECT doc_id, round(bm25, 6) AS bm25 FROM sc",
    "q33_term_stats": f"""
WITH t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT term, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM d
""",
    "q34_keyword": f"WITH {_bm25_all(['clown', 'idiot', 'scum'])} SELECT doc_id, round(bm25, 6) AS bm25 FROM sc WHERE sc.bm25 > 0 ORDER BY sc.bm25 DESC, doc_id LIMIT 20",
    "q35_hybrid": _HYBRID + "SELECT doc_id, round(sim, 6) AS sim, round(bm25, 6) AS bm25, vrank, brank, round(rrf, 6) AS rrf FROM h",
    "q35_hybrid_bucketed": _HYBRID + "SELECT doc_id, round(sim, 6) AS sim, round(bm25, 6) AS bm25, vrank, brank, round(rrf, 6) AS rrf FROM h",
    "q36_filtered": f"WITH {_bm25(TERMS)} SELECT doc_id, round(sim, 6) AS sim FROM si WHERE lang = 'en' AND contains(source, '1') ORDER BY si.sim DESC, doc_id LIMIT 20",
    "q37_all_pairs": """
SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))), 6) AS cosine
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 3) x JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 3) y ON x.vec_id <= y.vec_id
""",
    "q37_drift": """
WITH v AS (SELECT embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: round(x, 2)) AS b FROM embeddings),
c AS (SELECT list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) AS c FROM v)
SELECT round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine, count(*) AS n, max(1 - c) < 0.01 AS ok FROM c
""",
    "q38_centroid": f"""
WITH {_bm25(TERMS)}, t AS (SELECT greatest(sim, 0) AS w, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM si ORDER BY sim DESC, doc_id LIMIT 20)
SELECT round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM t
""",
    "q39_robust_box": """
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT median(x) AS mx, median(y) AS my FROM v),
p AS (SELECT abs(x - mx) AS d FROM v, m UNION ALL SELECT abs(y - my) FROM v, m), r AS (SELECT quantile_cont(d, 0.99) AS r FROM p)
SELECT vec_id, round((greatest(-1.2::DOUBLE, least(1.2::DOUBLE, (x - mx) / (r * 1.05::DOUBLE))) + 1.2::DOUBLE) / 2.4::DOUBLE, 6) AS x, round((greatest(-1.2::DOUBLE, least(1.2::DOUBLE, (y - my) / (r * 1.05::DOUBLE))) + 1.2::DOUBLE) / 2.4::DOUBLE, 6) AS y FROM v, m, r
""",
    "q40_grouped": _GROUPED + "SELECT source, rank, doc_id, vrank, brank, round(rrf, 6) AS rrf FROM g",
    "q41_map_reduce": _MAPPED
    + "SELECT source, CASE WHEN n > 0 THEN 'relevant' ELSE 'irrelevant' END AS state, CASE WHEN n > 0 THEN length(line) ELSE 0 END::INTEGER AS chars, CASE WHEN n > 0 THEN rank::VARCHAR ELSE '' END AS citations FROM b",
    "q42_context": f"""
WITH {_bm25(TERMS)}, t AS (SELECT doc_id, text, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank FROM si QUALIFY rank <= 40),
u AS (SELECT *, least(length(text), 900) AS each, coalesce(sum(least(length(text), 900)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT rank, doc_id, least(each, 18000 - before)::BIGINT AS used, sha1(substr(text, 1, least(each, 18000 - before)::INTEGER)) AS sha1 FROM u WHERE before < 18000
""",
}

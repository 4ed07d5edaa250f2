"""Streaming queries: each reads its table as a stream and gives what the batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table
from tessera.streaming import incremental as N


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/{name}.parquet*")


def q43_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d, "documents").select("doc_id", "n_chars", F.sha1("text").alias("digest"))
    return N.stream_upsert(s, ["doc_id"], ["n_chars"], "doc_id bigint, n_chars bigint, digest string")


def q44_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return N.stream_upsert(s, ["user_id", "event_type"], ["event_id"], "user_id bigint, event_type string, event_id bigint, value double")


def q45_stream_breaker(spark: SparkSession, d: str) -> DataFrame:
    return N.run_to_table(N.stream_breaker(_stream(spark, d, "events")))


QUERIES = {f.__name__: f for f in (q43_stream_upsert, q44_stream_latest, q45_stream_breaker)}
ORACLE = {
    "q43_stream_upsert": "SELECT doc_id, n_chars, sha1(text) AS digest FROM documents",
    "q44_stream_latest": "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id, event_type",
    "q45_stream_breaker": """
WITH r AS (SELECT user_id, event_id, ts, event_type = 'error' AS hit, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
n AS (SELECT user_id, run, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM r WHERE hit)
SELECT user_id, max(event_id) FILTER (WHERE k = 1) AS first_event, max(event_id) FILTER (WHERE k = 3) AS opened_at FROM n GROUP BY user_id, run HAVING count(*) >= 3
""",
}

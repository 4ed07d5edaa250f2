"""Streaming forms: incremental upsert by content hash, latest revision by key, and streaks of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ledger import first_wins, upsert
from tessera.session import drop_path, list_paths, scratch_dir


class Versions:
    """A keyed table in a folder, dealt by a hash of the key into ``buckets``: a batch rewrites the buckets it touches and then writes which folder holds each bucket.

    That list is the commit: readers see the last one that was finished, and a table opened again by the same ``base`` goes on from it. A folder that neither this list nor the one
    before names is removed.
    """

    def __init__(self, spark: SparkSession, key: list[str], schema: str, base: str | None = None, buckets: int = 16):
        self.spark, self.key, self.schema, self.base, self.buckets = spark, key, schema, base or scratch_dir(spark), buckets
        self.held: dict[int, str] = {}
        self._before: set[str] = set()
        done = [p for p in list_paths(spark, f"{self.base}/commits") if any(x.endswith("/_SUCCESS") for x in list_paths(spark, p))]
        if done:
            last = max(done, key=lambda p: int(p.rsplit("=", 1)[1]))
            self.held = {r["bucket"]: r["path"] for r in spark.read.parquet(last).collect()}  # a row a bucket

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def read(self, only: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self.held.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, batch: DataFrame) -> list[int]:
        return [r["_bucket"] for r in self._bucket(batch).select("_bucket").distinct().collect()]  # at most ``buckets`` numbers

    def apply(self, batch: DataFrame, number: int) -> None:
        """Upserts a batch, a row of each key. Folders have the batch's number: a batch that is run again writes the same ones."""
        some = self.touched(batch)
        if not some:
            return
        target = f"{self.base}/data/v{number}"
        if any(p.startswith(target + "/") for p in self.held.values()):  # this batch is done already
            return
        self._bucket(upsert(self.read(some), batch, self.key)).write.mode("overwrite").partitionBy("_bucket").parquet(target)
        old, self.held = self.held, {**self.held, **{b: f"{target}/_bucket={b}" for b in some}}
        rows = self.spark.createDataFrame(sorted(self.held.items()), "bucket int, path string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/commits/v={number}")
        for p in self._before - set(self.held.values()) - set(old.values()):
            drop_path(self.spark, p)
        self._before = set(old.values())


def stream_upsert(stream: DataFrame, key: list[str], order: list[str], schema: str, changed: Callable[[DataFrame], DataFrame] = lambda b: b, base: str | None = None) -> DataFrame:
    """Runs ``stream`` over what is there now, and returns the table by key with each key's last row by ``order``.

    ``base`` holds the table and the stream's checkpoint: run again with the same one, it goes on where it stopped.
    """
    versions = Versions(stream.sparkSession, key, schema, base)

    def each(batch: DataFrame, number: int) -> None:
        last = first_wins(changed(batch), key, [F.desc(c) for c in order])
        old = versions.read(versions.touched(last))
        newer = last.join(old.select(*key, *[F.col(c).alias(f"_{c}") for c in order]), key, "left")
        fresh = F.struct(*order) > F.struct(*[F.col(f"_{c}") for c in order])
        versions.apply(newer.where(F.col(f"_{order[0]}").isNull() | fresh).select(*last.columns), number)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{versions.base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return versions.read()


def stream_hashes(stream: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of each row's last text: what an incremental encoder compares with its markers."""
    return stream.select(key, F.sha1(text).alias("digest"))


def streak_state(least: int):
    """A function for applyInPandasWithState: per key, emits a row whenever a run of failures reaches ``least``.

    Input rows: key, ts, event_id, failed. State: the length of the run so far and its first event.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, first = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, failed in zip(rows["event_id"], rows["failed"], strict=True):
            if not failed:
                n, first = 0, -1
                continue
            first = int(event) if n == 0 else first
            n += 1
            if n == least:
                out.append((key[0], first, int(event)))
        state.update((n, first))
        yield pd.DataFrame(out, columns=["user_id", "first_event", "opened_at"])

    return run


def stream_breaker(stream: DataFrame, least: int = 3) -> DataFrame:
    """user_id, first_event, opened_at: where a circuit breaker opens. Rows of one key must arrive in order across batches."""
    rows = stream.select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return rows.groupBy("user_id").applyInPandasWithState(streak_state(least), "user_id bigint, first_event bigint, opened_at bigint", "n long, first long", "append", "NoTimeout")


def run_to_table(df: DataFrame, base: str | None = None) -> DataFrame:
    """Runs a streaming query over what is there now, into a written table; with the same ``base`` it goes on where it stopped."""
    spark = df.sparkSession
    base = base or scratch_dir(spark)
    query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def windowed_counts(stream: DataFrame, ts: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """event_type counts by window of event time; rows later than ``late`` are left out. Event time must be a timestamp with zone, so it is cast."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width), "event_type").agg(F.count("*").alias("n"))

"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table ``(a, b, n)`` bucketed and sorted by the two halves of a line's 128-bit hash: how many documents hold the line, up to the batch that wrote the run.
A new batch is merge-joined with the runs one after the other; keys that they have settled (counted often enough) are left out, and the others, with what the runs counted before added, become a new run
of level 0. When a level holds ``fanout`` runs they are merged into one run of the next level, so each key is rewritten about log_fanout(batches) times. Runs are
read in their buckets' order: joining them takes neither exchange nor sort of the runs, only of the new batch. A store's folder can be opened again by a later session.

Texts are split in generated code, a row a line; from then on only hashes move. Lines are counted in each task before anything is shuffled, so a line that a third of all
documents hold costs one row a task. Texts are shuffled once, to meet the places of the lines they lose.

Defined results: a null or empty text is one empty line; empty keys (blank lines) are never dropped at ``min_chars`` >= 1; a text of any length is split whole; rows that share a doc_id are one
document and count a line once together, and a null doc_id is an id of its own; equal rows lose the same lines; columns other than ``doc_id`` and ``text`` pass
through untouched, whatever their names (but ``n_lines`` and ``n_dropped`` are replaced, and names that start with ``_ld_`` are reserved); an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, drop_path, list_paths, scratch_dir

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Any character that ``lower`` might change, A-Z aside: all but ASCII, Latin-1 without its capitals, common punctuation and scripts without case.
_CASED = r"[^\x00-\xBF\xD7\xDF-\xFF‐-‾₠-₿ऀ-ॿ฀-๿　-鿿가-힣！-＠]"
KEY = "a bigint, b bigint, n bigint"


def lowered(text: Column) -> Column:
    """A-Z lower-cased: by ``lower`` where it can change nothing else, by ``translate`` elsewhere."""
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(_CASED))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def trimmed(line: Column) -> Column:
    """The line without blanks at both ends; most have none there."""
    at_an_end = F.lit(False)
    for c in BLANKS:
        at_an_end = at_an_end | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    return F.when(at_an_end, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def line_key(line: Column) -> Column:
    return trimmed(lowered(line))


class LineRuns:
    """The run store. ``limit``: a key counted in that many documents is settled and is not counted on. ``folder`` may hold the runs of an earlier session."""

    def __init__(self, spark: SparkSession, limit: int, fanout: int = 4, folder: str | None = None, buckets: int | None = None):
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a bucket of a run is one file, so it can be read in its order
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.folder = folder or scratch_dir(spark)
        self.levels: list[list[tuple[str, str]]] = [[]]
        for path in list_paths(spark, self.folder):
            level, self.buckets = (int(x) for x in path.rsplit("/", 1)[1].split("-")[1:3])
            self._at(level).append((self._table(path), path))

    def _at(self, level: int) -> list[tuple[str, str]]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _table(self, path: str) -> str:
        name = f"tessera_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({KEY}) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _write(self, run: DataFrame, level: int) -> None:
        """``run`` is dealt by (a, b) into ``buckets`` partitions, so that each bucket becomes one file."""
        path, name = f"{self.folder}/run-{level}-{self.buckets}-{uuid.uuid4().hex}", f"tessera_run_{uuid.uuid4().hex}"
        run.select("a", "b", "n").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", path).saveAsTable(name)
        self._at(level).append((name, path))

    def _runs(self) -> list[tuple[str, str]]:
        return [r for level in self.levels for r in level]

    def _rows(self, runs: list[tuple[str, str]]) -> DataFrame:
        """The rows of several runs, read as plain files: together they are in no buckets."""
        return self.spark.read.schema(KEY).parquet(*(path for _, path in runs))

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """The last count of each key: counts only grow."""
        return self._rows(runs).repartition(self.buckets, "a", "b").groupBy("a", "b").agg(F.max("n").alias("n"))

    def counts(self) -> DataFrame:
        """All runs merged: a, b, n."""
        return self._merged(self._runs()) if self._runs() else self.spark.createDataFrame([], KEY)

    def settled(self) -> DataFrame:
        """a, b of the keys that are settled. The run that settled a key is the last to hold it, so no two do."""
        runs = self._runs()
        return (self._rows(runs) if runs else self.spark.createDataFrame([], KEY)).where(F.col("n") >= self.limit).select("a", "b")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The keys of ``batch`` (a, b, n) that the runs have not settled, with all counts so far."""
        own, before = batch.select("a", "b", "n").repartition(self.buckets, "a", "b"), F.lit(0).cast("bigint")
        for k, (name, _) in enumerate(self._runs()):
            own = own.join(self.spark.table(name).withColumnRenamed("n", f"n{k}").hint("merge"), ["a", "b"], "left")
            before = F.greatest(before, F.coalesce(f"n{k}", F.lit(0)))
        return own.where(before < self.limit).select("a", "b", (F.col("n") + before).alias("n"))

    def add(self, batch: DataFrame) -> None:
        """``batch``: a, b, n of one batch, a row per key."""
        self._write(self.fresh(batch), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            for name, path in old:
                self.spark.sql(f"DROP TABLE {name}")
                drop_path(self.spark, path)
            level += 1


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 4) -> DataFrame:
    """``docs`` with ``text`` less every line whose key is in at least ``min_docs`` documents, and n_lines, n_dropped."""
    spark = docs.sparkSession
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    # a row is known by 128 bits of its id and text: repeated ids stay apart, and repeated rows lose the same lines
    r, s = F.xxhash64("doc_id", "text").alias("_ld_r"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_ld_s")
    lines = docs.select("doc_id", r, s, F.posexplode(F.split(lowered(text), "\n", -1)).alias("pos", "line"))
    key = lines.select("doc_id", "_ld_r", "_ld_s", "pos", trimmed(F.col("line")).alias("k"))
    long_enough = F.octet_length("k") >= min_chars if min_chars <= 1 else F.length("k") >= min_chars
    hashed = cut(key.where(long_enough).select("doc_id", "_ld_r", "_ld_s", "pos", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), "k").alias("b")))

    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    held = hashed.select(batch, "a", "b", "doc_id").distinct().groupBy("batch", "a", "b").agg(F.count("*").alias("n"))
    path = scratch_dir(spark)
    held.write.partitionBy("batch").parquet(path)
    counted = spark.read.schema(KEY + ", batch int").parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for k in range(batches):
        runs.add(counted.where(F.col("batch") == k).select("a", "b", "n"))
    common = cut(runs.settled())
    drop_path(spark, path)

    hits = hashed.join(common, ["a", "b"], "left_semi").groupBy("_ld_r", "_ld_s").agg(F.collect_set("pos").alias("_ld_drop"))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("bigint")
    rows = docs.select(*names, r, s, text.alias("_ld_text"), n_lines.alias("n_lines"))
    both = rows.join(hits.hint("shuffle_hash"), ["_ld_r", "_ld_s"], "left")
    gone = F.col("_ld_drop")
    own = F.split("_ld_text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), gone), lambda i: F.col("_ld_lines")[i])
    both = both.withColumn("_ld_lines", F.when(gone.isNotNull(), own))
    out = F.when(gone.isNull(), F.col("_ld_text")).otherwise(F.array_join(kept, "\n"))
    return both.select(*names, out.alias("text"), "n_lines", F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias("n_dropped"))

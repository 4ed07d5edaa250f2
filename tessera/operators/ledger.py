"""The ledger: company lists, announcements, latest picks, upserts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

OK_STATUS = ["成功", "已存在"]


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first by ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def quota_of(quota: Column, note: Column) -> Column:
    return F.when(F.coalesce(quota, F.lit("")) != "", quota).when(F.coalesce(note, F.lit("")).contains("边界"), "边界").otherwise("核心")


def companies(raw: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """code, name, market, org_id, enabled, note, quota from a user's list with its line numbers in ``ord``.

    Comment rows, invalid codes and later duplicates go; without any row left, the seeds.
    """
    rows = raw.where(~F.coalesce(F.col("code"), F.lit("")).startswith("#")).withColumn("code", T.stock_code(F.col("code"))).where("code != ''")
    rows = first_wins(rows, ["code"], ["ord"])
    out = rows.select(
        "code",
        F.btrim("name").alias("name"),
        F.coalesce(F.nullif(F.upper(F.btrim("market")), F.lit("")), T.market(F.col("code"))).alias("market"),
        F.coalesce(F.btrim("org_id"), F.lit("")).alias("org_id"),
        T.truth(F.col("enabled")).alias("enabled"),
        F.coalesce("note", F.lit("")).alias("note"),
        quota_of(F.col("quota"), F.col("note")).alias("quota"),
    )
    if seeds is not None and not out.head(1):
        return seeds
    return out


def seed_list(seeds: DataFrame) -> DataFrame:
    """code, name, quota, note rows as companies; those of the quota 北交所 start disabled."""
    return seeds.select("code", "name", T.market(F.col("code")).alias("market"), F.lit("").alias("org_id"), (F.col("quota") != "北交所").alias("enabled"), "note", "quota")


def with_org_ids(companies: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping``: one row with map<code, org_id>. Fills blank org_ids; null where the map has none."""
    pairs = mapping.select(F.explode("map").alias("code", "found"))
    return companies.join(pairs, "code", "left").withColumn("org_id", F.coalesce(F.nullif("org_id", F.lit("")), "found")).drop("found")


def latest(candidates: DataFrame, key: list[str], order: list, shown: int = 3) -> DataFrame:
    """The first candidate of each key by ``order``, with how many others there are (n_alternatives) and the first of their ids (alternatives)."""
    w = W.partitionBy(*key).orderBy(*order)
    ranked = candidates.withColumn("_rn", F.row_number().over(w))
    rest = ranked.where("_rn > 1").groupBy(*key).agg(
        F.count("*").alias("n_alternatives"), F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("_rn") <= shown + 1, F.struct("_rn", "id")))), 1, shown), lambda x: x["id"]).alias("alternatives")
    )
    top = ranked.where("_rn = 1").drop("_rn").join(rest, key, "left")
    return top.withColumn("n_alternatives", F.coalesce("n_alternatives", F.lit(0).cast("bigint")))


def pick_reports(announcements: DataFrame) -> DataFrame:
    """The latest report of each (code, year): by time, titles that don't start with 关于 first, larger files first, then arrival."""
    rows = announcements.withColumn("year", T.title_year(F.col("title"))).where("year IS NOT NULL").withColumn("id", F.col("ann_id"))
    return latest(rows, ["code", "year"], [F.desc("ts_ms"), F.col("title").startswith("关于"), F.desc("size_kb"), F.col("ord")])


def status_grid(companies: DataFrame, years: DataFrame, picked: DataFrame, any_seen: DataFrame) -> DataFrame:
    """Every (code, year) with its pick and status: matched, no match (the company has announcements, but none for the year) or none at all."""
    cells = companies.select("code").crossJoin(F.broadcast(years.select("year")))  # a company list times a handful of years
    seen = any_seen.select("code").distinct().withColumn("_seen", F.lit(True))
    out = cells.join(picked, ["code", "year"], "left").join(seen, "code", "left")
    return out.withColumn("status", F.when(F.col("id").isNotNull(), "matched").when(F.col("_seen"), "no match").otherwise("none")).drop("_seen")


def upsert(old: DataFrame, new: DataFrame, key: list[str], drop: DataFrame | None = None) -> DataFrame:
    """New rows over old ones by key; dropped keys go from the old rows only."""
    kept = old.join(new.select(*key), key, "left_anti")
    if drop is not None:
        kept = kept.join(drop.select(*key), key, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def renumbered(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 in ``order``, within groups if any are stated. Without groups one task sorts all rows: for ledgers, which are small."""
    w = W.partitionBy(*within).orderBy(*order) if within else W.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))


def file_reason(size: Column, head: Column, tail: Column, min_bytes: int, magic: str, end: str) -> Column:
    """Why a file is not valid; ok if it is."""
    return F.when(size < min_bytes, "too small").when(~head.startswith(magic), "bad head").when(~tail.contains(end), "bad tail").otherwise("ok")


def resolve_paths(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """path: the ledger's where the listing has it, else {pdf_id}.pdf where that is there, else null (missing)."""
    files = listing.select("path")
    a = ledger.join(files.withColumn("_own", F.col("path")).withColumnRenamed("path", "stated"), "stated", "left")
    b = files.withColumn("_by_id", F.col("path")).select(F.regexp_replace("path", r"\.pdf$", "").alias("pdf_id"), "_by_id")
    return a.join(b, "pdf_id", "left").withColumn("path", F.coalesce("_own", "_by_id")).drop("_own", "_by_id")


def streaks(events: DataFrame, key: list[str], order: list[str], hit: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive rows with ``hit``: key, start, end, length. A circuit breaker opens at the ``least``-th."""
    w = W.partitionBy(*key).orderBy(*order)
    misses = F.sum(F.when(hit, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    runs = events.withColumn("_hit", hit).withColumn("_run", misses).where("_hit").groupBy(*key, "_run")
    first, last = F.min(F.struct(*order)).alias("f"), F.max(F.struct(*order)).alias("l")
    return runs.agg(first, last, F.count("*").alias("length")).where(F.col("length") >= least).drop("_run")

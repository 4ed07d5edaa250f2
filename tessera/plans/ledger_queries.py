"""Ledger, file and streak queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ledger as L
from tessera.session import table

#: Titles and the year each one announces.
TITLES = [
    ("2024年年度报告", 2024),
    ("2024年度报告", 2024),
    ("2024 年年度报告", 2024),
    ("恒逸石化2024年年度报告", 2024),
    ("2024年年度报告（修订版）", 2024),
    ("2024年年度报告摘要", None),
    ("2024 Annual Report", None),
    ("2024年年度报告(英文版)", None),
    ("2024年半年度报告", None),
    ("关于2024年年度报告的更正公告", None),
    ("关于举行2024年年度报告网上说明会的公告", None),
    ("2019年年度报告", 2019),
    ("<em>2023年年度报告</em>", 2023),
    ("2024年年度报告及2023年年度报告更正的说明", None),
    ("600889_南京化纤_2025年_年报", 2025),
    ("600889_南京化纤_2025年_年报_摘要", None),
    ("2024年报点评", None),
    ("关于2024年报的问询函", None),
]
SEEDS = [("600519", "o1"), ("000703", "o2"), ("300777", None), ("688295", "o4"), ("920077", None)]


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(lit, r))})" for r in rows)


def q02_company_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    rows = c.withColumn("code", T.stock_code(F.col("c_custkey").cast("string"))).withColumn("quota", F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")))
    rows = rows.withColumn("quota", L.quota_of(F.col("quota"), F.col("c_name"))).where("quota != 'BUILDING'")
    return L.first_wins(rows, ["c_nationkey", "quota"], ["c_custkey"]).select("code", "c_nationkey", "quota", T.market(F.col("code")).alias("market"))


def q03_title_years(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in TITLES], "title string")
    return rows.select("title", T.title_year(F.col("title")).alias("year"))


def q04_latest_per_year(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate")).withColumn("id", F.col("o_orderkey"))
    order = [F.desc("o_orderdate"), F.col("o_orderpriority").startswith("1"), F.desc("o_totalprice"), F.col("o_orderkey")]
    top = L.latest(o, ["o_custkey", "year"], order)
    code = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    return top.select("o_custkey", "year", "o_orderkey", "n_alternatives", T.market(code).alias("market"), (F.col("o_totalprice") < 1000).alias("suspicious"))


def q05_status_grid(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"))
    years = spark.range(1995, 2002).select(F.col("id").cast("int").alias("year"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    o = table(spark, d, "orders").where("o_orderpriority LIKE '1%' AND o_totalprice > 400000").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"))
    mine = o.join(c, o["o_custkey"] == c["c_custkey"])
    picked = mine.groupBy("code", "year").agg(F.max("o_orderkey").alias("id"))
    return L.status_grid(n, years, picked, mine).select("code", "year", "id", "status")


def q06_manifest_years(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))


def q07_retry_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(pairs, "o_orderkey", "left_semi").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def q08_file_audit(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    p = table(spark, d, "pages").withColumn("reason", L.file_reason(F.length(h), h, F.right(h, F.lit(64)), 1000, "<!DOCTYPE", "</html>"))
    return p.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.length(h)).alias("chars"))


def q08_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("in_index"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("on_disk", F.lit(1))
    both = c.join(o, "k", "full_outer").withColumn("state", F.when(F.col("in_index").isNull(), "only on disk").when(F.col("on_disk").isNull(), "only in index").otherwise("both"))
    return both.groupBy("state").agg(F.count("*").alias("n"))


def q09_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = c.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0))
    drop = c.where("c_nationkey = 3")
    return L.renumbered(L.upsert(c, new, ["c_custkey"], drop), ["c_custkey"], "ordinal", ["c_nationkey"]).select("c_custkey", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "ordinal")


def q45_error_streaks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    runs = L.streaks(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3)
    return runs.select("user_id", F.col("f.event_id").alias("first_event"), F.col("l.event_id").alias("last_event"), "length")


def q46_org_ids(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([(c, "") for c, _ in SEEDS], "code string, org_id string")
    mapping = spark.createDataFrame([({c: o for c, o in SEEDS if o},)], "map map<string,string>")
    return L.with_org_ids(seeds, mapping).select("code", "org_id", T.market(F.col("code")).alias("market"))


QUERIES = {f.__name__: f for f in (q02_company_list, q03_title_years, q04_latest_per_year, q05_status_grid, q06_manifest_years, q07_retry_pairs, q08_file_audit, q08_reconcile, q09_upsert, q45_error_streaks, q46_org_ids)}


def _market(code: str) -> str:
    tests = " ".join(f"WHEN substr({code}, 1, 3) IN ({', '.join(repr(p) for p in ps)}) THEN '{m}'" for m, ps in T.MARKETS.items())
    return f"CASE {tests} WHEN substr({code}, 1, 2) IN ('83', '87') OR substr({code}, 1, 1) IN ('4', '8') THEN 'BJ' ELSE 'UNKNOWN' END"


ORACLE = {
    "q02_company_list": f"""
WITH r AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0') AS code, c_nationkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment WHEN contains(c_name, '边界') THEN '边界' ELSE '核心' END AS quota FROM customer)
SELECT code, c_nationkey, quota, {_market("code")} AS market FROM r WHERE quota <> 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_nationkey, quota ORDER BY c_custkey) = 1
""",
    "q03_title_years": f"SELECT title, year::INTEGER AS year FROM (VALUES {_values(TITLES)}) AS t(title, year)",
    "q04_latest_per_year": f"""
WITH r AS (SELECT *, year(o_orderdate)::INTEGER AS year, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS n FROM orders
  WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, starts_with(o_orderpriority, '1'), o_totalprice DESC, o_orderkey))
SELECT o_custkey, year, o_orderkey, n - 1 AS n_alternatives, {_market("lpad(o_custkey::VARCHAR, 6, '0')")} AS market, o_totalprice < 1000 AS suspicious FROM r WHERE rn = 1
""",
    "q05_status_grid": """
WITH m AS (SELECT c_nationkey AS code, year(o_orderdate) AS year, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%' AND o_totalprice > 400000),
p AS (SELECT code, year, max(o_orderkey) AS id FROM m GROUP BY ALL)
SELECT n_nationkey AS code, y.year::INTEGER AS year, id, CASE WHEN id IS NOT NULL THEN 'matched' WHEN n_nationkey IN (SELECT code FROM m) THEN 'no match' ELSE 'none' END AS status
FROM nation CROSS JOIN range(1995, 2002) AS y(year) LEFT JOIN p ON p.code = n_nationkey AND p.year = y.year
""",
    "q06_manifest_years": "SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL",
    "q07_retry_pairs": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL",
    "q08_file_audit": """
SELECT CASE WHEN length(html) < 1000 THEN 'too small' WHEN NOT starts_with(html, '<!DOCTYPE') THEN 'bad head' WHEN NOT contains(right(html, 64), '</html>') THEN 'bad tail' ELSE 'ok' END AS reason,
  count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY ALL
""",
    "q08_reconcile": """
SELECT CASE WHEN c_custkey IS NULL THEN 'only on disk' WHEN o_custkey IS NULL THEN 'only in index' ELSE 'both' END AS state, count(*) AS n
FROM customer FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY ALL
""",
    "q09_upsert": """
WITH u AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS b FROM customer WHERE c_acctbal < 0 OR c_nationkey <> 3)
SELECT c_custkey, c_nationkey, round(b::DOUBLE, 2) AS c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ordinal FROM u
""",
    "q45_error_streaks": """
WITH r AS (SELECT user_id, event_id, ts, event_type = 'error' AS hit, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS length FROM r WHERE hit GROUP BY user_id, run HAVING count(*) >= 3
""",
    "q46_org_ids": f"SELECT code, org_id, {_market('code')} AS market FROM (VALUES {_values(SEEDS)}) AS t(code, org_id)",
}

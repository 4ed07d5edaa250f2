"""URL rules and verdicts by link-graph propagation over hosts.

Rules of (host, path) judge a url first: a rule fits its host and all subdomains if the url's path starts with the rule's, and the longest one wins. A host
seeds trust if rules allow more than half of its pages, and distrust if they block more than half (a rule for one section of a site says little about the
rest). Where its pages leave that open, or it has none, the urls that other hosts' pages link to count along with them, each as often as it is linked. Trust flows along links (personalised PageRank); distrust flows against them: who links to a bad host is suspect. A host's pages without a rule are
blocked if its distrust passes ``limit`` times its trust.

Links are the absolute and scheme-relative hrefs of the pages; those to the page's own host say nothing about other hosts and are left out. Pages are summed to
host edges in each task before the shuffle, so a host with a third of all pages costs one row a task and target. Both walks run in one join an iteration, until scores settle; each iteration's
scores are a written table, and the one before it goes.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is allowed; so are hosts that neither walk reaches; null html has no links; repeated rows are judged
one by one and their links count twice; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.line_dedup import UPPER
from tessera.session import cut, drop_path, scratch_dir

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
HREF = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    tests = []
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        tests.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
    return F.coalesce(*tests)


def host_links(pages: DataFrame, rules=RULES) -> DataFrame:
    """src, dst, n, allow, block: links from the pages of one host (empty where the page's url has none) to another, and to how many of their targets rules say so."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(HREF), F.lit(1))).alias("to"))
    links = links.withColumn("to", F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))
    links = links.select("src", host_of(F.col("to")).alias("dst"), path_of(F.col("to")).alias("path")).where("dst != '' AND src != dst")
    links = links.select("src", "dst", rule_of(F.col("dst"), F.col("path"), rules)["verdict"].alias("v"))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"), *[F.count_if(F.col("v") == v).alias(v) for v in ("allow", "block")])


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from the pages of one host to another."""
    return host_links(pages).where("src != ''").select("src", "dst", "n")


def seeds_of(ruled: DataFrame, links: DataFrame) -> DataFrame:
    """host, kind of the hosts that seed a walk. ``ruled``: host, v (the verdict of its rule or null), a row a page. ``links``: as of ``host_links``."""
    kinds = ("allow", "block")
    own = ruled.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.col("v") == v).alias(v) for v in kinds])
    to = links.groupBy(F.col("dst").alias("host")).agg(*[F.sum(c).alias(f"to_{c}") for c in ("n", *kinds)])
    both = own.join(to, "host", "full").na.fill(0)
    pages = lambda v: F.col(v) * 2 > F.col("n")
    known = lambda v: (F.col(v) + F.col(f"to_{v}")) * 2 > F.col("n") + F.col("to_n")
    kind = F.when(pages("allow"), "trust").when(pages("block"), "distrust").when(known("allow"), "trust").when(known("block"), "distrust")
    return both.select("host", kind.alias("kind")).where("kind IS NOT NULL")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """host, kind, score. ``edges``: src, dst, n. ``seeds``: host, kind ('trust' follows links, 'distrust' goes against them), a row a seed.

    A walk restarts at its seeds with a weight of 1 each (the sum of the seeds' own walks, so that scores of both kinds compare); what a host
    without onward edges holds is not passed on. Without ``iterations`` the walks go on until they reach no new host and no score changes by more than
    ``tolerance`` of itself.
    """
    spark = edges.sparkSession
    walk = iterations != 0 and bool(edges.head(1))  # nothing to walk along: the scores are the seeds' weights
    ways = edges.select("src", "dst", "n", F.lit("trust").alias("kind")).union(edges.select("dst", "src", "n", F.lit("distrust")))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    steps = cut(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w"))) if walk else None
    start = cut(seeds.select("kind", "host", F.lit(1.0).alias("s")))
    scores, last, done = start.withColumnRenamed("s", "score"), None, 0
    while walk:
        moved = scores.join(steps, (scores["kind"] == steps["kind"]) & (scores["host"] == steps["src"])).select(steps["kind"], F.col("dst").alias("host"), (damping * F.col("score") * F.col("w")).alias("x"), F.lit(0.0).alias("was"))
        back = start.select("kind", "host", ((1 - damping) * F.col("s")).alias("x"), F.lit(0.0))
        were = scores.select("kind", "host", F.lit(0.0), F.col("score"))
        path = scratch_dir(spark)
        now = cut(moved.union(back).union(were).groupBy("kind", "host").agg(F.sum("x").alias("score"), F.sum("was").alias("was")), path)
        done += 1
        walk = done < iterations if iterations is not None else bool(now.where(F.abs(F.col("score") - F.col("was")) > tolerance * F.col("score")).head(1))
        scores = now.drop("was")
        if last:
            drop_path(spark, last)
        last = path
    return scores


def judge(pages: DataFrame, rules=RULES, limit: float = 1.0, damping: float = 0.85, iterations: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page (page_id, url, html)."""
    url = F.col("url")
    ruled = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = cut(ruled.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("v")))
    links = cut(host_links(pages, rules))
    edges = links.where("src != ''").select("src", "dst", "n")
    scores = propagate(edges, seeds_of(ruled, links), damping, iterations)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    hosts = cut(scores.groupBy("host").agg(of("trust"), of("distrust")))
    out = ruled.join(hosts, "host", "left")
    trust, distrust = (F.coalesce(F.col(k), F.lit(0.0)) for k in ("trust", "distrust"))
    own = F.when(distrust > limit * trust, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.col("v"), own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))

"""Quality rules with host-level verdicts. DataFrame functions only.

Each document gets counts and a base verdict. Failures are summed by host (a column; ``source`` here), each host's failure
rate is shrunk towards the rate of all hosts with a beta prior fitted to the hosts by the method of moments, and hosts whose
shrunk rate passes ``host_limit`` fail with all their documents.

The counts are cut to a narrow table first (no text in it), so texts are read once and never shuffled. The sums by host are
combined in each task before the shuffle; the join back takes Spark's own broadcast or skew-split join, as sizes tell.

Windows of three words that occur twice in a text are found by sorting one number a window: its hash above its place. Neighbours with equal hashes are
confirmed on their words.

Defined results: a null or empty text has no words and fails; a text of any length is judged whole; documents without a host are judged alone; repeated rows are
rows of their own; equal rates fall on the same side of the limit (a rate at the limit passes); extra columns of ``docs`` are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"


def _again(s: Column, bits: Column) -> Column:
    """(place, place) of neighbours with one hash as one number, of the sorted numbers ``s``: hash above place of ``bits`` bits."""
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)
    alike = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0
    n = F.size(s) - 1
    pairs = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda x, y: F.when(alike(x, y), F.shiftleft(place(x), 31) + place(y)).otherwise(F.lit(-1)))
    return F.when(n > 0, F.array_remove(pairs, F.lit(-1).cast("bigint")))


def counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = text
    for c in BLANKS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = docs.select(
        F.col("doc_id"),
        F.col(host).alias("host"),
        flat.alias("flat"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.when(F.contains(text, F.lit("\n")), lines).alias("l"),
    )
    d = d.select(
        "doc_id",
        "host",
        F.length(F.replace("flat", F.lit(" "))).cast("bigint").alias("word_chars"),
        "n_symbols",
        F.coalesce(F.size(F.col("l")) - F.size(F.array_distinct("l")), F.lit(0)).cast("bigint").alias("n_dup_lines"),
        F.array_remove(F.split("flat", " ", -1), "").alias("w"),
    )
    w = F.col("w")
    bits = F.length(F.bin(F.size(w)))
    three = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), bits).bitwiseOR(i.cast("bigint")))
    d = d.withColumn("n_words", F.size("w").cast("bigint")).withColumn("t", F.when(F.size(w) >= 4, F.sort_array(three)))
    d = d.withColumn("bits", bits).withColumn("p", _again(F.col("t"), F.col("bits"))).drop("t", "bits")
    first, second = (lambda x: F.shiftright(x, 31).cast("int")), (lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    alike = lambda x: (w[first(x)] == w[second(x)]) & (w[first(x) + 1] == w[second(x) + 1]) & (w[first(x) + 2] == w[second(x) + 2])
    d = d.withColumn("p", F.when(F.size("p") > 0, F.filter("p", alike))).drop("w")
    at = F.sort_array(F.array_union(F.transform("p", first), F.transform("p", second)))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
    )["n"]
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("p")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(base: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """host, n, failed, rate (shrunk), host_failed from rows of (host, base_failed).

    The prior beta(a, b) has the mean m and the variance v of the hosts' raw rates: a + b = m (1 - m) / v - 1. Where v is 0 or
    too large for a beta distribution, a + b is 1.
    """
    hosts = base.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    raw = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(raw), F.var_pop(raw)).first()  # two numbers
    if m is None:
        m, v = 0.0, 0.0
    ab = m * (1 - m) / v - 1 if v > 0 and m * (1 - m) / v > 1 else 1.0
    rate = (F.col("failed") + F.lit(m) * F.lit(ab)) / (F.col("n") + F.lit(ab))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > host_limit).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rate (null without a host) and kept of every document."""
    base = cut(counts(docs, host).withColumn("base_failed", base_failed()))
    verdicts = cut(host_verdicts(base, host_limit))
    return base.join(verdicts.select("host", F.col("rate").alias("host_rate"), "host_failed"), "host", "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    )

"""Map-reduce over groups: an extractor reads each group's context, relevant conclusions are numbered and reduced."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAPPED = "relevant boolean, answer string, evidence string, citations array<int>"


def extractive(terms: list[str]) -> Callable[[list[str]], dict]:
    """The default extractor: the line with most query terms, from the first passage that has it."""

    def extract(passages: list[str]) -> dict:
        best = (0, 0, "")
        for k, p in enumerate(passages):
            for line in p.split("\n"):
                n = sum(t in line.lower() for t in terms)
                if n > best[0]:
                    best = (n, k + 1, line)
        return {"relevant": best[0] > 0, "answer": best[2], "evidence": best[2][:200], "citations": [best[1]] if best[0] else []}

    return extract


def map_groups(rows: DataFrame, group: str, extractor: Callable[[list[str]], dict], order: str = "rank", text: str = "text", each: int = 1000) -> DataFrame:
    """group, state, relevant, answer, evidence, citations: one row a group, whatever happens to it. A group has the k passages of its search."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        passages = [t[:each] for t in pdf[text] if t]
        out = {"relevant": False, "answer": "", "evidence": "", "citations": []}
        state = "empty"
        if passages:
            try:
                out |= extractor(passages)
                state = "relevant" if out["relevant"] and out["answer"] else "irrelevant"
            except Exception:  # one group's failure is its own state
                state = "error"
        return pd.DataFrame([{group: pdf[group].iloc[0], "state": state, **out}])

    kind = dict(rows.dtypes)[group]
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, state string, {MAPPED}")


def reduce_groups(mapped: DataFrame, group: str) -> DataFrame:
    """One row: how many groups there are in each state, and the relevant conclusions, numbered in the groups' order."""
    good = F.when((F.col("state") == "relevant"), F.struct(F.col(group).cast("string").alias("g"), F.col("answer").alias("a")))
    listed = F.sort_array(F.collect_list(good))
    text = F.array_join(F.transform(listed, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["g"], F.lit(": "), x["a"])), "\n")
    counts = [F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("relevant", "irrelevant", "empty", "error")]
    return mapped.agg(*counts, F.when(F.size(listed) > 0, text).otherwise("nothing relevant").alias("conclusions"))


def numbered(mapped: DataFrame, group: str) -> DataFrame:
    """Relevant groups with the number they are cited by."""
    return mapped.where("state = 'relevant'").withColumn("number", F.row_number().over(W.orderBy(group)).cast("bigint"))

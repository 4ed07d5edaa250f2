"""Which documents a run works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chosen(df: DataFrame, key: str, order: str, only: list | None = None, resume_from=None, most: int | None = None) -> DataFrame:
    """The stated documents, from one document on in ``order``, the first ``most``."""
    if only is not None:
        df = df.where(F.col(key).isin(only))
    if resume_from is not None:
        at = df.where(F.col(key) == resume_from).agg(F.min(order).alias("_from"))  # one row
        df = df.join(F.broadcast(at)).where(F.col(order) >= F.col("_from")).drop("_from")
    return df if most is None else df.orderBy(order).limit(most)


def with_artifact(df: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    return df.join(artifacts.select(key), key, "left_semi")

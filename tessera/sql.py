"""The engine's functions under SQL names, and tables as views."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.functions import plugins
from tessera.session import table

#: SQL macros: the same expressions as functions/text.py and functions/vectors.py, for plain SQL.
FUNCTIONS = {
    "tess_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), double(0), (s, x) -> s + x)",
    "tess_norm(s STRING) RETURNS STRING": r"regexp_replace(coalesce(s, ''), '(?U)[\\s　|]+', '')",
    "tess_canon(s STRING) RETURNS STRING": r"regexp_replace(regexp_replace(coalesce(s, ''), '(?U)[\\s　]+', ''), '(?U)\\d+', '#')",
    "tess_tokens(s STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(coalesce(s, '')), '[\\p{L}\\p{N}]{2,}', 0)",
    "tess_rrf(v BIGINT, b BIGINT) RETURNS DOUBLE": "1.0D / (60 + v) + 1.0D / (60 + b)",
    "tess_idf(n BIGINT, df BIGINT) RETURNS DOUBLE": "ln(1 + (n - df + 0.5D) / (df + 0.5D))",
}


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    encode = plugins.hashing_encoder()

    @F.pandas_udf(t.ArrayType(t.FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        return pd.Series(encode(s.fillna("").tolist()).tolist())

    spark.udf.register("tess_embed", embed)

    @F.udtf(returnType="piece int, text string")
    class Windows:
        """Windows of ``size`` characters, ``step`` apart."""

        def eval(self, text: str, size: int, step: int):
            for k in range(math.ceil(len(text or "") / step)):
                yield k, text[k * step : k * step + size]

    spark.udtf.register("tess_windows", Windows)
    for name in ("documents", "embeddings", "pages", "conversations", "events", "orders", "customer") if sf_dir else ():
        table(spark, sf_dir, name).createOrReplaceTempView(name)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SCHEMA, corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src%d" % (k % 3) if k % 7 else None, 0) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns that operators might use themselves, before and after the ones they need."""
    from pyspark.sql import functions as F

    names = ["row", "n", "block", "node", "key", "bucket", "part", "start", "length", "host", "w", "score", "x", "kept", "n_lines", "n_dropped", "batch"]
    return docs.select(*[F.lit("extra").alias(c) for c in names[:8]], "*", *[F.lit(1).alias(c) for c in names[8:]])

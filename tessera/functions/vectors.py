"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    n = l2(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(l2(a) * l2(b), F.lit(1e-12))


def preview(a, n: int, places: int = 4) -> Column:
    return F.transform(F.slice(a, 1, n), lambda x: F.round(x.cast("double"), places))

"""Expressions over ``array<double>`` columns.

A shorter vector counts as padded with zeros on the right, as the null-filling of ``zip_with``
gives for free.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least divisor of a normalisation: zero vectors stay zero.
FLOOR = 1e-12


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) * F.coalesce(y, zero)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def normalized(v: Column, length: Column) -> Column:
    """``v`` over its ``length``, a column computed once beside it."""
    return F.transform(v, lambda x: x / F.greatest(length, F.lit(FLOOR)))


def minus(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) - F.coalesce(y, zero))


def padded(v: Column, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(size - F.size(v), F.lit(0))))


def squared_distance(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x, zero) - F.coalesce(y, zero), F.lit(2.0))))


def score(distance: Column, metric: str) -> Column:
    """Similarity of a stored distance: ``1 - d`` for cosine, ``-d`` for squared L2."""
    return 1 - distance if metric == "cosine" else -distance

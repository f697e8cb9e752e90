"""Samples that two engines can agree on: rows in the order of a salted hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def salted(key: Column | str, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_points(points: DataFrame, n: int | None, seed: int, key: str = "id") -> DataFrame:
    """At most ``n`` rows without replacement; all of them if ``n`` is None or not positive."""
    if n is None or n <= 0:
        return points
    return points.orderBy(salted(key, seed), key).limit(n)


def sample_pair(left: DataFrame, right: DataFrame, n: int | None, seed: int, key: str = "id") -> tuple[DataFrame, DataFrame, bool]:
    """The same ids of both sides if these are equally many, else independent samples.

    The flag says whether rows still correspond.
    """
    paired = left.count() == right.count()
    return sample_points(left, n, seed, key), sample_points(right, n, seed if paired else seed + 1, key), paired


def sample_same_count(left: DataFrame, right: DataFrame, n: int, seed: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Equally many rows of both sides, drawn independently."""
    size = min(left.count(), right.count())
    size = min(size, n) if n > 0 else size
    return sample_points(left, size, seed, key), sample_points(right, size, seed + 1, key)


def first_n(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The rows at the first ``n`` places of a dense, zero-based order."""
    return rows.filter(F.col(order) < n)


def random_centroids(points: DataFrame, k: int, seed: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """``centroid_id, vec`` of ``k`` sampled points, numbered in the order of their keys."""
    picked = sample_points(points, k, seed, key).select(key, vec)
    if picked.count() < k:
        raise ValueError(f"fewer vectors than k={k}")
    # k rows, so one task may order them.
    return picked.select((F.row_number().over(W.orderBy(key)) - 1).alias("centroid_id"), vec)


def unpaired_split(left: DataFrame, right: DataFrame, holdout: int, order: str = "id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Training halves that share no row, and the held-out pairs.

    Of the first ``n`` rows, all but ``holdout``, the left side gives its first half and the right
    side its second one. ``order`` must count both sides' rows from 0.
    """
    n = min(left.count(), right.count()) - holdout
    if n < 2:
        raise ValueError("holdout leaves no training rows")
    half = n // 2
    here = F.col(order)
    return left.filter(here < half), right.filter((here >= half) & (here < n)), left.filter(here >= n), right.filter(here >= n)

"""Preprocessing of vectors: raw, unit length, or centred and then of unit length."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.functions import vectors as V


def mean_vector(points: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: the mean of all vectors."""
    return points.agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))).alias("mean"))


def of_unit_length(points: DataFrame, vec: str = "vec") -> DataFrame:
    columns = points.columns
    return (
        points.withColumn(vec, V.doubles(vec)).withColumn("_length", V.norm(F.col(vec)))
        .withColumn(vec, V.normalized(F.col(vec), F.col("_length"))).select(*columns)
    )


def preprocessed(points: DataFrame, mode: str, vec: str = "vec") -> DataFrame:
    """``raw``, ``l2`` or ``center_l2``; the mean is one row of the vectors' size, and is broadcast."""
    if mode == "raw":
        return points
    if mode == "l2":
        return of_unit_length(points, vec)
    if mode == "center_l2":
        columns = points.columns
        centred = points.crossJoin(F.broadcast(mean_vector(points, vec))).withColumn(vec, V.minus(V.doubles(vec), F.col("mean")))
        return of_unit_length(centred.select(*columns), vec)
    raise ValueError(f"unknown mode {mode}")


def padded_pair(left: DataFrame, right: DataFrame, vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Both sides with vectors as long as the longest."""
    size = max(d.agg(F.coalesce(F.max(F.size(vec)), F.lit(0))).first()[0] for d in (left, right))
    return tuple(d.withColumn(vec, V.padded(V.doubles(vec), size)) for d in (left, right))

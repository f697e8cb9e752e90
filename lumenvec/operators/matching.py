"""One-to-one matching of a small set of centroids to a larger one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenvec.functions import vectors as V
from lumenvec.operators.blocks import small_matrix, unit
from lumenvec.operators.solvers import hungarian


#: Centroids that may be broadcast.
MOST_CENTROIDS = 20_000


def match_candidates(small: DataFrame, large: DataFrame) -> DataFrame:
    """Every pair of centroids ``(centroid_id, vec)`` with its cosine, competition rank and gap.

    Both are centroid tables, of a size the caller chose; the smaller is broadcast after a check.
    """
    if small.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} small centroids")
    s = small.select(F.col("centroid_id").alias("small_index"), V.doubles("vec").alias("_s")).withColumn("_sn", V.norm(F.col("_s")))
    t = large.select(F.col("centroid_id").alias("large_index"), V.doubles("vec").alias("_t")).withColumn("_tn", V.norm(F.col("_t")))
    cosine = V.dot(F.col("_s"), F.col("_t")) / (F.greatest("_sn", F.lit(V.FLOOR)) * F.greatest("_tn", F.lit(V.FLOOR)))
    pairs = t.crossJoin(F.broadcast(s)).select("small_index", "large_index", cosine.alias("cosine_similarity"))
    each = W.partitionBy("small_index")
    best = F.max(F.struct("cosine_similarity", (-F.col("large_index")).alias("_back"))).over(each)
    return (
        pairs.withColumn("rank_in_small_to_large", F.rank().over(each.orderBy(F.desc("cosine_similarity"))).cast("int"))
        .withColumn("_best", best)
        .withColumn("best_large_index_for_small", -F.col("_best._back"))
        .withColumn("best_cosine_for_small", F.col("_best.cosine_similarity"))
        .withColumn("gap_to_best", F.col("best_cosine_for_small") - F.col("cosine_similarity"))
        .drop("_best")
    )


def match_centroids(small: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of ``match_candidates`` in the assignment of largest total cosine.

    The optimum needs the whole matrix, of k by k values, in one place: the driver.
    """
    sid, s = small_matrix(small, "centroid_id", "vec")
    lid, t = small_matrix(large, "centroid_id", "vec")
    if len(lid) < len(sid):
        raise ValueError("fewer large than small centroids")
    if s.shape[1] != t.shape[1]:
        raise ValueError("centroids of different dimension")
    chosen = hungarian(-(unit(s) @ unit(t).T))
    pairs = small.sparkSession.createDataFrame([(int(i), int(lid[c])) for i, c in zip(sid, chosen, strict=True)], "small_index int, large_index int")
    return match_candidates(small, large).join(F.broadcast(pairs), ["small_index", "large_index"])


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count("*").alias("num_pairs"), F.countDistinct("large_index").alias("unique_large_indices"),
        F.avg("cosine_similarity").alias("mean_cosine_similarity"), F.min("cosine_similarity").alias("min_cosine_similarity"),
    )


def profile(points: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Cosines of points to anchors; a zero vector has none (NaN)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return (points / np.linalg.norm(points, axis=1)[:, None]) @ (anchors / np.linalg.norm(anchors, axis=1)[:, None]).T

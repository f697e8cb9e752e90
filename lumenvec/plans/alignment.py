"""Alignment of two unpaired embedding spaces by a linear map.

The long tables stay in Spark: clustering passes, similarity profiles and neighbour joins are scans;
centroids, kernels and the d x d map are small and live on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.operators.blocks import apply_map, cross_gram, knn, small_matrix
from lumenvec.operators.cluster import KMeansVec, cluster_embeddings, group_means, spread_centroids
from lumenvec.operators.matching import profile
from lumenvec.operators.order import checkpointed
from lumenvec.operators.metrics import paired_cosine_mean, retrieval_top1_rank
from lumenvec.operators.sampling import sample_points
from lumenvec.operators.solvers import lloyd, procrustes, quadratic_assignment


@dataclass
class Alignment:
    w: np.ndarray
    initial_cosine: float
    refine1_cosine: list[float] = field(default_factory=list)
    refine2_cosine: float | None = None
    top1: float | None = None
    avg_rank: float | None = None

    @property
    def orthogonality_error(self) -> float:
        """Blending leaves the orthogonal group; by how much."""
        return float(np.abs(self.w.T @ self.w - np.eye(len(self.w))).max())


def centred_gram(x: np.ndarray) -> np.ndarray:
    """``H X X^T H``, by centring the vectors first."""
    x = x - x.mean(0)
    return x @ x.T


def anchors(left: DataFrame, right: DataFrame, clusters: int, qap_runs: int, subsample: int | None, seed: int, iters: int = 10, n_init: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both sides, the right ones in the order that best matches the left's geometry.

    Of ``n_init`` clusterings of each side's sample, drawn once, the one with the least loss counts.
    A sample of bounded size is clustered on the driver, whole sides (``subsample`` None) in Spark.
    """
    found = []
    for side, salt in ((left, seed), (right, seed + 1)):
        points = sample_points(side.select("id", "vec"), subsample, salt)
        if subsample is None:
            found.append(cluster_embeddings(points, clusters, "raw", n_init, iters, salt)[0].centroids)
        else:
            found.append(lloyd(small_matrix(points, "id", "vec")[1], clusters, iters, n_init, salt)[0])
    a, b = found
    order, _ = quadratic_assignment(centred_gram(a), centred_gram(b), qap_runs, seed)
    return a, b[order]


def mean_match(neighbours: DataFrame, right: DataFrame) -> DataFrame:
    """``id, vec``: the mean vector of each point's neighbours ``(id, other_id)``."""
    found = neighbours.join(right.select(F.col("id").alias("other_id"), "vec"), "other_id")
    return group_means(found, "id").select("id", "vec")


def _profiles(points: DataFrame, anchor: np.ndarray) -> DataFrame:
    """``id, vec``: cosines to the anchors, a matrix product for each batch."""
    from lumenvec.operators.prepare import of_unit_length

    return apply_map(of_unit_length(points.select("id", "vec")), profile(np.eye(anchor.shape[1]), anchor))


def _cosine(left: DataFrame, right: DataFrame, w: np.ndarray) -> float:
    return paired_cosine_mean(apply_map(left.select("id", "vec"), w), right).first()[0]


def fit_alignment(
    left: DataFrame, right: DataFrame, eval_left: DataFrame, eval_right: DataFrame, *, num_anchor_runs: int = 30, qap_runs: int = 30,
    num_clusters: int = 20, anchor_subsample: int | None = 10_000, initial_k: int = 50, refine_iters: int = 100, refine_sample: int = 10_000,
    refine_k: int = 50, refine2_clusters: int = 500, alpha: float = 0.5, seed: int = 0, n_init: int = 10,
) -> Alignment:
    """Map ``W`` from the left to the right space, from sides ``(id, vec)`` that share no pair.

    Anchors by clustering and quadratic assignment; a first map from points whose similarity
    profiles to the anchors are alike; refinement by neighbours; correction by matched clusters.
    """
    pairs = [anchors(left, right, num_clusters, qap_runs, anchor_subsample, seed + run, n_init=n_init) for run in range(num_anchor_runs)]
    a, b = (np.concatenate([p[side] for p in pairs]) for side in (0, 1))
    near = knn(_profiles(left, a), _profiles(right, b), initial_k)
    w = procrustes(cross_gram(left, mean_match(near, right)))
    out = Alignment(w, _cosine(eval_left, eval_right, w))
    for turn in range(refine_iters):
        sample = checkpointed(sample_points(left.select("id", "vec"), refine_sample, seed + turn))
        near = knn(apply_map(sample, w), right, refine_k)
        w = (1 - alpha) * w + alpha * procrustes(cross_gram(sample, mean_match(near, right)))
        out.refine1_cosine.append(_cosine(eval_left, eval_right, w))
    if refine2_clusters:
        c = KMeansVec(refine2_clusters, 10, "l2", seed, "reinit").fit(left, spread_centroids(left, refine2_clusters, seed)).centroids
        d = KMeansVec(refine2_clusters, 10, "l2", seed).fit(right, c @ w).centroids
        w = (1 - alpha) * w + alpha * procrustes(c.T @ d)
        out.refine2_cosine = _cosine(eval_left, eval_right, w)
    out.w = w
    r = retrieval_top1_rank(apply_map(eval_left.select("id", "vec"), w), eval_right).first()
    out.top1, out.avg_rank = r["top1"], r["avg_rank"]
    return out



"""Lloyd clustering of a table of vectors, spherical or Euclidean.

Each pass is one scan with the centroids sent along and one aggregation to k rows, so lineage does
not grow: only the k x d centroids live on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.functions import vectors as V
from lumenvec.operators.blocks import assign_to, matrix, nearest, small_matrix, unit
from lumenvec.operators.order import checkpointed
from lumenvec.operators.sampling import random_centroids, sample_points
from lumenvec.operators.solvers import spread

RESEED = 10_000


@dataclass
class Fitted:
    """Centroids, one log row for each pass, and the counts of the last pass.

    Counts and loss of a pass belong to the assignment made before its update.
    """

    ids: np.ndarray
    centroids: np.ndarray
    metric: str
    log: list[dict] = field(default_factory=list)
    train_counts: np.ndarray | None = None

    def assign(self, points: DataFrame, vec: str = "vec") -> DataFrame:
        return assign_to(points, self.ids, self.centroids, self.metric, vec)

    def frame(self, spark) -> DataFrame:
        rows = [(int(i), [float(x) for x in c]) for i, c in zip(self.ids, self.centroids, strict=True)]
        return spark.createDataFrame(rows, "centroid_id int, vec array<double>")


def group_means(points: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """``key, vec, n``: the mean vector of each group, with partial sums before the shuffle."""
    return (
        points.groupBy(key)
        .agg(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("_mean"), F.count("*").alias("n"))
        .select(key, vector_to_array("_mean").alias(vec), "n")
    )


def _sums(rows: DataFrame, c: np.ndarray, metric: str) -> DataFrame:
    """``c, n, loss, total`` of the assignment of ``rows (vec)`` to centroids: of a task's points k sums leave it."""
    sent = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        total, counts, loss = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
        for batch in batches:
            x = matrix(batch.column(0), c.shape[1])
            label, distance = nearest(x, c, metric)
            order = np.argsort(label, kind="stable")
            seen, starts = np.unique(label[order], return_index=True)
            total[seen] += np.add.reduceat(x[order], starts) if len(seen) else 0
            counts += np.bincount(label, minlength=len(c))
            loss += np.bincount(label, distance, len(c))
        seen = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(seen) * c.shape[1] + 1, max(1, c.shape[1]), dtype=np.int32)), pa.array(total[seen].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen]), pa.array(loss[seen]), lists], ["c", "n", "loss", "x"])

    parts = rows.mapInArrow(run, "c int, n long, loss double, x array<double>")
    return parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), Summarizer.sum(array_to_vector("x")).alias("total"))


@dataclass
class KMeansVec:
    """Lloyd's iterations from given or sampled centroids.

    metric: ``cosine`` (points and centroids of unit length), ``l2``, or ``ip`` (largest inner product,
    nothing scaled). empty_cluster_policy: ``keep`` the old centroid, or ``reinit`` from a salted
    sample. Training takes at most ``points_per_centroid`` times k points, if that is given, by a
    salted sample; all of them otherwise.
    """

    k: int
    num_iters: int = 20
    metric: str = "cosine"
    seed: int = 0
    empty_cluster_policy: str = "keep"
    key: str = "id"
    vec: str = "vec"
    points_per_centroid: int | None = None

    def __post_init__(self):
        if self.num_iters < 1:
            raise ValueError("num_iters must be at least 1")
        if self.metric not in ("cosine", "l2", "ip"):
            raise ValueError(f"unknown metric {self.metric}")
        if self.empty_cluster_policy not in ("keep", "reinit"):
            raise ValueError(f"unknown policy {self.empty_cluster_policy}")

    def fit(self, points: DataFrame, init_centroids: DataFrame | np.ndarray | None = None) -> Fitted:
        metric = self.metric
        if self.points_per_centroid is not None:
            points = checkpointed(sample_points(points, self.points_per_centroid * self.k, self.seed, self.key))
        if init_centroids is None:
            init_centroids = random_centroids(points, self.k, self.seed, self.key, self.vec).withColumnRenamed(self.vec, "vec")
        if isinstance(init_centroids, np.ndarray):
            ids, c = np.arange(len(init_centroids)), init_centroids.astype(float)
        else:
            ids, c = small_matrix(init_centroids, "centroid_id", "vec")
        if len(ids) != self.k:
            raise ValueError(f"{len(ids)} centroids given for k={self.k}")
        rows = points.select(self.key, F.col(self.vec).cast("array<double>").alias(self.vec))
        if metric == "cosine":
            c = unit(c)
            rows = rows.withColumn("_length", V.norm(F.col(self.vec))).withColumn(self.vec, V.normalized(F.col(self.vec), F.col("_length"))).drop("_length")
        fitted = Fitted(ids, c, metric)
        for turn in range(self.num_iters):
            counts = np.zeros(len(ids), np.int64)
            new, loss = c.copy(), 0.0
            for r in _sums(rows.select(self.vec), c, metric).collect():  # k rows at most
                at = r["c"]
                counts[at], loss = r["n"], loss + r["loss"]
                new[at] = r["total"].toArray() / r["n"]
            empty = np.flatnonzero(counts == 0)
            if len(empty) and self.empty_cluster_policy == "reinit":
                _, spare = small_matrix(sample_points(rows, len(empty), self.seed + RESEED + turn, self.key), self.key, self.vec)
                new[empty[: len(spare)]] = spare[: len(empty)]
            if metric == "cosine":
                new = unit(new)
            fitted.log.append({
                "iter": turn + 1, "num_vectors": int(counts.sum()), "avg_loss": loss / max(1, counts.sum()),
                "centroid_shift_mean": float(np.linalg.norm(new - c, axis=1).mean()), "num_empty_clusters": len(empty),
                "min_cluster_count": int(counts.min()), "max_cluster_count": int(counts.max()), "mean_cluster_count": float(counts.mean()),
            })
            c = new
        fitted.centroids, fitted.train_counts = c, counts
        return fitted


def spread_centroids(points: DataFrame, k: int, seed: int, key: str = "id", vec: str = "vec", per_centroid: int = 64) -> np.ndarray:
    """Starting centroids far from each other, chosen among a sample of ``per_centroid * k`` points.

    Each next one is the best of a few candidates drawn by squared distance to those chosen.
    """
    _, x = small_matrix(sample_points(points.select(key, vec), per_centroid * k, seed, key), key, vec)
    if len(x) < k:
        raise ValueError(f"fewer vectors than k={k}")
    return spread(x, k, np.random.default_rng(seed))


def cluster_counts(assignments: DataFrame, k: int) -> DataFrame:
    """``cluster_id, cnt`` of all k clusters, the empty ones with 0."""
    found = assignments.groupBy("cluster_id").agg(F.count("*").alias("cnt"))
    every = assignments.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(found, "cluster_id", "left").select("cluster_id", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def cluster_embeddings(points: DataFrame, k: int, preprocess: str = "raw", n_init: int = 10, max_iter: int = 100, seed: int = 0, key: str = "id") -> tuple[Fitted, np.ndarray]:
    """Best of ``n_init`` runs by loss, on preprocessed vectors; and its centroids of unit length.

    Labels come from the centroids before that normalisation.
    """
    from lumenvec.operators.prepare import preprocessed

    rows = checkpointed(preprocessed(points, preprocess).select(key, "vec"))  # read by every pass of every run
    if rows.count() < k:
        raise ValueError(f"fewer vectors than k={k}")
    best = None
    for run in range(n_init):
        fitted = KMeansVec(k, max_iter, "l2", seed + run, "reinit", key).fit(rows, spread_centroids(rows, k, seed + run, key))
        if best is None or fitted.log[-1]["avg_loss"] < best.log[-1]["avg_loss"]:
            best = fitted
    return best, unit(best.centroids)

"""Members of clusters by score, clusters of an image, and similarity maps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenvec.functions import images as I
from lumenvec.functions import vectors as V
from lumenvec.operators.blocks import DISTANCE_BLOCK, matrix, small_matrix, unit


def parse_clusters(text: str, k: int) -> list[int]:
    """``all``, or ids and inclusive ranges between commas: sorted, each once, all below k."""
    if text.strip().lower() == "all":
        return list(range(k))
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, dash, last = part.partition("-")
        found |= set(range(int(first), int(last) + 1)) if dash else {int(first)}
    if not found or min(found) < 0 or max(found) >= k:
        raise ValueError(f"clusters must be within 0..{k - 1}")
    return sorted(found)


def _scored(assignments: DataFrame, clusters: list[int] | None, metric: str) -> DataFrame:
    rows = assignments if clusters is None else assignments.filter(F.col("cluster_id").isin(clusters))
    return rows.withColumn("score", V.score(F.col("distance"), metric))


def _placed(rows: DataFrame, images: DataFrame, grid_width: int) -> DataFrame:
    """Patch rows with their place in the grid and their image's name; absent images give nulls."""
    names = images.select(F.col("index").alias("image_index"), "file_name", F.col("path").alias("image_path"))
    return (
        rows.join(names, "image_index", "left")
        .withColumn("patch_row", I.row_of(F.col("patch_index"), grid_width))
        .withColumn("patch_col", I.column_of(F.col("patch_index"), grid_width))
    )


TOP = ["cluster_id", "rank", "score", "distance", "image_index", "patch_index", "patch_row", "patch_col", "file_name", "image_path"]


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def topk_per_cluster(assignments: DataFrame, images: DataFrame, k: int, grid_width: int, clusters: list[int] | None = None, metric: str = "cosine") -> DataFrame:
    """The k best patches of each cluster; ties by image and patch.

    Spark keeps k rows of each cluster in every task before the shuffle (window group limit), so a
    large cluster does not gather in one.
    """
    best = _best(_scored(assignments, clusters, metric), k, F.desc("score"), F.asc("image_index"), F.asc("patch_index"))
    return _placed(best, images, grid_width).select(*TOP)


def top_bottom_per_cluster(assignments: DataFrame, images: DataFrame, k: int, grid_width: int, clusters: list[int] | None = None, metric: str = "cosine", chunk_images: int = 128) -> DataFrame:
    """The k best and k worst patches of each cluster, told apart by ``group``.

    Ties among the worst: the earlier chunk of ``chunk_images`` images first, within it the later row.
    """
    rows = _scored(assignments, clusters, metric)
    top = _best(rows, k, F.desc("score"), F.asc("image_index"), F.asc("patch_index")).withColumn("group", F.lit("most_similar"))
    chunk = F.floor(F.col("image_index") / chunk_images)
    low = _best(rows, k, F.asc("score"), chunk.asc(), F.desc("image_index"), F.desc("patch_index")).withColumn("group", F.lit("least_similar"))
    return _placed(top.unionByName(low), images, grid_width).select("group", *TOP)


def find_image(images: DataFrame, name: str | None = None, index: int | None = None) -> DataFrame:
    """The one image of this index or base name; raises if there is none or more than one."""
    if (name is None) == (index is None):
        raise ValueError("give a name or an index")
    same = F.col("index") == index if name is None else I.base_name(F.col("file_name")) == name.rsplit("/", 1)[-1]
    found = images.filter(same)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} image {name if name is not None else index}")
    return found


def image_patch_rows(assignments: DataFrame, image_index: int, grid_width: int, metric: str = "cosine") -> DataFrame:
    """Patches of an image with cluster and distance; the similarity only where it is a cosine.

    Distances may not have been stored: without the column they are null.
    """
    if "distance" not in assignments.columns:
        assignments = assignments.withColumn("distance", F.lit(None).cast("double"))
    similarity = 1 - F.col("distance") if metric == "cosine" else F.lit(None).cast("double")
    return assignments.filter(F.col("image_index") == image_index).select(
        "patch_index", I.row_of(F.col("patch_index"), grid_width).alias("patch_row"),
        I.column_of(F.col("patch_index"), grid_width).alias("patch_col"), "cluster_id", "distance", similarity.alias("cosine_similarity"),
    )


def image_cluster_summary(assignments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, share and distances of each cluster in an image (or each of ``by``)."""
    by = by or ["image_index"]
    return (
        assignments.groupBy(*by, "cluster_id")
        .agg(F.count("*").alias("patch_count"), F.avg("distance").alias("mean_distance"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
        .withColumn("patch_ratio", F.col("patch_count") / F.sum("patch_count").over(W.partitionBy(*by)))
        .withColumn("mean_cosine_similarity", 1 - F.col("mean_distance"))
    )


def patch_grid(assignments: DataFrame, image_index: int, grid_width: int) -> DataFrame:
    """Cluster ids of an image as a grid: a row for each patch row, a column for each patch column."""
    rows = image_patch_rows(assignments, image_index, grid_width)
    return rows.groupBy("patch_row").pivot("patch_col", list(range(grid_width))).agg(F.first("cluster_id")).select(
        "patch_row", *[F.col(str(c)).alias(f"c{c}") for c in range(grid_width)]
    )


def similarity_map(patches: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """``image_index, patch_index, centroid_id, value``: similarity scaled to 0..1 over each image.

    A pass over the patches with the centroids sent along, as in an assignment.
    """
    ids, c = small_matrix(centroids, "centroid_id", "vec")
    sent = patches.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            step = max(1, DISTANCE_BLOCK // max(1, len(c)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(part.column(2), c.shape[1])
                raw = unit(x) @ unit(c).T if metric == "cosine" else -((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T)
                columns = [np.repeat(part.column(k).to_numpy(), len(c)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.tile(ids.astype(np.int32), len(x))), pa.array(raw.ravel())], ["image_index", "patch_index", "centroid_id", "raw"])

    rows = patches.select(F.col("image_index").cast("long"), F.col("patch_index").cast("int"), V.doubles("vec").alias("vec")).mapInArrow(
        run, "image_index long, patch_index int, centroid_id int, raw double"
    )
    over = W.partitionBy("image_index", "centroid_id")
    return (
        rows.withColumn("low", F.min("raw").over(over)).withColumn("high", F.max("raw").over(over))
        .select("image_index", "patch_index", "centroid_id", ((F.col("raw") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(V.FLOOR))).alias("value"))
    )


def collage_places(rows: DataFrame, columns: int, rank: str = "rank") -> DataFrame:
    """Where each ranked item stands in a collage of so many columns."""
    at = F.col(rank) - 1
    return rows.withColumn("tile_row", F.floor(at / columns).cast("int")).withColumn("tile_col", F.pmod(at, F.lit(columns)).cast("int"))


def rendered_places(rows: DataFrame, columns: int) -> DataFrame:
    """Places in a collage of each cluster's ``rows (cluster_id, rank)`` that there are, close together."""
    at = F.row_number().over(W.partitionBy("cluster_id").orderBy("rank")) - 1
    return rows.withColumn("_at", at).withColumn("tile_row", F.floor(F.col("_at") / columns).cast("int")).withColumn("tile_col", F.pmod("_at", F.lit(columns)).cast("int")).drop("_at")

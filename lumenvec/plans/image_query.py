"""Clusters of one image for several cluster counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenvec.operators.retrieval import find_image, image_cluster_summary, image_patch_rows


def parse_k_values(text: str, assignments: DataFrame) -> list[int]:
    """``all`` for every ``k`` in the table, or numbers between commas: sorted, each once."""
    if text.strip().lower() == "all":
        found = [r["k"] for r in assignments.select("k").distinct().collect()]
    else:
        found = [int(p) for p in text.split(",") if p.strip()]
    if not found:
        raise ValueError("no k")
    return sorted(set(found))


@dataclass
class ImageClusters:
    """Patches, summaries by k, and the largest clusters of each k."""

    rows: DataFrame
    summary: DataFrame
    index: DataFrame


def image_clusters(
    assignments: DataFrame, images: DataFrame, grid: tuple[int, int] = (32, 32), name: str | None = None, image_index: int | None = None, k_values: str = "all", top: int = 10
) -> ImageClusters:
    """Query an image by base name or index in ``assignments (k, image_index, patch_index, cluster_id, distance)``.

    Raises if the image is unknown or ambiguous, or if some k lacks a patch of the grid.
    """
    index = find_image(images, name, image_index).first()["index"]
    wanted = parse_k_values(k_values, assignments)
    own = assignments.filter((F.col("image_index") == index) & F.col("k").isin(wanted))
    counts = {r["k"]: r["count"] for r in own.groupBy("k").count().collect()}
    for k in wanted:
        if counts.get(k, 0) != grid[0] * grid[1]:
            raise ValueError(f"k={k}: {counts.get(k, 0)} patches for a grid of {grid[0]} x {grid[1]}")
    rows = None
    for k in wanted:
        part = image_patch_rows(own.filter(F.col("k") == k), index, grid[1]).select(F.lit(k).alias("k"), "*")
        rows = part if rows is None else rows.unionByName(part)
    summary = image_cluster_summary(own, ["k"])
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.desc("patch_count"), "cluster_id"))
    largest = summary.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ImageClusters(rows, summary, largest)

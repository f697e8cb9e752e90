"""Writers of patch shards, assignments, pooled features, centroids and maps as files of arrays.

Arrays of known shape are laid out once; then every task writes its own rows at their places through a
memory map, so the order of rows doesn't matter and a task that runs again writes the same bytes. The
folder must be mounted where tasks run.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions import images as I
from lumenvec.operators.blocks import matrix, small_matrix, unit
from lumenvec.sources import tensors
from lumenvec.sources.arrays import load_shards
from lumenvec.sources.files import write_json


def label_dtype(k: int) -> np.dtype:
    """The narrowest unsigned type that assignments to ``k`` clusters are stored in: 16 or 32 bits."""
    return np.dtype(np.uint16 if k <= 65535 else np.uint32)


def absent(dtype: np.dtype) -> float:
    """What stands for an absent patch in an array of cluster ids, or of distances."""
    return np.iinfo(dtype).max if dtype.kind == "u" else np.nan


def _guarded(path: Path, overwrite: bool) -> None:
    if path.exists() and not overwrite:
        raise FileExistsError(f"{path} exists")
    path.parent.mkdir(parents=True, exist_ok=True)


def _done(written: DataFrame) -> int:
    """Run the writing tasks; the number of rows they wrote."""
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_shards(
    tokens: DataFrame, images: DataFrame, folder: str, shards: int, patches: int, width: int, strategy: str = "mod", dtype: str = "float16", overwrite: bool = False
) -> list[dict]:
    """Shard files, their metadata and a manifest of each, of ``tokens (image_index, patch_index, vec)``.

    ``images (index, ...)`` is the manifest, its index dense from 0; further columns, among them
    ``status`` where there is one, go to the shard manifests. Images without tokens stay zero; a byte
    beside each patch says which ones were there, as an image may have fewer than ``patches``.
    """
    total = images.count()
    of = I.mod_shard(F.col("index"), shards) if strategy == "mod" else I.contiguous_shard(F.col("index"), shards, total)
    counts = {r["s"]: r["n"] for r in images.groupBy(of.alias("s")).agg(F.count("*").alias("n")).collect()}
    starts = {s: total * s // shards for s in range(shards)}
    names = {s: f"shard_{s:03d}" for s in range(shards)}
    root = Path(folder)
    for s in range(shards):
        for path, size in ((root / f"{names[s]}.mmap", width * np.dtype(dtype).itemsize), (root / f"{names[s]}.present", 1)):
            _guarded(path, overwrite)
            with open(path, "wb") as out:
                out.truncate(counts.get(s, 0) * patches * size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            image, patch = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = matrix(batch.column(2), width).astype(dtype)
            shard = image % shards if strategy == "mod" else ((image + 1) * shards - 1) // total
            local = image // shards if strategy == "mod" else image - np.array([starts[s] for s in shard.tolist()], np.int64)
            for s in np.unique(shard).tolist():
                out = np.memmap(root / f"{names[s]}.mmap", mode="r+", dtype=dtype, shape=(counts[s], patches, width))
                at = shard == s
                there = np.memmap(root / f"{names[s]}.present", mode="r+", dtype=np.uint8, shape=(counts[s], patches))
                out[local[at], patch[at]], there[local[at], patch[at]] = x[at], 1
                out.flush()
                there.flush()
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    _done(tokens.select(F.col("image_index").cast("long"), F.col("patch_index").cast("int"), F.col("vec").cast("array<double>")).mapInArrow(run, "n long"))
    local = F.floor(F.col("index") / shards) if strategy == "mod" else F.col("index") - F.floor(F.lit(total) * of / shards)
    rows = images.withColumn("shard_id", of).withColumn("local_shard_index", local.cast("int"))
    rows.repartition("shard_id").sortWithinPartitions("shard_id", "local_shard_index").write.mode("overwrite").partitionBy("shard_id").json(f"{folder}/images")
    failed = failed_images(rows, ["shard_id"]) if "status" in images.columns else None
    bad = {r["shard_id"]: r["num_failed"] for r in failed.collect()} if failed is not None else {}
    found = []
    for s in range(shards):
        n = counts.get(s, 0)
        indices = list(range(s, total, shards)) if strategy == "mod" else list(range(starts[s], starts[s] + n))
        meta = {
            "shard_id": s, "num_shards": shards, "shard_strategy": strategy, "num_images": n, "global_indices": indices, "mmap_path": str(root / f"{names[s]}.mmap"),
            "present_path": str(root / f"{names[s]}.present"), "shape": [n, patches, width], "dtype": dtype, "num_failed_images": bad.get(s, 0),
        }
        write_json(meta, str(root / f"{names[s]}.json"))
        found.append(meta)
    (root / "done").write_text("done\n")
    return found


def failed_images(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``num_images, num_failed`` of manifest rows with ``status``."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("num_images"), F.count_if(F.col("status") != "ok").alias("num_failed"))


def shard_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``image_index, shard, local_row``: where each image's tokens lie, for a join on the index."""
    shards = [(k, list(map(int, s["indices"]))) for k, s in enumerate(load_shards(folder))]
    table = spark.createDataFrame(shards, "shard int, indices array<long>")
    return table.select("shard", F.posexplode("indices").alias("local_row", "image_index")).select("image_index", "shard", "local_row")


def write_assignments(assignments: DataFrame, folder: str, k: int, images: int, patches: int, distances: bool = False, overwrite: bool = False, metric: str = "cosine") -> dict:
    """Cluster ids (and distances) as arrays ``(images, patches)`` by global index, and their configuration.

    Patches that are absent have the largest number of the type, which is no cluster's, and distance NaN.
    """
    dtype, root = label_dtype(k), Path(folder)
    ids, far = root / f"patch_cluster_ids_k{k}_{dtype.name}.npy", root / f"patch_cluster_dist_k{k}_fp16.npy"
    for path, kind in ((ids, dtype), (far, np.dtype(np.float16)))[: 2 if distances else 1]:
        _guarded(path, overwrite)
        out = np.lib.format.open_memmap(path, mode="w+", dtype=kind, shape=(images, patches))
        out[...] = absent(kind)
        out.flush()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        labels = np.load(ids, mmap_mode="r+")
        dists = np.load(far, mmap_mode="r+") if distances else None
        for batch in batches:
            image, patch = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            labels[image, patch] = batch.column(2).to_numpy().astype(dtype)
            if dists is not None:
                dists[image, patch] = batch.column(3).to_numpy().astype(np.float16)
            n += batch.num_rows
        labels.flush()
        if dists is not None:
            dists.flush()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    columns = [F.col("image_index").cast("long"), F.col("patch_index").cast("int"), F.col("cluster_id").cast("int"), *([F.col("distance").cast("double")] if distances else [])]
    written = _done(assignments.select(*columns).mapInArrow(run, "n long"))
    config = {
        "k": k, "metric": metric, "ids_path": str(ids), "dist_path": str(far) if distances else None, "shape": [images, patches], "id_dtype": dtype.name,
        "distance_dtype": "float16" if distances else None, "total_vectors": written,
    }
    write_json(config, str(root / f"config_assignment_k{k}.json"))
    return config


def read_assignments(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """``k, image_index, patch_index, cluster_id, distance`` of the arrays of ``write_assignments``; null distances where none were stored, no row for absent patches."""

    def rows(path: Path, name: str, kind: str) -> DataFrame:
        found = tensors.read_tensor(spark, str(path)).select(F.col("id").alias("image_index"), F.posexplode("vec").alias("patch_index", "_x"))
        if kind == "int":
            found = found.filter(F.col("_x").cast("double") < float(absent(label_dtype(k))))
        return found.select("image_index", "patch_index", F.col("_x").cast(kind).alias(name))

    root = Path(folder)
    ids = rows(root / f"patch_cluster_ids_k{k}_{label_dtype(k).name}.npy", "cluster_id", "int")
    far = root / f"patch_cluster_dist_k{k}_fp16.npy"
    out = ids.join(rows(far, "distance", "double"), ["image_index", "patch_index"]) if far.exists() else ids.withColumn("distance", F.lit(None).cast("double"))
    return out.select(F.lit(k).alias("k"), "image_index", "patch_index", "cluster_id", "distance")


def write_image_means(tokens: DataFrame, images: DataFrame, path: str, normalize: bool = False, dtype: str = "float16", **notes) -> None:
    """Mean of each image's tokens as ``vision_feats``, with ``global_indices`` and ``file_names``, in a tensor file.

    One row an image; the table must pass the bound of small matrices. Keep larger ones as Parquet.
    """
    from lumenvec.operators.cluster import group_means

    means = group_means(tokens, "image_index").join(images.select(F.col("index").alias("image_index"), "file_name"), "image_index")
    ids, x = small_matrix(means, "image_index", "vec")
    names = {r[0]: r[1] for r in means.select("image_index", "file_name").collect()}
    x = unit(x) if normalize else x
    tensors.save({"vision_feats": x.astype(dtype), "global_indices": ids.astype(np.int64), "file_names": [names[i] for i in ids.tolist()], "normalized": normalize, **notes}, path)


def write_global_files(images: DataFrame, folder: str, patches: int, width: int, dtype: str = "float16", **notes) -> None:
    """``meta.json``, ``patch_tokens_shape.json`` and the manifest in order of its index."""
    n = images.count()
    write_json({"num_images": n, "num_patches_per_image": patches, "feature_dim": width, "feature_dtype": dtype, **notes}, f"{folder}/meta.json")
    write_json({"full_shape": [n, patches, width], "dtype": dtype}, f"{folder}/patch_tokens_shape.json")
    images.orderBy("index").write.mode("overwrite").json(f"{folder}/images")


def write_centroids(centroids: np.ndarray, folder: str, counts: np.ndarray | None = None) -> list[str]:
    """Centroids in single and half precision, and the clusters' counts."""
    root, k = Path(folder), len(centroids)
    root.mkdir(parents=True, exist_ok=True)
    found = {f"centroids_k{k}_fp32.npy": centroids.astype(np.float32), f"centroids_k{k}_fp16.npy": centroids.astype(np.float16)}
    if counts is not None:
        found[f"train_counts_k{k}.npy"] = counts.astype(np.int64)
    for name, x in found.items():
        np.save(root / name, x)
    return [str(root / name) for name in found]


def read_centroids(spark: SparkSession, path: str, metric: str = "l2", expected_k: int | None = None) -> DataFrame:
    """``centroid_id, vec`` in double precision, of unit length for cosines."""
    x = np.asarray(tensors.as_2d(tensors.pick(tensors.load(path), None, path), path).open(), float)
    if expected_k is not None and len(x) != expected_k:
        raise ValueError(f"{path}: {len(x)} centroids, not {expected_k}")
    x = unit(x) if metric == "cosine" else x
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "centroid_id int, vec array<double>")


def write_alignment(found, folder: str, name: str) -> None:
    """The map as a tensor file, and its history as JSON."""
    tensors.save(found.w.astype(np.float32), f"{folder}/W_{name}.pt")
    history = {"initial_cosine": found.initial_cosine, "refine1_cosine": found.refine1_cosine, "refine2_cosine": found.refine2_cosine, "top1": found.top1, "avg_rank": found.avg_rank}
    write_json(history, f"{folder}/result_{name}.json")


def read_map(path: str) -> np.ndarray:
    return np.asarray(tensors.as_2d(tensors.pick(tensors.load(path), None, path), path).open(), float)


def read_json_object(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)

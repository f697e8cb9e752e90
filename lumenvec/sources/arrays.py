"""Data sources of ``.npy`` matrices and of raw patch tensors in shards.

Both are read through memory maps on the executors, in ranges of rows or images, so the folder must
be mounted where tasks run; keep Parquet as the form that cluster jobs read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Range(InputPartition):
    """Rows ``start`` to ``end`` of a file; a tensor's shape, its rows' indices and the file of its patches' presence beside."""

    path: str
    start: int
    end: int
    shape: tuple
    dtype: str
    indices: tuple = ()
    present: str = ""

    def __post_init__(self):
        self.value = (self.path, self.start)


def _lists(flat: np.ndarray, width: int) -> pa.ListArray:
    offsets = np.arange(0, flat.size + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(flat, np.float32)))


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk_rows", 65536))

    def partitions(self) -> list[Range]:
        x = np.load(self.path, mmap_mode="r")
        if x.ndim == 3 and x.shape[1] == 1:
            shape = (x.shape[0], x.shape[2])
        elif x.ndim == 2:
            shape = x.shape
        else:
            raise ValueError(f"{self.path}: a matrix is needed, not {x.shape}")
        return [Range(self.path, s, min(s + self.chunk, shape[0]), shape, str(x.dtype)) for s in range(0, max(1, shape[0]), self.chunk)]

    def read(self, partition: Range):
        x = np.load(partition.path, mmap_mode="r").reshape(partition.shape)[partition.start : partition.end]
        ids = np.arange(partition.start, partition.start + len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(np.asarray(x).ravel(), x.shape[1])], ["id", "vec"])


class NpySource(DataSource):
    """``spark.read.format("npy_matrix").load(path)``: ``id, vec``."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def load_shards(folder: str, max_images: int | None = None) -> list[dict]:
    """Metadata of the shards of a folder, by file name, with one patch count and dimension for all."""
    found, left = [], max_images
    for path in sorted(Path(folder).glob("shard_*.json")):
        meta = json.loads(path.read_text())
        shape = tuple(meta["shape"])

        def located(name: str) -> str:
            file = next((c for c in (Path(name), path.parent / name, path.parent / Path(name).name) if c.is_file()), None)
            if file is None:
                raise FileNotFoundError(f"{path}: {name}")
            return str(file)

        data, present = located(meta["mmap_path"]), located(meta["present_path"]) if meta.get("present_path") else ""
        if found and shape[1:] != found[0]["shape"][1:]:
            raise ValueError(f"{path}: shape {shape} differs from {found[0]['shape']}")
        count = shape[0] if left is None else min(shape[0], left)
        if left is not None:
            left -= count
        if count:
            found.append({"path": data, "present": present, "shape": shape, "count": count, "dtype": meta.get("dtype", "float16"), "indices": tuple(meta.get("global_indices") or range(shape[0]))})
    if not found:
        raise FileNotFoundError(f"no shards in {folder}")
    return found


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.chunk = options["path"], int(options.get("chunk_images", 128))
        self.most = int(options["max_images"]) if options.get("max_images") else None

    def partitions(self) -> list[Range]:
        return [
            Range(s["path"], at, min(at + self.chunk, s["count"]), s["shape"], s["dtype"], s["indices"][at : min(at + self.chunk, s["count"])], s["present"])
            for s in load_shards(self.folder, self.most) for at in range(0, s["count"], self.chunk)
        ]

    def read(self, partition: Range):
        x = np.memmap(partition.path, mode="r", dtype=partition.dtype, shape=partition.shape)
        patches, width = partition.shape[1:]
        there = np.memmap(partition.present, mode="r", dtype=np.uint8, shape=(partition.shape[0], patches)) if partition.present else None
        for image, row in zip(partition.indices, range(partition.start, partition.end), strict=True):
            at = np.arange(patches)
            if there is not None and there[row].any():  # an image without tokens is all zero
                at = np.flatnonzero(there[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), image, np.int64)), pa.array(at.astype(np.int32)), _lists(np.asarray(x[row, at], np.float32).ravel(), width)],
                ["image_index", "patch_index", "vec"],
            )


class ShardSource(DataSource):
    """``spark.read.format("patch_shards").load(folder)``: ``image_index, patch_index, vec``."""

    @classmethod
    def name(cls) -> str:
        return "patch_shards"

    def schema(self) -> str:
        return "image_index long, patch_index int, vec array<float>"

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(ShardSource)

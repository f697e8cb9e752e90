"""Manifests, annotations, image folders, and small results as files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions import images as I
from lumenvec.operators.records import named_id

#: Suffixes of image files (fixed values).
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
ANNOTATIONS = (
    "images array<struct<id:bigint,file_name:string,height:int,width:int>>, "
    "annotations array<struct<image_id:bigint,caption:string>>"
)


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``images (pos, id, file_name, height, width)`` and ``annotations (pos, image_id, caption)`` in file order."""
    whole = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path)
    images = whole.select(F.posexplode("images").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), "x.*")
    notes = whole.select(F.posexplode("annotations").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), "x.*")
    return images, notes


def find_annotations(root: str, split: str, kinds: tuple[str, ...] = ("captions", "instances")) -> str | None:
    """First annotation file of a split, of each kind in the sub-folder and then in the root."""
    for kind in kinds:
        for folder in ("annotations", ""):
            path = Path(root, folder, f"{kind}_{split}.json")
            if path.is_file():
                return str(path)
    return None


def find_image_dir(root: str, split: str) -> str:
    """The split's folder below the root, or below ``images`` there; the first if neither exists."""
    return next((str(p) for p in (Path(root, split), Path(root, "images", split)) if p.is_dir()), str(Path(root, split)))


def first_match(folder: str, pattern: str, required: bool = True) -> str | None:
    found = sorted(Path(folder).glob(pattern))
    if not found and required:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return str(found[0]) if found else None


def directory_manifest(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Manifest of all image files below a folder, by path; sizes from the files' headers, -1 where unknown."""
    import pyarrow as pa

    from lumenvec.operators.order import numbered
    from lumenvec.sources.pixels import image_size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for _, h in sizes], pa.int32()), pa.array([w for w, _ in sizes], pa.int32())], ["path", "orig_height", "orig_width"]
            )

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
        .filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*IMAGE_SUFFIXES))
        .mapInArrow(run, "path string, orig_height int, orig_width int")
    )
    return numbered(files, [F.col("path").asc()], "index").select(
        "index", named_id(I.base_name(F.col("path")), F.col("index")).alias("image_id"), I.base_name(F.col("path")).alias("file_name"), "path",
        F.lit(split).alias("split"), "orig_height", "orig_width",
    )


@contextmanager
def replaced(path: str, mode: str = "w"):
    """A file that takes its name when it is whole; if writing fails, what was there stays."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile(mode, dir=folder, delete=False, encoding=None if "b" in mode else "utf-8") as out:
        try:
            yield out
        except BaseException:
            os.unlink(out.name)
            raise
    os.replace(out.name, path)


def write_json(value: object, path: str) -> None:
    """Small result, whole or not at all."""
    with replaced(path) as out:
        json.dump(value, out, ensure_ascii=False, indent=2)


def append_json_line(value: dict, path: str) -> None:
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps(value, ensure_ascii=False) + "\n")


def write_rows(df: DataFrame, path: str, form: str = "json", overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """JSON lines, CSV with a header, or Parquet; refuses to replace what exists unless told to."""
    out = df.write.mode("overwrite" if overwrite else "errorifexists")
    if form == "csv":
        out = out.option("header", True)
    if partition_by:
        out = out.partitionBy(*partition_by)
    getattr(out, form)(path)


def write_npy(rows: DataFrame, path: str, key: str = "centroid_id", vec: str = "vec", dtype: str = "float32") -> None:
    """A small table as a matrix, in the order of ``key``."""
    from lumenvec.operators.blocks import small_matrix

    np.save(path, small_matrix(rows, key, vec)[1].astype(dtype))


def is_done(path: str) -> bool:
    return Path(path, "_SUCCESS").exists()

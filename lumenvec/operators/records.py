"""Image manifests, shards and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.functions import images as I
from lumenvec.operators.order import numbered


def manifest(images: DataFrame, split: str, image_dir: str) -> DataFrame:
    """Manifest of annotated images ``(id, file_name, height, width)``.

    ``index`` counts the names in order, of equal ones those without id last, then by size; a missing
    id is taken from the name, or the index where the name has none or 0; missing sizes are -1.
    """
    order = [F.col(c).asc_nulls_last() for c in ("file_name", "id", "height", "width")]
    return numbered(images.select("id", "file_name", "height", "width"), order, "index").select(
        "index", F.coalesce(F.col("id").cast("long"), named_id(F.col("file_name"), F.col("index"))).alias("image_id"), "file_name",
        F.concat(F.lit(image_dir.rstrip("/") + "/"), "file_name").alias("path"), F.lit(split).alias("split"),
        F.coalesce(F.col("height").cast("int"), F.lit(-1)).alias("orig_height"), F.coalesce(F.col("width").cast("int"), F.lit(-1)).alias("orig_width"),
    )


def named_id(name: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(I.first_number(name), F.lit(0).cast("long")), index)


def enriched(rows: DataFrame, *, resize: int, patch_size: int, feature_dim: int, feature_dtype: str = "float16") -> DataFrame:
    """Manifest rows with the patch geometry, and ``status`` and ``error`` of ``ok`` and ``error`` if they have these."""
    if resize % patch_size:
        raise ValueError(f"image size {resize} is not divisible by the patch size {patch_size}")
    grid = resize // patch_size
    ok = F.col("ok") if "ok" in rows.columns else F.lit(True)
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "resize_size": F.array(F.lit(resize), F.lit(resize)), "patch_size": F.lit(patch_size), "patch_grid": F.array(F.lit(grid), F.lit(grid)),
        "num_patches": F.lit(grid * grid), "feature_dim": F.lit(feature_dim), "feature_dtype": F.lit(feature_dtype),
        "status": F.when(ok, "ok").otherwise("failed_image_load_zero_filled"), "error": F.when(~ok, error),
    })


def shard(rows: DataFrame, shard_id: int, shards: int, strategy: str = "mod", index: str = "index") -> DataFrame:
    """The rows of one shard, by remainder or in contiguous ranges of the dense index, and their places in it."""
    if not 0 <= shard_id < shards:
        raise ValueError(f"shard {shard_id} is not within 0..{shards - 1}")
    if strategy == "mod":
        of, local = I.mod_shard(F.col(index), shards), F.floor(F.col(index) / shards)
    elif strategy == "contiguous":
        total = rows.count()
        of, local = I.contiguous_shard(F.col(index), shards, total), F.col(index) - total * shard_id // shards
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return rows.filter(of == shard_id).withColumn("local_shard_index", local.cast("int"))


def resolved_paths(images: DataFrame, existing: DataFrame, image_root: str) -> DataFrame:
    """``path`` where it exists, else under ``image_root`` where that exists, else as it was.

    ``existing (path)`` lists the files there are.
    """
    there = existing.select(F.col("path").alias("_there")).distinct()
    other = F.concat(F.lit(image_root.rstrip("/") + "/"), F.col("file_name"))
    first = images.join(there, F.col("path") == F.col("_there"), "left").withColumn("_first", F.col("_there").isNotNull()).drop("_there")
    second = first.withColumn("_other", other).join(there, F.col("_other") == F.col("_there"), "left")
    return second.withColumn("path", F.when(~F.col("_first") & F.col("_there").isNotNull(), F.col("_other")).otherwise(F.col("path"))).select(*images.columns)


def captions(names: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """``file_name, image_id, captions`` of each of ``names (file_name)``, captions in file order.

    The id is that of the image of this base name (the last one listed), or else the last number in
    the name. Annotations ``(pos, image_id, caption)`` without an image or caption, and images
    without a name, are skipped. Names without captions do not appear.
    """
    by_name = (
        images.filter(F.col("file_name").isNotNull() & F.col("id").isNotNull())
        .groupBy(I.base_name(F.col("file_name")).alias("_base")).agg(F.max_by("id", "pos").alias("_id"))
    )
    lists = (
        annotations.filter(F.col("image_id").isNotNull() & F.col("caption").isNotNull())
        .groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "caption"))), lambda x: x["caption"]).alias("captions"))
    )
    wanted = names.withColumn("_base_of", I.base_name(F.col("file_name"))).join(by_name, F.col("_base_of") == F.col("_base"), "left")
    return wanted.select("file_name", F.coalesce("_id", I.last_number(F.col("file_name"))).cast("long").alias("image_id")).join(lists, "image_id").select("file_name", "image_id", "captions")


def caption_list(name: str, images: DataFrame, annotations: DataFrame) -> list[str]:
    """Captions of one image; raises if there are none."""
    found = captions(images.sparkSession.createDataFrame([(name,)], "file_name string"), images, annotations).collect()
    if not found:
        raise LookupError(f"no captions for {name}")
    return found[0]["captions"]

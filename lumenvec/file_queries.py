"""Queries over files that they write first: sources, sinks and what lies between them.

Their files go to a folder of their own in the shared folder, as tensors and shards are read through
memory maps.
"""

from __future__ import annotations

import uuid
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec import catalogue as C
from lumenvec.catalogue import query, r6
from lumenvec.operators import blocks, records, retrieval
from lumenvec.operators.order import shared_folder
from lumenvec.plans import projection
from lumenvec.sources import arrays, files, pixels, shards, tensors


def _folder(spark: SparkSession) -> str:
    path = Path(urlparse(shared_folder(spark)).path) / f"files-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return str(path)


def _array(side: DataFrame) -> np.ndarray:
    return blocks.small_matrix(side, "id", "vec")[1].astype(np.float32)


@query("""SELECT 'vision' AS modality, id, (i - 1)::INT AS i, round(v[i], 6) + 0.0 AS x FROM vis, d64 UNION ALL SELECT 'text', id, (i - 1)::INT, round(v[i], 6) + 0.0 FROM txt, d64""")
def tensor_pair(spark, sf):
    """One file with two keys, and two files; the text side comes from the second form."""
    folder = _folder(spark)
    v, t = (_array(C._side(spark, sf, k)) for k in (0, 1))
    tensors.save({"vision_feats": v, "text_feats": t[:, None]}, f"{folder}/pair.pt")
    np.save(f"{folder}/vision.npy", v)
    tensors.save(t, f"{folder}/text.pt")
    vision, _ = tensors.read_pair(spark, f"{folder}/pair.pt")
    _, text = tensors.read_pair(spark, vision_path=f"{folder}/vision.npy", text_path=f"{folder}/text.pt")
    both = vision.withColumn("modality", F.lit("vision")).unionByName(text.withColumn("modality", F.lit("text")))
    return both.select("modality", "id", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).select("modality", "id", "i", r6("x").alias("x"))


@query("""SELECT 'train' AS part, count(*) AS rows, round(sum(v[1]), 6) + 0.0 AS total FROM vis WHERE id < 200 UNION ALL SELECT 'train_text', count(*), round(sum(v[1]), 6) + 0.0 FROM txt WHERE id < 200
 UNION ALL SELECT 'val', count(*), round(sum(v[1]), 6) + 0.0 FROM vis WHERE id >= 200 UNION ALL SELECT 'val_text', count(*), round(sum(v[1]), 6) + 0.0 FROM txt WHERE id >= 200""")
def training_files(spark, sf):
    folder = _folder(spark)
    v, t = (_array(C._side(spark, sf, k)) for k in (0, 1))
    for name, part in (("train", slice(0, 200)), ("val", slice(200, None))):
        tensors.save({"vision_feats": v[part], "text_feats": t[part]}, f"{folder}/{name}.pt")
    out = None
    for name, side in zip(("train", "train_text", "val", "val_text"), tensors.read_training(spark, folder, "train.pt", "val.pt"), strict=True):
        one = side.agg(F.count("*").alias("rows"), r6(F.sum(F.col("vec")[0].cast("double"))).alias("total")).select(F.lit(name).alias("part"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(""", n AS (SELECT count(*) AS n FROM im), s AS (SELECT index, (((index + 1) * 3 - 1) // n)::INT AS shard, n FROM im, n)
 SELECT index AS image_index, shard, (index - n * shard // 3)::INT AS local_row, count(*) AS patches, round(sum(v[1]), 6) + 0.0 AS total FROM s JOIN e ON vec_id // 25 = index GROUP BY ALL""")
def shard_round_trip(spark, sf):
    """Shards written and scanned, joined with where each image lies."""
    folder = _folder(spark)
    shards.write_shards(C._patches(spark, sf), C._images(spark, sf), folder, 3, 25, 64, "contiguous", "float32")
    arrays.register(spark)
    sums = spark.read.format("patch_shards").option("chunk_images", 2).load(folder).groupBy("image_index").agg(F.count("*").alias("patches"), r6(F.sum(F.col("vec")[0].cast("double"))).alias("total"))
    return sums.join(shards.shard_rows(spark, folder), "image_index").select("image_index", "shard", "local_row", "patches", "total")


@query("SELECT shard_id, count(*) AS num_images, count(*) FILTER (index % 4 = 1) AS num_failed FROM (SELECT index, (index % 3)::INT AS shard_id FROM im) GROUP BY shard_id")
def failed_images(spark, sf):
    images = C._images(spark, sf).withColumn("shard_id", (F.col("index") % 3).cast("int")).withColumn("ok", F.col("index") % 4 != 1)
    return shards.failed_images(records.enriched(images, resize=224, patch_size=14, feature_dim=64), ["shard_id"])


@query("SELECT 10 AS k, image_index, patch_index, cluster_id FROM ac")
def assignment_files(spark, sf):
    folder, rows = _folder(spark), C._assigned(spark, sf)
    shards.write_assignments(rows, folder, 10, C._images(spark, sf).count(), 25, distances=True)
    return shards.read_assignments(spark, folder, 10).select("k", "image_index", "patch_index", "cluster_id")


@query("SELECT vec_id // 25 AS id, (i - 1)::INT AS i, round(avg(v[i]), 4) + 0.0 AS x FROM e, d64 GROUP BY ALL")
def image_means_file(spark, sf):
    path = f"{_folder(spark)}/means.pt"
    shards.write_image_means(C._patches(spark, sf), C._images(spark, sf), path, dtype="float32")
    rows = tensors.read_tensor(spark, path, "vision_feats").select("id", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x"))
    return rows.withColumn("x", F.round("x", 4) + F.lit(0.0))  # single precision holds no more for sure


@query("""SELECT id, (j - 1)::INT AS i, round(sum(v[k.i] * ((((k.i * 7 + j * 3) % 11) - 5) / 10.0)::FLOAT::DOUBLE), 6) + 0.0 AS x
 FROM vis, d64 k, (SELECT unnest(range(1, 9)) AS j) GROUP BY id, j""")
def map_file(spark, sf):
    path = f"{_folder(spark)}/W.pt"
    tensors.save(np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(1, 9)] for i in range(1, 65)], np.float32), path)
    return C._exploded(blocks.apply_map(C._side(spark, sf, 0), shards.read_map(path)))


@query(""", f AS (SELECT c, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS v FROM sc)
 SELECT c::INT AS centroid_id, (i - 1)::INT AS i, round(v[i] / sqrt(list_inner_product(v, v)), 6) + 0.0 AS x FROM f, d64""")
def centroid_files(spark, sf):
    _, c = blocks.small_matrix(C._small(spark, sf), "centroid_id", "vec")
    path = shards.write_centroids(c, _folder(spark))[0]
    return C._exploded(shards.read_centroids(spark, path, "cosine", 10), "centroid_id")


@query("SELECT index, file_name, orig_height::BIGINT AS orig_height, orig_width::BIGINT AS orig_width FROM img")
def global_files(spark, sf):
    folder = _folder(spark)
    shards.write_global_files(C._images(spark, sf), folder, 25, 64)
    return files.read_manifest(spark, f"{folder}/images").select("index", "file_name", "orig_height", "orig_width")


def _pixels(k: int, height: int, width: int) -> np.ndarray:
    y, x, c = np.ogrid[:height, :width, :3]
    return ((k * 7 + y * 13 + x * 29 + c * 31) % 256).astype(np.uint8)


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    """``path, content`` of a small picture for each image."""
    return spark.createDataFrame([(r["path"], pixels.png(_pixels(r["index"], 6, 6))) for r in C._images(spark, sf).select("index", "path").collect()], "path string, content binary")


@query("SELECT path, (c * 36 + y * 6 + x)::INT AS place, ((index * 7 + y * 13 + x * 29 + c * 31) % 256)::INT AS pixel FROM img, range(6) a(y), range(6) b(x), range(3) d(c)")
def image_input(spark, sf):
    """Channels as a model gets them, scaled back to pixels."""
    std, mean = (F.get(F.array(*map(F.lit, v)), F.floor(F.col("place") / 36).cast("int")) for v in (pixels.CHANNEL_STD, pixels.CHANNEL_MEAN))
    rows = pixels.image_tensors(_pictures(spark, sf), 6).select("path", F.posexplode("image").alias("place", "x"))
    return rows.select("path", "place", F.round((F.col("x") * std + mean) * 255).cast("int").alias("pixel"))


@query("""SELECT path, p::INT AS patch_index, index % 4 <> 1 AS ok, CASE WHEN index % 4 <> 1 THEN ((index * 7 + (p // 2 * 3) * 13 + (p % 2 * 3) * 29) % 256)::INT ELSE -1 END AS pixel FROM img, range(4) a(p)""")
def patch_features(spark, sf):
    """A model that takes the first pixel of each of 2 x 2 patches; every fourth file is broken."""
    broken = F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("long"), F.lit(4)) == 1
    files_ = _pictures(spark, sf).withColumn("content", F.when(~broken, F.col("content")).otherwise(F.encode(F.lit("broken"), "UTF-8")))
    rows = pixels.patch_features(files_, lambda x: {"patch_tokens": x[:, :, ::3, ::3].reshape(len(x), 3, 4).transpose(0, 2, 1)}, 6, 4, 3, 8)
    back = F.round((F.col("vec")[0] * pixels.CHANNEL_STD[0] + pixels.CHANNEL_MEAN[0]) * 255).cast("int")
    return rows.select("path", "patch_index", "ok", F.when(F.col("ok"), back).otherwise(F.col("vec")[0].cast("int") - 1).alias("pixel"))


@query("""SELECT index, index + 1 AS image_id, 'p' || lpad((index + 1)::VARCHAR, 3, '0') || '.png' AS file_name, (index + 2)::INT AS orig_height, (2 * index + 3)::INT AS orig_width FROM range(12) t(index)""")
def folder_manifest(spark, sf):
    folder = _folder(spark)
    for k in range(12):
        Path(folder, f"p{k + 1:03d}.png").write_bytes(pixels.png(_pixels(k, k + 2, 2 * k + 3)))
    Path(folder, "notes.txt").write_text("no image")
    return files.directory_manifest(spark, folder, "val").select("index", "image_id", "file_name", "orig_height", "orig_width")


@query("SELECT 'small' AS side, c::INT AS centroid_id, (i - 1)::INT AS i, round(v[i], 6) + 0.0 AS x FROM sc, d64 UNION ALL SELECT 'large', c::INT, (i - 1)::INT, round(v[i], 6) + 0.0 FROM lc, d64")
def centroids_side_by_side(spark, sf):
    sides = [c.withColumn("side", F.lit(name)) for name, c in (("small", C._small(spark, sf)), ("large", C._large(spark, sf)))]
    rows = sides[0].unionByName(sides[1])
    return rows.select("side", "centroid_id", F.posexplode("vec").alias("i", "x")).select("side", "centroid_id", "i", r6("x").alias("x"))


@query("""SELECT panel, 'vision' AS modality, count(*) AS points FROM vis, (SELECT unnest(['before', 'after']) AS panel) GROUP BY panel
 UNION ALL SELECT panel, 'text', count(*) FROM txt, (SELECT unnest(['before', 'after']) AS panel) GROUP BY panel""")
def projection_panels(spark, sf):
    """Points of a plot before and after a map; the plot itself goes to a file."""
    w = np.roll(np.eye(64), 1, axis=1)
    found = projection.panels(C._side(spark, sf, 0), C._side(spark, sf, 1), w=w)
    projection.write_panels(found, f"{_folder(spark)}/panels.png")
    return found.groupBy("panel", "modality").agg(F.count("*").alias("points"))


@query("""SELECT cluster_id, rank::INT AS rank, image_index, patch_index, (row_number() OVER (PARTITION BY cluster_id ORDER BY rank) - 1)::INT // 2 AS tile_row,
 ((row_number() OVER (PARTITION BY cluster_id ORDER BY rank) - 1) % 2)::INT AS tile_col, count(*) OVER (PARTITION BY cluster_id)::INT AS tiles
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY 1 - distance DESC, image_index, patch_index) AS rank FROM ac) WHERE rank <= 6 AND image_index % 3 <> 1""")
def rendered_patches(spark, sf):
    """The best patches of each cluster drawn into their images; images that are missing are left out, and collages close up."""
    images = C._images(spark, sf)
    top = retrieval.topk_per_cluster(C._assigned(spark, sf), images, 6, C.GRID)
    content = _pictures(spark, sf).filter(F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("long"), F.lit(3)) != 1).withColumnRenamed("path", "image_path")
    maps = retrieval.similarity_map(C._patches(spark, sf), C._small(spark, sf)).groupBy("image_index", F.col("centroid_id").alias("cluster_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("patch_index", "value"))), lambda x: x["value"]).alias("values")
    )
    rows = top.join(content, "image_path", "left").join(maps, ["image_index", "cluster_id"], "left")
    drawn = pixels.rendered(rows.select("cluster_id", "rank", "image_index", "patch_index", "patch_row", "patch_col", "content", "values"), (C.GRID, C.GRID), 48).persist()
    made = pixels.write_collages(drawn, _folder(spark), 2).select("cluster_id", "tiles")
    placed = retrieval.rendered_places(drawn.drop("tile", "patch_row", "patch_col"), 2)
    return placed.join(made, "cluster_id")

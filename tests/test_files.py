"""Tensor files, images, shards and other files, written and read back."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import order, records
from lumenvec.plans import alignment
from lumenvec.sources import files, pixels, shards, tensors


def test_tensor_files(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(8, 3)
    tensors.save({"vision_feats": x, "text_feats": x[:, None, :2].astype(np.float16), "n": 7, "names": ["a", "é"], "ok": True, "none": None, "share": 0.5}, str(tmp_path / "pair.pt"))
    found = tensors.load(str(tmp_path / "pair.pt"))
    assert {k: found[k] for k in ("n", "names", "ok", "none", "share")} == {"n": 7, "names": ["a", "é"], "ok": True, "none": None, "share": 0.5}
    v, t = tensors.read_pair(spark, str(tmp_path / "pair.pt"))
    assert np.array_equal([r["vec"] for r in v.orderBy("id").collect()], x) and np.array_equal([r["vec"] for r in t.orderBy("id").collect()], x[:, :2])
    tensors.save(x, str(tmp_path / "bare.pt"))
    np.save(tmp_path / "bare.npy", x + 1)
    np.savez(tmp_path / "two.npz", a=x, b=x[:2])
    v, t = tensors.read_pair(spark, vision_path=str(tmp_path / "bare.pt"), text_path=str(tmp_path / "bare.npy"))
    assert v.count() == 8 and t.filter("id = 7").first()["vec"] == [22, 23, 24]
    assert tensors.read_tensor(spark, str(tmp_path / "two.npz"), "b").count() == 2
    sides = tensors.read_training(spark, str(tmp_path), "pair.pt", "pair.pt")
    assert [s.count() for s in sides] == [8] * 4
    with pytest.raises(KeyError):
        tensors.read_tensor(spark, str(tmp_path / "pair.pt"), "other")
    with pytest.raises(TypeError):
        tensors.read_tensor(spark, str(tmp_path / "pair.pt"), "n")
    with pytest.raises(ValueError):
        tensors.read_pair(spark, vision_path="x")
    tensors.save(np.zeros((2, 2, 2), np.float32), str(tmp_path / "cube.pt"))
    with pytest.raises(ValueError):
        tensors.read_tensor(spark, str(tmp_path / "cube.pt"))
    tensors.save(np.zeros((0, 4), np.float32), str(tmp_path / "empty.pt"))
    assert tensors.read_tensor(spark, str(tmp_path / "empty.pt")).count() == 0


def test_tensor_files_run_no_code(tmp_path):
    import pickle
    import zipfile

    with zipfile.ZipFile(tmp_path / "bad.pt", "w") as z:
        z.writestr("archive/data.pkl", pickle.dumps(print))
    with pytest.raises(pickle.UnpicklingError):
        tensors.load(str(tmp_path / "bad.pt"))


def test_pixels():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert np.array_equal(pixels.decode(pixels.png(x)), x) and pixels.image_size(pixels.png(x)) == (5, 7)
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 7, 1, 24, 0, 0, 0, 0, 0, 0)
    bmp += b"".join(row[:, ::-1].tobytes() + b"\0" for row in x[::-1])
    assert np.array_equal(pixels.decode(bmp), x) and pixels.image_size(bmp) == (5, 7)
    assert np.array_equal(pixels.decode(b"P6 5 7 255\n" + x.tobytes()), x)
    assert pixels.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x07\x00\x05") == (5, 7)
    assert pixels.image_size(b"nothing") == (-1, -1)
    assert np.array_equal(pixels.resized(x, 7, 5), x) and (pixels.resized(np.full((9, 4, 3), 77, np.uint8), 3, 8) == 77).all()
    shown = pixels.boxed(np.zeros((20, 20, 3), np.uint8), 0, 1, (2, 2), 2)
    assert tuple(shown[0, 10]) == (255, 0, 0) and not shown[5, 15].any()
    heat = pixels.overlay(np.zeros((4, 4, 3), np.uint8), np.array([[0.0, 0.0], [1.0, 1.0]]), 1.0)
    assert heat[0, 0, 2] > heat[0, 0, 0] and heat[-1, 0, 0] > heat[-1, 0, 2]
    assert pixels.in_square(x, 14).shape == (14, 14, 3) and (pixels.in_square(x, 14)[:, 0] == 255).all()
    assert pixels.collage([x] * 3, 2).shape == (14, 10, 3)
    assert pixels.scatter([[(np.array([[0.0, 0.0], [1.0, 1.0]]), (1, 2, 3))]] * 2, 50).shape == (50, 100, 3)
    filtered = np.concatenate([np.array([[k % 5] for k in range(5)], np.uint8), rng.integers(0, 256, (5, 6)).astype(np.uint8)], axis=1)
    out = pixels._unfiltered(filtered.tobytes(), 5, 6, 3).astype(int)
    assert np.array_equal(out[2], (filtered[2, 1:] + out[1]) % 256) and np.array_equal(out[1, 3:], (filtered[1, 4:] + out[1, :3]) % 256)


def test_patch_features(spark):
    good = pixels.png(np.full((6, 6, 3), 255, np.uint8))
    images = spark.createDataFrame([("a", good), ("b", b"broken"), ("c", None)], "path string, content binary")

    def model(batch):
        assert batch.shape[1:] == (3, 4, 4)
        return {"patchtokens": batch.reshape(len(batch), 3, 16)[:, :, :4].transpose(0, 2, 1) + 1}

    rows = pixels.patch_features(images, model, 4, 4, 3).collect()
    assert len(rows) == 12
    by = {p: [r for r in rows if r["path"] == p] for p in "abc"}
    assert by["a"][0]["vec"] == pytest.approx([(1 - m) / s + 1 for m, s in zip(pixels.CHANNEL_MEAN, pixels.CHANNEL_STD, strict=True)], rel=1e-5) and by["a"][0]["ok"]
    assert all(r["vec"] == [0, 0, 0] and not r["ok"] and r["error"] for p in "bc" for r in by[p])
    assert pixels.patch_tokens((None, np.zeros((1, 2, 3)))).shape == (1, 2, 3)
    for bad, error in (({"x": 1}, KeyError), ([1, 2], TypeError)):
        with pytest.raises(error):
            pixels.patch_tokens(bad)
    got = pixels.image_tensors(images, 2).collect()
    assert [len(r["image"]) for r in got] == [12] * 3 and [r["ok"] for r in got] == [True, False, False]
    assert pixels.MODEL_DIMS["dinov2_vitb14"] == 768


def test_shards_and_assignments(spark, tmp_path):
    tokens = spark.range(7 * 4).select(F.floor(F.col("id") / 4).alias("image_index"), (F.col("id") % 4).cast("int").alias("patch_index"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vec"))
    images = spark.range(7).select(F.col("id").alias("index"), F.concat(F.lit("i"), "id").alias("file_name"), F.when(F.col("id") == 3, "failed").otherwise("ok").alias("status"))
    for strategy in ("mod", "contiguous"):
        folder = str(tmp_path / strategy)
        metas = shards.write_shards(tokens, images, folder, 3, 4, 2, strategy)
        assert sum(m["num_images"] for m in metas) == 7 and sum(m["num_failed_images"] for m in metas) == 1
        from lumenvec.sources import arrays

        arrays.register(spark)
        back = spark.read.format("patch_shards").load(folder)
        assert sorted((r["image_index"], r["patch_index"], r["vec"][0]) for r in back.collect()) == [(k // 4, k % 4, float(k)) for k in range(28)]
        where = {r["image_index"]: (r["shard"], r["local_row"]) for r in shards.shard_rows(spark, folder).collect()}
        assert where[5] == ((2, 1) if strategy == "mod" else (2, 1)) and len(where) == 7
        with pytest.raises(FileExistsError):
            shards.write_shards(tokens, images, folder, 3, 4, 2, strategy)
    assert tuple(shards.failed_images(images).first()) == (7, 1)
    rows = tokens.select("image_index", "patch_index", ((F.col("image_index") + F.col("patch_index")) % 5).cast("int").alias("cluster_id"), (F.col("patch_index") / 8).alias("distance"))
    config = shards.write_assignments(rows, str(tmp_path / "a"), 5, 7, 4, distances=True)
    assert config["id_dtype"] == "uint16" and config["total_vectors"] == 28 and json.loads((tmp_path / "a" / "config_assignment_k5.json").read_text()) == config
    got = shards.read_assignments(spark, str(tmp_path / "a"), 5)
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(tuple(r) for r in rows.collect())
    shards.write_assignments(rows, str(tmp_path / "b"), 70_000, 7, 4)
    assert np.load(tmp_path / "b" / "patch_cluster_ids_k70000_uint32.npy").dtype == np.uint32
    assert shards.read_assignments(spark, str(tmp_path / "b"), 70_000).filter("distance is null").count() == 28
    with pytest.raises(FileExistsError):
        shards.write_assignments(rows, str(tmp_path / "a"), 5, 7, 4)
    shards.write_image_means(tokens, images, str(tmp_path / "means.pt"), model="m")
    found = tensors.load(str(tmp_path / "means.pt"))
    assert found["file_names"] == [f"i{k}" for k in range(7)] and found["global_indices"].open().tolist() == list(range(7))
    assert found["vision_feats"].open()[:, 0].tolist() == [4 * k + 1.5 for k in range(7)]
    shards.write_global_files(images, str(tmp_path / "g"), 4, 2, model="m")
    assert shards.read_json_object(str(tmp_path / "g" / "patch_tokens_shape.json"))["full_shape"] == [7, 4, 2]
    assert files.read_manifest(spark, str(tmp_path / "g" / "images")).count() == 7


def test_centroids_and_map_files(spark, tmp_path):
    c = np.array([[3.0, 4.0], [1.0, 0.0]])
    paths = shards.write_centroids(c, str(tmp_path), np.array([5, 6]))
    assert np.load(paths[2]).tolist() == [5, 6] and np.load(paths[1]).dtype == np.float16
    rows = shards.read_centroids(spark, paths[0], "cosine", 2).orderBy("centroid_id").collect()
    assert rows[0]["vec"] == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        shards.read_centroids(spark, paths[0], expected_k=3)
    shards.write_alignment(alignment.Alignment(c, 0.5, [0.6], 0.7, 0.8, 2.0), str(tmp_path), "a_to_b_seed0")
    assert np.array_equal(shards.read_map(str(tmp_path / "W_a_to_b_seed0.pt")), c)
    assert shards.read_json_object(str(tmp_path / "result_a_to_b_seed0.json"))["refine1_cosine"] == [0.6]


def test_image_folders(spark, tmp_path):
    (tmp_path / "images" / "val").mkdir(parents=True)
    assert files.find_image_dir(str(tmp_path), "val") == str(tmp_path / "images" / "val") and files.find_image_dir(str(tmp_path), "x") == str(tmp_path / "x")
    (tmp_path / "images" / "val" / "p7.png").write_bytes(pixels.png(np.zeros((3, 9, 3), np.uint8)))
    row = files.directory_manifest(spark, str(tmp_path / "images"), "val").first()
    assert (row["index"], row["image_id"], row["orig_height"], row["orig_width"]) == (0, 7, 3, 9)
    assert files.first_match(str(tmp_path), "images/*/p*.png").endswith("p7.png") and files.first_match(str(tmp_path), "q*", required=False) is None
    with pytest.raises(FileNotFoundError):
        files.first_match(str(tmp_path), "q*")
    files.append_json_line({"a": 1}, str(tmp_path / "log.jsonl"))
    files.append_json_line({"a": 2}, str(tmp_path / "log.jsonl"))
    assert [r["a"] for r in files.read_manifest(spark, str(tmp_path / "log.jsonl")).orderBy("a").collect()] == [1, 2]
    there = spark.createDataFrame([("/x/a.jpg",), ("/root/b.jpg",)], "path string")
    images = spark.createDataFrame([(0, "a.jpg", "/x/a.jpg"), (1, "b.jpg", "/x/b.jpg"), (2, "c.jpg", "/x/c.jpg")], "index long, file_name string, path string")
    assert [r["path"] for r in sorted(records.resolved_paths(images, there, "/root/").collect())] == ["/x/a.jpg", "/root/b.jpg", "/x/c.jpg"]
    with pytest.raises(ValueError):
        records.enriched(images, resize=10, patch_size=3, feature_dim=1)


def test_numbers_and_ranks(spark):
    rows = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(0, 40, 300)], "x long")
    got = sorted((r["n"], r["x"]) for r in order.numbered(rows.withColumn("k", F.monotonically_increasing_id()), [F.col("x").asc(), F.col("k").asc()], "n", 7).collect())
    assert [n for n, _ in got] == list(range(300)) and [x for _, x in got] == sorted(x for _, x in got)
    values = np.array([x for _, x in got])
    want = {int(x): (values < x).sum() + ((values == x).sum() + 1) / 2 for x in values}
    assert all(r["r"] == want[r["x"]] for r in order.mean_ranks(rows, "x", "r", 7).collect())

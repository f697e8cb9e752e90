import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.functions import images as I
from lumenvec.operators import blocks, cluster, matching, metrics, prepare, records, retrieval, sampling
from lumenvec.plans import alignment
from lumenvec.sources import arrays, files


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>")


def centroids(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "centroid_id int, vec array<double>")


def test_assign_ties_zero_and_short_vectors(spark):
    points = frame(spark, [[0, 0], [1, 1], [0, 2], [3]])
    for metric in ("cosine", "l2"):
        out = {r["id"]: r for r in blocks.assign(points, centroids(spark, [[1, 0], [0, 1]]), metric).collect()}
        assert out[0]["cluster_id"] == 0 and out[1]["cluster_id"] == 0
        assert out[2]["cluster_id"] == 1 and out[3]["cluster_id"] == 0
    assert blocks.assign(points, centroids(spark, [[1, 0]])).filter("id = 0").first()["distance"] == 1
    with pytest.raises(ValueError):
        blocks.assign(points, centroids(spark, [[1, 0]]), "cityblock")
    with pytest.raises(ValueError):
        blocks.assign(points, centroids(spark, [[1, 0]]).filter("false"))


def test_knn_tiles_agree(spark):
    rng = np.random.default_rng(0)
    a, b = frame(spark, rng.normal(size=(40, 6))), frame(spark, rng.normal(size=(70, 6)))
    for metric in ("cosine", "l2"):
        got = [sorted(map(tuple, blocks.knn(a, b, 4, metric, tile=t).drop("score").collect())) for t in (7, 1000)]
        assert got[0] == got[1] and len(got[0]) == 160
    assert blocks.knn(a, a, 1, keep_self=False).filter("id = other_id").count() == 0
    assert blocks.knn(a, b.filter("id < 2"), 5).count() == 80


def test_kmeans_loss_falls_and_empty_clusters(spark):
    rng = np.random.default_rng(0)
    points = frame(spark, rng.normal(size=(60, 4)))
    fitted = cluster.KMeansVec(5, 6, "l2", 1).fit(points)
    losses = [r["avg_loss"] for r in fitted.log]
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:], strict=False))
    assert fitted.train_counts.sum() == 60
    start = np.concatenate([rng.normal(size=(2, 4)), np.full((1, 4), 1e6)])
    kept = cluster.KMeansVec(3, 1, "l2").fit(points, start)
    assert np.array_equal(kept.centroids[2], start[2]) and kept.log[0]["num_empty_clusters"] == 1
    moved = cluster.KMeansVec(3, 1, "l2", empty_cluster_policy="reinit").fit(points, start)
    assert np.abs(moved.centroids[2]).max() < 100
    for bad in (dict(num_iters=0), dict(metric="x"), dict(empty_cluster_policy="x")):
        with pytest.raises(ValueError):
            cluster.KMeansVec(2, **bad)
    with pytest.raises(ValueError):
        cluster.KMeansVec(61, 1).fit(points)


def test_preprocess(spark):
    points = frame(spark, [[3, 4], [0, 0], [1]])
    out = {r["id"]: r["vec"] for r in prepare.preprocessed(points, "l2").collect()}
    assert out[0] == [0.6, 0.8] and out[1] == [0, 0] and out[2] == [1]
    assert prepare.preprocessed(points, "raw") is points
    with pytest.raises(ValueError):
        prepare.preprocessed(points, "other")


def test_names(spark):
    names = ["a/IMG_000000000042.jpg", "x12_y34.png", "none.png", "d7/img0.jpg", "PIC_000000000009", ".hidden5", "IMG_000000000042_v2.jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", I.first_number(F.col("n")).alias("a"), I.last_number(F.col("n")).alias("b"))
    out = {r["n"]: (r["a"], r["b"]) for r in rows.collect()}
    assert out == {
        "a/IMG_000000000042.jpg": (42, 42), "x12_y34.png": (12, 34), "none.png": (None, None), "d7/img0.jpg": (0, 0),
        "PIC_000000000009": (9, 9), ".hidden5": (5, 5), "IMG_000000000042_v2.jpg": (42, 2),
    }


def test_shards_partition_rows(spark):
    rows = spark.range(23).withColumnRenamed("id", "index")
    for strategy in ("mod", "contiguous"):
        parts = [[r["index"] for r in records.shard(rows, s, 5, strategy).collect()] for s in range(5)]
        assert sorted(sum(parts, [])) == list(range(23))
    assert parts == [list(range(23 * s // 5, 23 * (s + 1) // 5)) for s in range(5)]
    with pytest.raises(ValueError):
        records.shard(rows, 5, 5)


def test_captions(spark):
    images = spark.createDataFrame([(0, 7, "a/x.jpg"), (1, 8, "b/x.jpg"), (2, None, "y.jpg"), (3, 9, None)], "pos long, id long, file_name string")
    notes = spark.createDataFrame([(1, 8, "two"), (0, 8, "one"), (2, None, "lost"), (3, 5, None), (4, 5, "five")], "pos long, image_id long, caption string")
    assert records.caption_list("z/x.jpg", images, notes) == ["one", "two"]
    assert records.caption_list("pic_5.jpg", images, notes) == ["five"]
    with pytest.raises(LookupError):
        records.caption_list("y.jpg", images, notes)


def test_retrieval_errors_and_ties(spark):
    assert retrieval.parse_clusters(" all ", 3) == [0, 1, 2]
    for bad in ("5", "", "2-9"):
        with pytest.raises(ValueError):
            retrieval.parse_clusters(bad, 3)
    images = spark.createDataFrame([(0, "a.jpg", "p/a.jpg"), (1, "q/a.jpg", "q/a.jpg")], "index long, file_name string, path string")
    with pytest.raises(ValueError):
        retrieval.find_image(images, name="a.jpg")
    with pytest.raises(ValueError):
        retrieval.find_image(images, index=9)
    assert retrieval.find_image(images, index=1).count() == 1
    rows = spark.createDataFrame([(i, p, 0, 0.5) for i in range(4) for p in range(2)], "image_index long, patch_index int, cluster_id int, distance double")
    both = retrieval.top_bottom_per_cluster(rows, images, 3, 2, chunk_images=2).orderBy("group", "rank").collect()
    assert [(r["image_index"], r["patch_index"]) for r in both if r["group"] == "most_similar"] == [(0, 0), (0, 1), (1, 0)]
    assert [(r["image_index"], r["patch_index"]) for r in both if r["group"] == "least_similar"] == [(1, 1), (1, 0), (0, 1)]
    assert retrieval.collage_places(both and spark.createDataFrame([(5,)], "rank int"), 3).first()[1:] == (1, 1)


def test_matching_errors(spark):
    small, large = centroids(spark, [[1, 0], [0, 1], [1, 1]]), centroids(spark, [[0, 1], [1, 0]])
    with pytest.raises(ValueError):
        matching.match_centroids(small, large)
    with pytest.raises(ValueError):
        matching.match_centroids(large, centroids(spark, [[1, 0, 0]] * 3))
    rows = matching.match_centroids(large, small).orderBy("small_index").collect()
    assert [r["large_index"] for r in rows] == [1, 0] and all(r["rank_in_small_to_large"] == 1 for r in rows)


def test_metrics_of_equal_sides(spark):
    points = frame(spark, np.random.default_rng(0).normal(size=(30, 5)))
    assert metrics.mmd_rbf(points, points).first()["mmd_rbf"] == pytest.approx(0, abs=1e-12)
    assert metrics.pairwise_spearman(points, points).first()[0] == pytest.approx(1)
    found = metrics.precision_recall_coverage(*[prepare.of_unit_length(points)] * 2, 3).first()
    assert found["precision_text_in_vision"] == 1 and 0 < found["coverage_vision_by_text"] <= 1
    with pytest.raises(ValueError):
        metrics.kth_radius(points.limit(1), 2)
    with pytest.raises(ValueError):
        metrics.cluster_wasserstein(points, points.limit(1), 3, 0)


def test_samples(spark):
    rows = frame(spark, np.eye(12))
    assert sampling.sample_points(rows, None, 1).count() == 12
    assert sampling.sample_points(rows, 5, 1).count() == 5
    a, b, paired = sampling.sample_pair(rows, rows, 4, 1)
    assert paired and sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    with pytest.raises(ValueError):
        sampling.unpaired_split(rows, rows, 11)


def test_alignment_finds_a_planted_rotation(spark):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    centres = rng.normal(size=(8, 6)) * [3, 2, 1.5, 1, 1, 1]
    x = centres[np.arange(160) % 8] + 0.1 * rng.normal(size=(160, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    left, right = frame(spark, x), frame(spark, x @ q)
    split = sampling.unpaired_split(left, right, 40)
    out = alignment.fit_alignment(
        *split, num_anchor_runs=2, qap_runs=20, num_clusters=8, anchor_subsample=100, initial_k=3, refine_iters=3, refine_k=3, refine2_clusters=8
    )
    assert max(out.refine1_cosine) > 0.9 and out.refine2_cosine > 0.9
    assert out.orthogonality_error < 0.5 and out.avg_rank < 12


def test_array_sources(spark, tmp_path):
    arrays.register(spark)
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "c.npy", x)
    rows = spark.read.format("npy_matrix").option("chunk_rows", 4).load(str(tmp_path / "c.npy")).orderBy("id").collect()
    assert np.array_equal(np.array([r["vec"] for r in rows]), x)
    for s, ids in enumerate(([0, 2], [1, 3])):
        t = np.arange(2 * 4 * 3, dtype=np.float16).reshape(2, 4, 3) + 100 * s
        t.tofile(tmp_path / f"shard_{s}.mmap")
        (tmp_path / f"shard_{s}.json").write_text(json.dumps({"shape": [2, 4, 3], "mmap_path": f"/gone/shard_{s}.mmap", "global_indices": ids, "dtype": "float16"}))
    found = spark.read.format("patch_shards").option("chunk_images", 1).load(str(tmp_path))
    assert found.count() == 16
    assert found.filter("image_index = 3 and patch_index = 1").first()["vec"] == [115, 116, 117]
    assert spark.read.format("patch_shards").option("max_images", 3).load(str(tmp_path)).select("image_index").distinct().count() == 3
    (tmp_path / "shard_2.json").write_text(json.dumps({"shape": [2, 5, 3], "mmap_path": "shard_1.mmap"}))
    with pytest.raises(ValueError):
        arrays.load_shards(str(tmp_path))


def test_files(spark, tmp_path):
    (tmp_path / "annotations").mkdir()
    path = tmp_path / "annotations" / "captions_val.json"
    path.write_text(json.dumps({"images": [{"id": 3, "file_name": "b.jpg"}], "annotations": [{"image_id": 3, "caption": "é"}, {"image_id": 3, "caption": "z"}]}))
    assert files.find_annotations(str(tmp_path), "val") == str(path)
    images, notes = files.read_annotations(spark, str(path))
    assert images.first()["id"] == 3 and [r["caption"] for r in notes.orderBy("pos").collect()] == ["é", "z"]
    for n in ("i2.jpg", "sub/i0.PNG", "t.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    rows = files.directory_manifest(spark, str(tmp_path), "val").orderBy("index").collect()
    assert [(r["file_name"], r["image_id"]) for r in rows] == [("i2.jpg", 2), ("i0.PNG", 1)]
    files.write_json({"a": "é"}, str(tmp_path / "o" / "r.json"))
    assert json.loads((tmp_path / "o" / "r.json").read_text()) == {"a": "é"}
    files.write_rows(images, str(tmp_path / "rows"), "csv")
    assert files.is_done(str(tmp_path / "rows"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_rows(images, str(tmp_path / "rows"), "csv")


def test_stream_counts(spark, tmp_path):
    from lumenvec.streaming.assign import running_counts

    frame(spark, [[1, 0], [0, 1], [0, 2]]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, vec array<double>").parquet(str(tmp_path / "in"))
    q = running_counts(stream, centroids(spark, [[1, 0], [0, 1]]), "counts_now", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {(r["cluster_id"], r["cnt"]) for r in spark.table("counts_now").collect()} == {(0, 1), (1, 2)}


def test_image_query(spark):
    from lumenvec.plans.image_query import image_clusters, parse_k_values

    images = spark.createDataFrame([(0, "a.jpg", "p/a.jpg")], "index long, file_name string, path string")
    rows = spark.createDataFrame([(k, 0, p, p % k, 0.25) for k in (2, 3) for p in range(4)], "k int, image_index long, patch_index int, cluster_id int, distance double")
    found = image_clusters(rows, images, (2, 2), name="x/a.jpg")
    assert found.rows.count() == 8 and found.index.filter("k = 3 and rank = 1").first()["cluster_id"] == 0
    assert parse_k_values("3, 2,3", rows) == [2, 3]
    for bad in (dict(grid=(2, 3), image_index=0), dict(grid=(2, 2), name="b.jpg"), dict(grid=(2, 2), image_index=0, k_values="9")):
        with pytest.raises(ValueError):
            image_clusters(rows, images, **bad)

"""Tables in forms that the smallest ones don't have: folders of part files, images of fewer patches, names that repeat."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec import catalogue, file_queries  # noqa: F401
from lumenvec.operators import blocks, metrics, solvers
from lumenvec.plans import projection
from lumenvec.sources import pixels


@pytest.fixture(scope="session")
def odd(spark, sf, tmp_path_factory):
    """A folder of tables: 106 embeddings in two part files, the last image with 6 patches of 25; documents of three names."""
    folder = tmp_path_factory.mktemp("odd")
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 106")
    embeddings.repartition(2).write.parquet(f"{folder}/embeddings.parquet")
    spark.range(12).selectExpr("1009 * (id div 3) + id % 3 AS doc_id").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _same(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}/*.parquet'")
    found = catalogue.QUERIES[name](spark, folder)
    theirs = con.sql(catalogue.ORACLES[name])
    at = [theirs.columns.index(c) for c in found.columns]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())


@pytest.mark.parametrize("name", ["assignment_files", "manifest", "shard_round_trip", "stream_cluster_counts"])
def test_odd_tables_equal_sql(spark, odd, name):
    _same(spark, odd, name)


def _points(spark, n, seed=0):
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(np.random.default_rng(seed).normal(size=(n, 4)))], "id long, vec array<double>")


def test_tiles_do_not_grow_with_the_table(spark):
    """Rows are copied for a bounded number of tiles, and every pair is met once."""

    def block(one, other):
        n, m = len(one[0]), len(other[0])
        yield [[n * m if m else n * (n - 1) // 2]]

    points = _points(spark, 1000)
    across = [r[0] for r in blocks.tiled(points, points, block, "n long", tile=10).collect()]
    assert sum(across) == 1000 * 1000 and len(across) <= blocks.MOST_TILES**2
    within = [r[0] for r in blocks.tiled_within(points, tile=10)(block, "n long").collect()]
    assert sum(within) == 1000 * 999 // 2 and len(within) == 78


def test_kernel_discrepancy_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(blocks.tiled_within, "__defaults__", (None, 20, 5))
    sides = [_points(spark, n, n) for n in (90, 130)]
    x, y = (np.random.default_rng(n).normal(size=(n, 4)) for n in (90, 130))
    d = [((a[:, None] - b) ** 2).sum(2).ravel() for a, b in ((x, x), (y, y), (x, y))]
    whole = np.sort(np.concatenate(d))
    whole = whole[whole > 1e-9]
    sigma = (whole[(len(whole) - 1) // 2] / 2) ** 0.5
    k = [np.exp(-v / (2 * sigma * sigma)).mean() for v in d]
    assert metrics.mmd_rbf(*sides).first().asDict() == pytest.approx({"mmd_rbf": k[0] + k[1] - 2 * k[2], "mmd_sigma": sigma}, abs=1e-9)


def test_rank_correlation_without_a_table_of_pairs(spark):
    one = _points(spark, 400)
    two = one.withColumn("vec", F.transform("vec", lambda x: F.round(x * 8) / 8)).unionAll(_points(spark, 3, 9).withColumn("id", F.col("id") + 1000))
    found, ranked = (metrics.pairwise_spearman(one, two, most).first()[0] for most in (0, 1 << 24))
    assert found == pytest.approx(ranked, abs=1e-6) and 0.9 < ranked < 1
    same = one.withColumn("vec", F.array(F.lit(1.0)))
    assert metrics.pairwise_spearman(same, same, 0).first()[0] == 0


def test_plot_of_many_points(spark, tmp_path):
    """More than 200,000 points; the picture is that of the points themselves."""
    n = 200_001
    points = spark.range(n).selectExpr("'before' AS panel", "IF(id % 3 = 0, 'vision', 'text') AS modality", "id", "id * 7919D % 1009 AS x", "id * 104729D % 2003 AS y")
    projection.write_panels(points, str(tmp_path / "p.png"))
    k = np.arange(n)
    xy = np.stack([k * 7919 % 1009, k * 104729 % 2003], 1).astype(float)
    whole = pixels.scatter([[(xy[k % 3 == 0], (31, 119, 180)), (xy[k % 3 != 0], (255, 127, 14))]])
    assert np.array_equal(pixels.decode((tmp_path / "p.png").read_bytes()), whole)


def test_plane_of_many_points():
    """Repulsion through the grid is that of all pairs; points of two groups stay apart with near affinities only."""
    y = np.random.default_rng(0).normal(size=(300, 2)) * 3
    apart = y[:, None] - y
    w = 1 / (1 + (apart**2).sum(2))
    away, total = solvers.repulsion(y)
    assert total == pytest.approx(w.sum() - len(y), rel=1e-3) and np.allclose(away, (w[..., None] ** 2 * apart).sum(1), atol=0.1)


def test_tsne_beyond_a_matrix(spark, monkeypatch):
    monkeypatch.setattr(projection, "MOST_VALUES", 120**2 - 1)
    x = spark.createDataFrame([(k, [float(v) for v in np.random.default_rng(k).normal(5 * (k % 2), 0.1, 6)]) for k in range(60)], "id long, vec array<double>")
    rows = projection.project_2d(x, x.withColumn("vec", F.transform("vec", lambda v: v + 0.01)), "tsne")[0].collect()
    assert sorted((r["modality"], r["id"]) for r in rows) == sorted((m, k) for m in ("text", "vision") for k in range(60))
    y = [np.array([(r["x"], r["y"]) for r in rows if r["id"] % 2 == k]) for k in (0, 1)]
    assert np.linalg.norm(y[0].mean(0) - y[1].mean(0)) > 2 * y[0].std(0).max()

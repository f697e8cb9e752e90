import hashlib

import duckdb
import numpy as np
import pytest

from lumenvec import catalogue, file_queries  # noqa: F401
from lumenvec.operators import cluster


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.fixture(scope="module")
def sides(sf):
    x = {r[0]: np.array(r[1], float) for r in duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()}
    return [np.array([x[i] for i in sorted(x) if i % 2 == k]) for k in (0, 1)]


def rows(name, spark, sf):
    return catalogue.QUERIES[name](spark, sf).collect()


def test_procrustes_against_numpy(spark, sf, sides):
    u, _, vt = np.linalg.svd(sides[0].T @ sides[1])
    w = np.array([r["vec"] for r in sorted(rows("procrustes", spark, sf))])
    assert np.allclose(w, u @ vt, atol=1e-8)


def test_projection_against_numpy(spark, sf, sides):
    x = np.concatenate(sides)
    x = x - x.mean(0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    shares = s**2 / (s**2).sum()
    assert [r["share"] for r in sorted(rows("pca_variance", spark, sf))] == pytest.approx(shares[:2], abs=1e-6)
    got = sorted(rows("pca_2d", spark, sf), key=lambda r: (r["modality"] != "vision", r["id"]))
    xy = np.array([(r["x"], r["y"]) for r in got])
    assert np.allclose(np.abs(xy), np.abs(x @ vt[:2].T), atol=1e-5)
    plane = rows("tsne_2d", spark, sf)
    assert len(plane) == len(x) and np.isfinite([(r["x"], r["y"]) for r in plane]).all()


def _drawn(x, n, seed):
    order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())
    return x[sorted(order[:n])]


def test_gromov_wasserstein_against_plain_loops(spark, sf, sides):
    d = []
    for k, x in enumerate(sides):
        u = _drawn(x / np.linalg.norm(x, axis=1)[:, None], 300, 42 + k)
        d.append(np.maximum(1 - u @ u.T, 0))
    a, b = (m / m.max() for m in d)
    n, m = len(a), len(b)
    plan = np.full((n, m), 1 / (n * m))
    for _ in range(20):
        cost = (a**2 @ np.full(n, 1 / n))[:, None] + (b**2 @ np.full(m, 1 / m)) - 2 * a @ plan @ b
        k, v = np.exp(-cost / 0.05), np.ones(m)
        for _ in range(50):
            u = 1 / n / (k @ v)
            v = 1 / m / (k.T @ u)
        plan = u[:, None] * k * v
    cost = (a**2 @ np.full(n, 1 / n))[:, None] + (b**2 @ np.full(m, 1 / m)) - 2 * a @ plan @ b
    assert rows("gw_distance", spark, sf)[0][0] == pytest.approx((cost * plan).sum(), abs=2e-6)


def test_distribution_metrics_against_numpy(spark, sf, sides):
    got = {r["metric"]: r["value"] for r in rows("distribution_metrics", spark, sf)}
    v, t = (x - x.mean(0) for x in sides)
    v, t = (x / np.linalg.norm(x, axis=1)[:, None] for x in (v, t))
    assert got["all_pair_cosine_mean"] == pytest.approx((v @ t.T).mean(), abs=2e-6) and got["same_index_cosine_mean"] == pytest.approx((v * t).sum(1).mean(), abs=2e-6)

    def squares(a, b):
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)

    d = [squares(v, v), squares(t, t), squares(v, t)]
    whole = np.sort(np.concatenate([x[x > 1e-9] for x in d]))
    sigma = np.sqrt(whole[(len(whole) - 1) // 2] / 2)
    k = [np.exp(-x / (2 * sigma**2)).mean() for x in d]
    assert got["mmd_sigma"] == pytest.approx(sigma, abs=2e-6) and got["mmd_rbf"] == pytest.approx(k[0] + k[1] - 2 * k[2], abs=2e-6)
    cross, own = 1 - v @ t.T, [1 - x @ x.T for x in (v, t)]
    for x in own:
        np.fill_diagonal(x, np.inf)
    radius = [np.sort(x, axis=1)[:, 4] for x in own]
    near_v, near_t = cross.argmin(0), cross.argmin(1)
    p, r = (cross.min(0) <= radius[0][near_v]).mean(), (cross.min(1) <= radius[1][near_t]).mean()
    assert got["precision_text_in_vision"] == pytest.approx(p, abs=2e-6) and got["recall_vision_in_text"] == pytest.approx(r, abs=2e-6)
    assert got["coverage_vision_by_text"] == pytest.approx(len(set(near_v)) / len(v), abs=2e-6) and got["coverage_text_by_vision"] == pytest.approx(len(set(near_t)) / len(t), abs=2e-6)
    i, j = np.triu_indices(len(v), 1)
    ranks = [np.argsort(np.argsort((x @ x.T)[i, j])) for x in (v, t)]
    assert got["pairwise_spearman"] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-4) and got["pairwise_spearman_n"] == len(v)
    assert 0 < got["kmeans_wasserstein"] < 2 and got["kmeans_k"] == 8 and got["gw_distance"] > 0


def test_clusterings_against_numpy(spark, sf, sides):
    counts = {r["cluster_id"]: r["cnt"] for r in rows("caption_kmeans", spark, sf)}
    assert sorted(counts) == list(range(6)) and sum(counts.values()) == sum(map(len, sides))
    value, k = rows("cluster_wasserstein", spark, sf)[0]
    points = catalogue._side(spark, sf, 0), catalogue._side(spark, sf, 1)
    a, b = (cluster.KMeansVec(8, 4, "l2", 42 + s).fit(p, cluster.spread_centroids(p, 8, 42 + s)).centroids for s, p in enumerate(points))
    cost = np.linalg.norm(a[:, None] - b, axis=2)
    best = {0: 0.0}
    for i in range(8):  # least total over subsets of columns
        nxt = {}
        for mask, total in best.items():
            for j in range(8):
                if not mask >> j & 1:
                    nxt[mask | 1 << j] = min(nxt.get(mask | 1 << j, np.inf), total + cost[i, j])
        best = nxt
    assert k == 8 and value == pytest.approx(best[255] / 8, abs=2e-6)
    assert rows("qap_align", spark, sf)[0]["clusters"] == 20
    steps = {r["step"]: r["value"] for r in rows("align_pipeline", spark, sf)}
    assert set(steps) == {"initial", "refine1_0", "refine1_1", "refine2", "top1", "avg_rank"} and -1 <= steps["initial"] <= 1 and 0 <= steps["top1"] <= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

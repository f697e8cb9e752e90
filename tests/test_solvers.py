from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenvec.operators import solvers


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2), st.integers(0, 10_000))
def test_hungarian_is_optimal(n, extra, seed):
    cost = np.random.default_rng(seed).normal(size=(n, n + extra)).round(1)
    found = solvers.hungarian(cost)
    assert len(set(found.tolist())) == n
    best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in permutations(range(n + extra), n))
    assert cost[np.arange(n), found].sum() == pytest.approx(best)


def test_hungarian_needs_columns():
    with pytest.raises(ValueError):
        solvers.hungarian(np.zeros((3, 2)))


def test_quadratic_assignment_against_all_permutations():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 3))
    a = x @ x.T
    p = rng.permutation(6)
    b = a[np.ix_(p, p)]
    found, value = solvers.quadratic_assignment(a, b, runs=20)
    best = max(float((a * b[np.ix_(q, q)]).sum()) for q in map(list, permutations(range(6))))
    assert value == pytest.approx(best)
    assert sorted(found.tolist()) == list(range(6))


def test_procrustes_recovers_a_rotation():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    x = rng.normal(size=(100, 8))
    w = solvers.procrustes(x.T @ (x @ q))
    assert np.allclose(w, q) and np.allclose(w.T @ w, np.eye(8))


def test_sinkhorn_marginals():
    plan = solvers.sinkhorn(np.random.default_rng(0).random((5, 7)), 0.1, 200)
    assert np.allclose(plan.sum(0), 1 / 7) and np.allclose(plan.sum(1), 1 / 5, atol=1e-6)


def test_gromov_wasserstein_of_equal_spaces():
    x = np.random.default_rng(0).normal(size=(12, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = np.maximum(1 - x @ x.T, 0)
    p = np.random.default_rng(1).permutation(12)
    same, moved = (solvers.gromov_wasserstein(c, d, 0.005, 30, 100) for d in (c, c[np.ix_(p, p)]))
    assert same == pytest.approx(moved, abs=1e-6)
    y = np.random.default_rng(2).normal(size=(12, 4)) ** 3
    y /= np.linalg.norm(y, axis=1)[:, None]
    assert same < solvers.gromov_wasserstein(c, np.maximum(1 - y @ y.T, 0), 0.005, 30, 100) + 0.05


def test_tsne_keeps_two_groups_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 5)), rng.normal(4, 0.1, (20, 5))])
    y = solvers.tsne(x, (x - x.mean(0))[:, :2], 5, 200)
    assert np.linalg.norm(y[:20].mean(0) - y[20:].mean(0)) > 2 * y[:20].std()


def test_lloyd_finds_separate_groups():
    rng = np.random.default_rng(0)
    centres = 10 * rng.normal(size=(5, 3))
    x = centres[np.arange(100) % 5] + 0.01 * rng.normal(size=(100, 3))
    found, loss = solvers.lloyd(x, 5)
    assert np.abs(np.sort(found, axis=0) - np.sort(centres, axis=0)).max() < 0.05 and loss < 0.01
    with pytest.raises(ValueError):
        solvers.lloyd(x[:3], 5)

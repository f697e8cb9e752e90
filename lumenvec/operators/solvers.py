"""Small dense solvers in numpy: assignment, quadratic assignment, Procrustes, transport, projection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one assignment of least total cost; needs rows <= columns.

    Shortest augmenting paths with dual prices: rows are added one at a time, each along the
    cheapest alternating path found by Dijkstra's algorithm on reduced costs.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    column_of = np.full(n, -1)
    for start in range(n):
        distance, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, reached = start, 0.0, [start]
        while True:
            through = base + cost[row] - row_price[row] - column_price
            closer = ~done & (through < distance)
            distance[closer], came[closer] = through[closer], row
            column = int(np.argmin(np.where(done, np.inf, distance)))
            base, done[column] = distance[column], True
            if row_of[column] < 0:
                break
            row = row_of[column]
            reached.append(row)
        for r in reached:
            row_price[r] += base - (0.0 if r == start else distance[column_of[r]])
        column_price[done] -= base - distance[done]
        while column >= 0:  # flip the path
            row = came[column]
            row_of[column] = row
            column_of[row], column = column, column_of[row]
    return column_of


def quadratic_assignment(a: np.ndarray, b: np.ndarray, runs: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Permutation p that maximises sum(a * b[p][:, p]), by pairwise exchanges from random starts."""
    n = len(a)
    best, best_value = np.arange(n), -np.inf
    for run in range(runs):
        rng = np.random.default_rng((seed, run))
        p = rng.permutation(n)
        value = float((a * b[np.ix_(p, p)]).sum())
        improved = True
        while improved:
            improved = False
            for i in range(n - 1):
                for j in range(i + 1, n):
                    q = p.copy()
                    q[i], q[j] = q[j], q[i]
                    new = float((a * b[np.ix_(q, q)]).sum())
                    if new > value + 1e-12:
                        p, value, improved = q, new, True
        if value > best_value:
            best, best_value = p, value
    return best, best_value


def lloyd(x: np.ndarray, k: int, iters: int = 10, restarts: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """Centroids of a small matrix, Euclidean, and their mean loss: the best of some spread starts."""
    if len(x) < k:
        raise ValueError(f"fewer vectors than k={k}")
    best, least = x[:k], np.inf
    for run in range(restarts):
        c = spread(x, k, np.random.default_rng((seed, run)))
        for _ in range(iters):
            d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
            label = d.argmin(1)
            counts = np.bincount(label, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, label, x)
            c = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], x[np.argsort(-d.min(1))[:k]])
        loss = float(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0).min(1).mean())
        if loss < least:
            best, least = c, loss
    return best, least


def spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows far from each other: each next one is the best of a few candidates drawn by squared distance."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        share = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        tries = rng.choice(len(x), size=2 + int(np.log(k)), p=share)
        left = np.minimum(near, ((x[tries][:, None] - x) ** 2).sum(2))
        best = int(left.sum(1).argmin())
        chosen.append(int(tries[best]))
        near = left[best]
    return x[chosen]


def procrustes(cross: np.ndarray) -> np.ndarray:
    """The orthogonal W that maximises trace(W^T cross), for ``cross = X^T Y``."""
    u, _, vt = np.linalg.svd(cross)
    return u @ vt


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def sinkhorn(cost: np.ndarray, epsilon: float, iters: int) -> np.ndarray:
    """Transport plan between uniform marginals; rows are scaled first, columns last."""
    n, m = cost.shape
    kernel = -cost / epsilon
    u, v = np.zeros(n), np.zeros(m)
    for _ in range(iters):
        u = -np.log(n) - _log_sum(kernel + v, 1)
        v = -np.log(m) - _log_sum(kernel + u[:, None], 0)
    return np.exp(kernel + u[:, None] + v)


def gromov_wasserstein(a: np.ndarray, b: np.ndarray, epsilon: float, iters: int, sinkhorn_iters: int) -> float:
    """Entropic distance of two distance matrices, scaled by their maxima, from the independent plan."""
    a, b = a / max(a.max(), 1e-6), b / max(b.max(), 1e-6)
    n, m = len(a), len(b)
    plan = np.full((n, m), 1.0 / (n * m))
    fixed = (a * a).mean(1)[:, None] + (b * b).mean(1)
    for _ in range(iters):
        plan = sinkhorn(fixed - 2 * a @ plan @ b.T, epsilon, sinkhorn_iters)
    return float(((fixed - 2 * a @ plan @ b.T) * plan).sum())


def principal(gram: np.ndarray, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Leading directions of a covariance and their shares of the variance; the largest entry is positive."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[:n]
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes, values[order] / max(values.sum(), 1e-300)


def _affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Shares that fall off with each row's squared distances, at its precision for the perplexity."""
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(60):  # bisection of each point's precision for its entropy
        p = np.exp(-(d - d.min(1, keepdims=True)) * beta[:, None])
        p /= p.sum(1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p


def _descended(start: np.ndarray, gradient: Callable[[np.ndarray, float], np.ndarray], iters: int) -> np.ndarray:
    n, y = len(start), start / max(start[:, 0].std(), 1e-12) * 1e-4
    speed, gain = np.zeros_like(y), np.ones_like(y)
    for turn in range(iters):
        slope = gradient(y, 12 if turn < iters // 4 else 1)
        gain = np.where(np.sign(slope) != np.sign(speed), gain + 0.2, np.maximum(gain * 0.8, 0.01))
        speed = (0.5 if turn < iters // 4 else 0.8) * speed - max(n / 48, 50) * gain * slope
        y = y + speed
        y -= y.mean(0)
    return y


def tsne(x: np.ndarray, start: np.ndarray, perplexity: float, iters: int = 300) -> np.ndarray:
    """2-D embedding of at most a few thousand points by gradient descent on exact affinities."""
    n = len(x)
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    p = _affinities(d, perplexity)
    p = (p + p.T) / (2 * n)

    def gradient(y: np.ndarray, push: float) -> np.ndarray:
        w = 1 / (1 + (y * y).sum(1)[:, None] + (y * y).sum(1) - 2 * y @ y.T)
        np.fill_diagonal(w, 0)
        q = np.maximum(w / w.sum(), 1e-12)
        pull = (p * push - q) * w
        return 4 * (pull.sum(1)[:, None] * y - pull @ y)

    return _descended(start, gradient, iters)


def repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums of ``w^2 (y_i - y_j)`` for each point, and of ``w`` over all pairs, for ``w = 1 / (1 + |y_i - y_j|^2)``.

    All pairs count, through a grid: cells of at most unit length with three nodes a side, on which
    the kernel is interpolated and its sums are convolutions.
    """
    low, span = y.min(0), max(float(np.ptp(y, axis=0).max()), 1e-9)
    wanted = max(50, int(np.ceil(span)))
    cells = min(c << max(0, (-(-wanted // c) - 1).bit_length()) for c in (3, 5, 9, 15, 25, 27))  # transforms of small factors are fast
    m, side = 3 * cells, span / cells
    cell = np.clip(((y - low) / side).astype(int), 0, cells - 1)
    u = (y - low) / side - cell
    a, b, c = u - 1 / 6, u - 1 / 2, u - 5 / 6
    share = np.stack([4.5 * b * c, -9 * a * c, 4.5 * a * b])  # Lagrange polynomials of the nodes
    at = [((cell[:, 0] * 3 + i) * m + cell[:, 1] * 3 + j, share[i, :, 0] * share[j, :, 1]) for i in range(3) for j in range(3)]
    charges = [np.ones(len(y)), y[:, 0], y[:, 1], (y * y).sum(1)]
    far = (np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m)) * side / 3) ** 2
    kernel = np.fft.rfft2(1 / (1 + far[:, None] + far) ** 2)
    felt = []
    for charge in charges:
        grid = sum(np.bincount(place, weight * charge, m * m) for place, weight in at).reshape(m, m)
        spread_out = np.fft.irfft2(np.fft.rfft2(grid, (2 * m, 2 * m)) * kernel, (2 * m, 2 * m))[:m, :m].ravel()
        felt.append(sum(weight * spread_out[place] for place, weight in at))
    nodes = [(i, j) for i in range(3) for j in range(3)]
    alone = sum(at[p][1] * at[q][1] / (1 + far[abs(nodes[p][0] - nodes[q][0])] + far[abs(nodes[p][1] - nodes[q][1])]) ** 2 for p in range(9) for q in range(9))
    total = ((1 + charges[3]) * felt[0] - 2 * (y[:, 0] * felt[1] + y[:, 1] * felt[2]) + felt[3] - alone).sum()
    return y * felt[0][:, None] - np.stack(felt[1:3], 1), float(total)


def tsne_near(d: np.ndarray, near: np.ndarray, start: np.ndarray, perplexity: float, iters: int = 300) -> np.ndarray:
    """2-D embedding of many points: affinities to each one's nearest points only, ``d`` and ``near`` (n, k), and ``repulsion``.

    Memory and work of a step grow with n * k.
    """
    n = len(d)
    p = _affinities(d, perplexity) / (2 * n)

    def gradient(y: np.ndarray, push: float) -> np.ndarray:
        apart = [y[:, c, None] - y[:, c][near] for c in (0, 1)]
        pull = p * push / (1 + apart[0] ** 2 + apart[1] ** 2)
        force = [pull * x for x in apart]
        both = np.stack([f.sum(1) - np.bincount(near.ravel(), f.ravel(), n) for f in force], 1)
        away, total = repulsion(y)
        return 4 * (both - away / total)

    return _descended(start, gradient, iters)

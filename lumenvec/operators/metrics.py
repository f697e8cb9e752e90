"""How two sets of vectors are spread: means, kernels, transport, neighbours, ranks.

Pairs are met in tiles (``blocks.tiled``): what leaves a pair of tiles is k rows a point, a count or a
sum. Only the matrices themselves, and the rank correlation of few points, are tables of pairs.
Work stays quadratic, so large sides are sampled first, at the caller's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.functions import vectors as V
from lumenvec.operators import sampling
from lumenvec.operators.blocks import knn, small_matrix, steps, tiled, tiled_within
from lumenvec.operators.cluster import KMeansVec, spread_centroids
from lumenvec.operators.order import checkpointed, mean_ranks, numbered
from lumenvec.operators.prepare import mean_vector, preprocessed
from lumenvec.operators.solvers import gromov_wasserstein, hungarian

#: Largest side whose distances to itself are held on the driver, for Gromov-Wasserstein.
MOST_POINTS = 5_000


def _checked(points: DataFrame) -> DataFrame:
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points; sample first")
    return points


def _same_width(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(x.shape[1], y.shape[1])
    return tuple(np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (x, y))


def _values(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    d = x @ y.T
    if kind == "cosine_distance":
        return np.maximum(1 - d, 0)
    if kind == "squared":
        return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * d, 0)
    return d


def pair_values(left: DataFrame, right: DataFrame, kind: str, upper: bool = False) -> DataFrame:
    """``i, j, d`` for all pairs of two sides ``(id, vec)``, by block products.

    kind: ``dot``; ``cosine_distance`` (one minus the product, clamped at 0: a cosine only for unit
    vectors); ``squared`` (squared distance by expansion, clamped at 0). With ``upper`` only pairs
    with i < j.
    """

    def block(one: tuple, other: tuple) -> Iterator[list[np.ndarray]]:
        ids, (x, y) = (one[0], other[0]), _same_width(one[1], other[1])
        for at in steps(len(x), len(y)):
            d = _values(x[at], y, kind).ravel()
            i, j = np.repeat(ids[0][at], len(y)), np.tile(ids[1], len(x[at]))
            keep = i < j if upper else slice(None)
            yield [i[keep], j[keep], d[keep]]

    return tiled(left, right, block, "i long, j long, d double")


def all_pair_cosine_mean(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean inner product over all pairs, as the product of the means: no pair is formed."""
    a, b = mean_vector(left).withColumnRenamed("mean", "a"), mean_vector(right).withColumnRenamed("mean", "b")
    return a.crossJoin(b).select(V.dot(F.col("a"), F.col("b")).alias("all_pair_cosine_mean"))


def paired_cosine_mean(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.select("id", V.doubles("vec").alias("x")).join(right.select("id", V.doubles("vec").alias("y")), "id")
    cosine = V.dot(F.col("x"), F.col("y")) / (F.greatest(V.norm(F.col("x")), F.lit(1e-8)) * F.greatest(V.norm(F.col("y")), F.lit(1e-8)))
    return both.agg(F.avg(cosine).alias("same_index_cosine_mean"))


def cos_sim_matrix(left: DataFrame, right: DataFrame) -> DataFrame:
    """``i, j, s``: cosines without a floor under the lengths; a zero vector's are null."""
    bare = []
    for side in (left, right):
        rows = side.select("id", V.doubles("vec").alias("vec")).withColumn("_n", V.norm(F.col("vec")))
        divided = F.transform("vec", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(float("nan")))
        bare.append(rows.select("id", divided.alias("vec")))
    return pair_values(*bare, "dot").select("i", "j", F.nanvl("d", F.lit(None).cast("double")).alias("s"))


def squared_distances(left: DataFrame, right: DataFrame) -> DataFrame:
    return pair_values(left, right, "squared")


def cosine_distances(left: DataFrame, right: DataFrame) -> DataFrame:
    return pair_values(left, right, "cosine_distance")


#: Parts of the kernel discrepancy, and how often a pair of tiles counts in each.
VISION, TEXT, CROSS = range(3)


def _squared(one: tuple, other: tuple) -> Iterator[tuple[int, int, np.ndarray]]:
    """Part, weight and squared distances of two tiles of both sides' points, a bounded number at a time.

    ``extra`` is 0 or 1 for the side. A pair of one side counts in both directions, within a tile as
    two pairs and between tiles by its weight.
    """
    sides = [[t[1][t[2] == k] for k in (0, 1)] for t in ((one, other) if len(other[0]) else (one,))]
    if len(sides) == 1:
        (v, t), = sides
        met = [(VISION, 1, v, v), (TEXT, 1, t, t), (CROSS, 1, v, t)]
    else:
        (v, t), (w, u) = sides
        met = [(VISION, 2, v, w), (TEXT, 2, t, u), (CROSS, 1, v, u), (CROSS, 1, w, t)]
    for part, weight, x, y in met:
        x, y = _same_width(x, y)
        for at in steps(len(x), len(y)):
            yield part, weight, _values(x[at], y, "squared").ravel()


def _lower_median(met: Callable[[Callable, str], DataFrame], least: float) -> float | None:
    """Exact lower median of the squared distances above ``least`` over all three parts.

    The bit patterns of positive doubles are in the order of their values, so it is found 16 bits
    at a time from counts of at most 65,536 bins.
    """
    prefix, rank = 0, None
    for shift in (48, 32, 16, 0):

        def count(one: tuple, other: tuple, shift: int = shift, prefix: int = prefix) -> Iterator[list[np.ndarray]]:
            bins = np.zeros(1 << 16, np.int64)
            low, high = ((np.array(prefix + k << shift + 16, np.uint64).view(np.float64) for k in (0, 1)) if shift < 48 else (0, np.inf))
            for _, weight, d in _squared(one, other):
                bits = d[(d > least) & (d >= low) & (d < high)].view(np.int64)
                bins += weight * np.bincount(bits >> shift & 0xFFFF, minlength=1 << 16)
            seen = np.flatnonzero(bins)
            yield [seen, bins[seen]]

        bins = sorted((row["b"], row["n"]) for row in met(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect())
        if rank is None:
            total = sum(n for _, n in bins)
            if not total:
                return None
            rank = -(-total // 2)
        for value, n in bins:
            if rank <= n:
                break
            rank -= n
        prefix = prefix << 16 | value
    return float(np.array(prefix, np.uint64).view(np.float64))


def mmd_rbf(left: DataFrame, right: DataFrame, sigma: float | None = None) -> DataFrame:
    """Squared kernel discrepancy with the diagonal kept, and the kernel's width.

    Width by default: root of half the lower median of the positive distances (self pairs and
    rounding noise below 1e-9 left out), at least 1e-6; 1 if there is none.
    """
    sides = [rows.select("id", V.doubles("vec").alias("vec"), F.lit(k).alias("side_of")) for k, rows in enumerate((left, right))]
    met = tiled_within(sides[0].unionAll(sides[1]), "side_of")
    if sigma is None:
        median = _lower_median(met, 1e-9)
        sigma = 1.0 if median is None else max((median / 2) ** 0.5, 1e-6)

    def kernel(one: tuple, other: tuple) -> Iterator[list[np.ndarray]]:
        total, n = np.zeros(3), np.zeros(3, np.int64)
        for part, weight, d in _squared(one, other):
            total[part] += weight * np.exp(-d / (2 * sigma * sigma)).sum()
            n[part] += weight * len(d)
        yield [np.arange(3), total, n]

    sign = F.when(F.col("part") == CROSS, -2.0).otherwise(1.0)
    means = met(kernel, "part int, total double, n long").groupBy("part").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return means.agg(F.sum(F.col("mean") * sign).alias("mmd_rbf"), F.lit(float(sigma)).alias("mmd_sigma"))


def kth_radius(points: DataFrame, k: int) -> DataFrame:
    """``id, radius``: distance to the k-th nearest other point; k is at most the number of others."""
    n = points.count()
    if n < 2:
        raise ValueError("fewer than two points")
    near = knn(points, points, min(k, n - 1), "dot", keep_self=False)
    return near.filter(F.col("rank") == min(k, n - 1)).select("id", F.greatest(1 - F.col("score"), F.lit(0.0)).alias("radius"))


def precision_recall_coverage(vision: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """Precision of text in vision, recall of vision in text, their F1, and coverage both ways.

    A point is inside if its nearest point of the other side has it within that point's radius to
    its own k-th neighbour.
    """
    of_text, of_vision = (
        knn(a, b, 1, "dot").select(F.col("other_id").alias("id"), F.greatest(1 - F.col("score"), F.lit(0.0)).alias("d")) for a, b in ((text, vision), (vision, text))
    )

    def inside(near: DataFrame, points: DataFrame, share: str, seen: str) -> DataFrame:
        n = points.count()
        return near.join(kth_radius(points, k), "id").agg(
            F.avg((F.col("d") <= F.col("radius")).cast("double")).alias(share), (F.countDistinct("id") / n).alias(seen)
        )

    p = inside(of_text, vision, "precision_text_in_vision", "coverage_vision_by_text")
    r = inside(of_vision, text, "recall_vision_in_text", "coverage_text_by_vision")
    both = p.crossJoin(r)
    total = F.col("precision_text_in_vision") + F.col("recall_vision_in_text")
    return both.select(
        "*",
        F.when(total > 0, 2 * F.col("precision_text_in_vision") * F.col("recall_vision_in_text") / total).otherwise(0.0).alias("precision_recall_f1"),
        F.lit(k).alias("coverage_knn_k"),
    )


#: Pairs up to which the rank correlation ranks a table of them; beyond, bins that their values fall into.
MOST_RANKED, RANK_BINS = 1 << 24, 1 << 18


def pairwise_spearman(vision: DataFrame, text: DataFrame, most_ranked: int = MOST_RANKED) -> DataFrame:
    """Rank correlation of both sides' similarities over pairs of equal ids; ties get mean ranks.

    Up to ``most_ranked`` pairs are a table, ranked by ranges of the values. No larger table arises:
    all pairs are counted in bins, and each has the mean rank of its bin (``_binned_spearman``).
    """
    n = vision.select("id").join(text.select("id"), "id").count()
    if n * (n - 1) // 2 > most_ranked:
        return _binned_spearman(vision, text)

    def similarities(side: DataFrame, name: str) -> DataFrame:
        return pair_values(side, side, "dot", upper=True).withColumnRenamed("d", name)

    both = checkpointed(similarities(vision, "a").join(similarities(text, "b"), ["i", "j"]).select("a", "b"))
    ranked = mean_ranks(mean_ranks(both, "a", "ra"), "b", "rb")
    r = F.corr("ra", "rb")
    return ranked.agg(F.when(F.isnan(r) | r.isNull(), 0.0).otherwise(r).alias("pairwise_spearman"))


def _coarse(v: np.ndarray) -> np.ndarray:
    """The first 16 bits of numbers in the order of their values."""
    bits = (v + 0.0).view(np.int64) >> 48
    return np.where(bits < 0, ~bits & 0x7FFF, bits + 0x8000)


def _edges() -> tuple[np.ndarray, np.ndarray]:
    """Least and largest number of each value of ``_coarse``."""
    size = np.arange(1 << 15, dtype=np.uint64) << np.uint64(48)
    least, most = size.view(np.float64), (size | np.uint64((1 << 48) - 1)).view(np.float64)
    return np.concatenate([-most[::-1], least]), np.concatenate([-least[::-1], most])


def _binned_spearman(vision: DataFrame, text: DataFrame, bins: int = RANK_BINS) -> DataFrame:
    """``pairwise_spearman`` by three passes over all pairs, of which counts and a sum leave a task.

    Numbers that share their first 16 bits make a coarse bin; each is cut into equal bins by its share
    of the pairs. A pair's rank is off by less than half the count of its bin, and the ranks in a bin by
    nothing on average, so little is lost: 4e-9 over 13 million pairs.
    """
    left, right = (rows.select("id", V.doubles("vec").alias("vec")) for rows in (vision, text))
    split = left.agg(F.max(F.size("vec"))).first()[0] or 0
    padded = F.concat(F.col("vec"), F.array_repeat(F.lit(0.0), F.lit(split) - F.size("vec")))
    points = left.withColumn("vec", padded).join(right.withColumnRenamed("vec", "_other"), "id").select("id", F.concat("vec", "_other").alias("vec"))
    met = tiled_within(points)

    def values(one: tuple, other: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        within = not len(other[0])
        x, y = one[1], (one if within else other)[1]
        for at in steps(len(x), len(y)):
            keep = np.arange(len(x))[at, None] < np.arange(len(y)) if within else slice(None)
            yield tuple((u @ w.T)[keep].ravel() for u, w in ((x[at, :split], y[:, :split]), (x[at, split:], y[:, split:])))

    def counted(place: Callable[[np.ndarray, int], np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        def count(one: tuple, other: tuple) -> Iterator[list[np.ndarray]]:
            found = [np.zeros(size, np.int64) for size in sizes]
            for pair in values(one, other):
                for k, v in enumerate(pair):
                    found[k] += np.bincount(place(v, k), minlength=sizes[k])
            for k, counts in enumerate(found):
                seen = np.flatnonzero(counts)
                yield [np.full(len(seen), k), seen, counts[seen]]

        out = [np.zeros(size, np.int64) for size in sizes]
        table = met(count, "side int, b int, n long").groupBy("side", "b").agg(F.sum("n").alias("n")).toArrow()
        side, b, n = (table[c].to_numpy() for c in ("side", "b", "n"))
        for k in (0, 1):
            out[k][b[side == k]] = n[side == k]
        return out

    cuts = []
    for counts in counted(lambda v, _: _coarse(v), [1 << 16] * 2):
        parts = -(-counts * bins // max(1, int(counts.sum())))
        low, high = _edges()
        width = np.subtract(high, low, out=np.ones(1 << 16), where=parts > 0)
        cuts.append((np.where(parts > 0, low, 0.0), width, np.maximum(parts, 1), np.cumsum(parts) - parts))
    context = vision.sparkSession.sparkContext
    sent = context.broadcast(cuts)

    def place(v: np.ndarray, k: int) -> np.ndarray:
        low, width, parts, before = sent.value[k]
        c = _coarse(v)
        return before[c] + np.minimum((v - low[c]) / width[c] * parts[c], parts[c] - 1).astype(np.int64)

    ranks = []
    for counts in counted(place, [int(c[3][-1] + c[2][-1]) for c in cuts]):
        ranks.append((np.cumsum(counts) - counts / 2 - counts.sum() / 2) / max(1, counts.sum()))
        ranks[-1] = (ranks[-1], float((ranks[-1] ** 2 * counts).sum()))
    ranked = context.broadcast([r for r, _ in ranks])

    def product(one: tuple, other: tuple) -> Iterator[list[np.ndarray]]:
        yield [np.array([sum(float(ranked.value[0][place(a, 0)] @ ranked.value[1][place(b, 1)]) for a, b in values(one, other))])]

    scale = (ranks[0][1] * ranks[1][1]) ** 0.5
    return met(product, "r double").agg((F.coalesce(F.sum("r"), F.lit(0.0)) / F.lit(scale) if scale else F.lit(0.0)).alias("pairwise_spearman"))


def retrieval_top1_rank(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of points whose own partner is the most similar one, and the partner's average rank."""
    unit_l, unit_r = preprocessed(left.select("id", "vec"), "l2"), preprocessed(right.select("id", "vec"), "l2")
    own = unit_l.join(unit_r.select("id", F.col("vec").alias("_other")), "id").select("id", "vec", V.dot(F.col("vec"), F.col("_other")).alias("own"))

    def better(one: tuple, other: tuple) -> Iterator[list[np.ndarray]]:
        (i, x, own), (j, y, _) = one, other
        for at in steps(len(x), len(y)):
            # Beyond rounding: an equal score does not rank before the partner's.
            yield [i[at], ((x[at] @ y.T > own[at, None] + 1e-12) & (i[at, None] != j)).sum(1)]

    ranks = tiled(own, unit_r, better, "id long, n long", extra="own").groupBy("id").agg((1 + F.sum("n")).alias("r"))
    return ranks.agg(F.avg((F.col("r") == 1).cast("double")).alias("top1"), F.avg("r").alias("avg_rank"))


def cluster_wasserstein(vision: DataFrame, text: DataFrame, k: int, seed: int, num_iters: int = 10) -> tuple[float, int]:
    """Mean distance of both sides' k centroids under the best matching; and k as clamped."""
    k = min(k, vision.count(), text.count())
    if k < 2:
        raise ValueError("k must be at least 2")
    a, b = (
        KMeansVec(k, num_iters, "l2", salt).fit(side, spread_centroids(side, k, salt)).centroids for side, salt in ((vision, seed), (text, seed + 1))
    )
    cost = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    return float(cost[np.arange(k), hungarian(cost)].mean()), k


def gw_distance(vision: DataFrame, text: DataFrame, epsilon: float = 0.05, iters: int = 20, sinkhorn_iters: int = 50) -> float:
    """Entropic Gromov-Wasserstein distance of the cosine geometries of two small samples."""

    def distances(side: DataFrame) -> np.ndarray:
        x = small_matrix(_checked(side), "id", "vec")[1]
        return np.maximum(1 - x @ x.T, 0)

    return gromov_wasserstein(distances(vision), distances(text), epsilon, iters, sinkhorn_iters)


def distribution_metrics(
    vision: DataFrame, text: DataFrame, preprocess: str = "center_l2", max_points: int = 2000, mmd_points: int = 2000, k: int = 50,
    knn_k: int = 5, spearman_points: int = 1000, gw_points: int = 300, gw_epsilon: float = 0.05, gw_iters: int = 20, sinkhorn_iters: int = 50, seed: int = 42,
) -> dict:
    """All metrics of two sides ``(id, vec)`` as one flat record.

    The sample is centred after sampling. MMD and GW sample each side anew, the rank correlation
    takes the first ids.
    """
    v, t, paired = sampling.sample_pair(vision, text, max_points, seed)
    v, t = (checkpointed(preprocessed(d, preprocess)) for d in (v, t))
    out = all_pair_cosine_mean(v, t).first().asDict()
    out["same_index_cosine_mean"] = paired_cosine_mean(v, t).first()[0] if paired else None
    sv, st = sampling.sample_points(v, mmd_points, seed), sampling.sample_points(t, mmd_points, seed + 1)
    out |= mmd_rbf(sv, st).first().asDict()
    out["kmeans_wasserstein"], out["kmeans_k"] = cluster_wasserstein(v, t, k, seed)
    out |= precision_recall_coverage(v, t, knn_k).first().asDict()
    n = min(spearman_points, v.count(), t.count())
    first = [numbered(d.select("id", "vec"), [F.col("id").asc()], "_at").filter(F.col("_at") < n).select(F.col("_at").alias("id"), "vec") for d in (v, t)]
    out |= pairwise_spearman(*first).first().asDict() | {"pairwise_spearman_n": n}
    gv, gt = sampling.sample_points(v, gw_points, seed), sampling.sample_points(t, gw_points, seed + 1)
    out |= {"gw_distance": gw_distance(gv, gt, gw_epsilon, gw_iters, sinkhorn_iters), "gw_epsilon": gw_epsilon}
    return out

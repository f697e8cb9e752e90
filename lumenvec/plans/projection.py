"""Two sets of vectors on one plane."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.operators.blocks import MOST_VALUES, apply_map, gram, knn, small_matrix
from lumenvec.operators.order import checkpointed
from lumenvec.operators.prepare import mean_vector
from lumenvec.operators.solvers import principal, tsne, tsne_near
from lumenvec.functions import vectors as V


def project_2d(vision: DataFrame, text: DataFrame, method: str = "pca", w: np.ndarray | None = None, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """``modality, id, x, y`` of sides ``(id, vec)``, and the variance shares of PCA.

    ``w`` maps the vision side first. PCA needs one scan for the mean, one for the d x d product and
    one for the points; t-SNE runs on the driver, beyond 8,192 points with their nearest points
    alone attracting each other.
    """
    if w is not None:
        vision = apply_map(vision.select("id", "vec"), w)
    both = vision.select(F.lit("vision").alias("modality"), "id", V.doubles("vec").alias("vec")).unionByName(
        text.select(F.lit("text").alias("modality"), "id", V.doubles("vec").alias("vec"))
    )
    columns = both.columns
    centred = both.crossJoin(F.broadcast(mean_vector(both))).withColumn("vec", V.minus(F.col("vec"), F.col("mean"))).select(*columns)
    axes, shares = principal(gram(centred))
    flat = apply_map(centred, axes)
    if method == "tsne":
        key = (F.col("id").cast("long") * 2 + (F.col("modality") == "text").cast("int")).alias("id")
        ids, flat_points = small_matrix(flat.select(key, "vec"), "id", "vec")
        perplexity = min(30, max(5, (len(ids) - 1) // 3))
        if len(ids) ** 2 <= MOST_VALUES:
            y = tsne(small_matrix(centred.select(key, "vec"), "id", "vec")[1], flat_points, perplexity)
        else:
            y = tsne_near(*_nearest(centred.select(key, "vec"), ids, 3 * perplexity + 1), flat_points, perplexity)
        table = pa.table({"modality": np.where(ids % 2 == 0, "vision", "text").tolist(), "id": ids // 2, "x": y[:, 0], "y": y[:, 1]})
        return both.sparkSession.createDataFrame(table), shares.tolist()
    if method != "pca":
        raise ValueError(f"unknown method {method}")
    return flat.select("modality", "id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), shares.tolist()


def _nearest(points: DataFrame, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places in ``ids`` of each point's ``k`` nearest others, which tasks find."""
    if len(ids) * k > MOST_VALUES:
        raise ValueError("too many points for t-SNE; sample first")
    found = knn(points, points, k, "l2", keep_self=False)
    table = found.select("id", "other_id", (-F.col("score")).cast("float").alias("d")).toArrow()
    own, other, d = (table[c].to_numpy() for c in ("id", "other_id", "d"))
    order = np.argsort(own, kind="stable")
    return np.maximum(d[order].astype(float), 0).reshape(len(ids), k), np.searchsorted(ids, other[order]).reshape(len(ids), k)


def panels(vision: DataFrame, text: DataFrame, method: str = "pca", w: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """``panel, modality, x, y, id``: the sides as they are, and beside it after the map ``w`` if there is one."""
    out = project_2d(vision, text, method, seed=seed)[0].select(F.lit("before").alias("panel"), "modality", "id", "x", "y")
    if w is None:
        return out
    return out.unionByName(project_2d(vision, text, method, w, seed)[0].select(F.lit("after").alias("panel"), "modality", "id", "x", "y"))


def write_panels(points: DataFrame, path: str, size: int = 480, radius: int = 2) -> None:
    """The panels as a scatter plot in a PNG file; tasks place the points, and a pixel of each kind is brought once."""
    from lumenvec.sources.files import replaced
    from lumenvec.sources.pixels import png, scatter

    points = checkpointed(points.select("panel", "modality", "x", "y"))
    ends = points.groupBy("panel").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")])
    at = [F.rint((F.col(c) - F.col(f"min_{c}")) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-12)) * (size - 1 - 2 * radius)).alias(c) for c in ("x", "y")]
    found = points.join(F.broadcast(ends), "panel").select("panel", "modality", *at).distinct().toPandas()
    colours = {"vision": (31, 119, 180), "text": (255, 127, 14)}
    shown = [
        [(part.loc[part["modality"] == m, ["x", "y"]].to_numpy(float), colours[m]) for m in ("vision", "text")]
        for part in (found[found["panel"] == name] for name in ("before", "after")) if len(part)
    ]
    with replaced(path, "wb") as out:
        out.write(png(scatter(shown, size, radius)))

"""Dense blocks: Arrow batches of vectors against a small matrix that is sent along.

Centroids and maps have a size fixed by the caller's k and dimension; ``small_matrix`` refuses
more than its bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lumenvec.operators.order import checkpointed

#: Values of 8 bytes that a matrix on the driver may have: 64 million, half a gigabyte. Arrow brings them as they are.
MOST_VALUES = 1 << 26


def small_matrix(rows: DataFrame, key: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a small table, by key; shorter vectors are padded with zeros."""
    slim = rows.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    size = slim.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("values")).first()
    width = max(0, size["d"] or 0)
    if max(size["n"] * width, size["values"]) > MOST_VALUES:
        raise ValueError("too large for the driver")
    found = slim.toArrow().sort_by("key").combine_chunks()
    if not found.num_rows:
        return np.zeros(0), np.zeros((0, width))
    return found["key"].to_numpy(), matrix(found["vec"].chunk(0), width)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows, padded or cut to ``width``."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(0))
    flat = np.asarray(column.flatten(), float)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out, ends = np.zeros((len(lengths), width)), np.cumsum(lengths)
    for k, (n, end) in enumerate(zip(lengths, ends, strict=True)):
        out[k, : min(n, width)] = flat[end - n : end][:width]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]


#: Distances that are held at once in an assignment.
DISTANCE_BLOCK = 1 << 22


def nearest(x: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Nearest row of ``c`` and its distance; ties to the first.

    Distances are ``1 - cosine``, squared L2, or minus the inner product (``ip``), for a bounded
    number of rows at a time.
    """
    label, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, DISTANCE_BLOCK // max(1, len(c)))
    centres, squares = (unit(c) if metric == "cosine" else c).T, (c * c).sum(1)
    for at in range(0, len(x), step):
        rows = x[at : at + step]
        if metric == "cosine":
            d = 1 - unit(rows) @ centres
        elif metric == "ip":
            d = -(rows @ centres)
        else:
            d = (rows * rows).sum(1)[:, None] + squares - 2 * (rows @ centres)
        label[at : at + step] = d.argmin(1)
        distance[at : at + step] = d.min(1)
    return label, distance


def assign(points: DataFrame, centroids: DataFrame, metric: str = "cosine", vec: str = "vec") -> DataFrame:
    """``points`` with ``cluster_id`` and ``distance`` of the nearest of ``centroids (centroid_id, vec)``.

    One pass without shuffle. A zero vector has cosine distance 1 to all and goes to the first.
    """
    ids, c = small_matrix(centroids, "centroid_id", "vec")
    if not len(ids):
        raise ValueError("no centroids")
    return assign_to(points, ids, c, metric, vec)


def assign_to(points: DataFrame, ids: np.ndarray, c: np.ndarray, metric: str, vec: str = "vec") -> DataFrame:
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric {metric}")
    sent = points.sparkSession.sparkContext.broadcast((ids, c))
    at = points.columns.index(vec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = sent.value
        for batch in batches:
            label, distance = nearest(matrix(batch.column(at), c.shape[1]), c, metric)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids[label].astype(np.int32)), pa.array(distance)], [*batch.schema.names, "cluster_id", "distance"]
            )

    schema = StructType([*points.schema.fields, StructField("cluster_id", IntegerType()), StructField("distance", DoubleType())])
    return points.mapInArrow(run, schema)


def apply_map(points: DataFrame, w: np.ndarray, vec: str = "vec") -> DataFrame:
    """``points`` with ``vec`` replaced by ``vec @ w``."""
    if w.ndim != 2:
        raise ValueError("the map must be a matrix")
    if w.size > MOST_VALUES:
        raise ValueError("the map is too large to send along")
    sent = points.sparkSession.sparkContext.broadcast(w)
    at = points.columns.index(vec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widest = pc.max(pc.list_value_length(batch.column(at))).as_py() or 0
            if widest > sent.value.shape[0]:
                raise ValueError(f"vectors of {widest} components do not fit a map of {sent.value.shape[0]} rows")
            y = matrix(batch.column(at), sent.value.shape[0]) @ sent.value
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = StructType([StructField(f.name, points.select(F.col(vec).cast("array<double>")).schema[0].dataType) if f.name == vec else f for f in points.schema.fields])
    return points.mapInArrow(run, schema)


#: Tiles that a side is cut into at most, so that what is shuffled grows as the rows do; beyond TILE_BYTES a tile there are more.
MOST_TILES, TILE_BYTES = 8, 1 << 27

#: Pairs that are held at once.
PAIR_BLOCK = 1 << 20


def tiles_of(rows: DataFrame, tile: int, most: int = MOST_TILES) -> int:
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    return max(1, min(most, -(-size["n"] // tile)), -(-size["n"] * max(1, size["d"] or 1) * 8 // TILE_BYTES))


def steps(n: int, m: int) -> Iterator[slice]:
    """Cuts of ``n`` rows that have about PAIR_BLOCK pairs with ``m`` others."""
    step = max(1, PAIR_BLOCK // max(1, m))
    return (slice(at, at + step) for at in range(0, n, step))


def _slim(rows: DataFrame, extra: str | None, *more: Column) -> DataFrame:
    value = F.col(extra) if extra else F.lit(None)
    return rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), value.cast("double").alias("extra"), *more)


def _met(rows: DataFrame, block: Callable, schema: str, alone: bool = False) -> DataFrame:
    """What ``block`` makes of each partition of ``id, vec, extra, side``; ``alone`` if side 1 may be empty."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by([("side", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, vec, extra = table["id"].to_numpy(), table["vec"].chunk(0), table["extra"].to_numpy()
        x = matrix(vec, int(pc.max(pc.list_value_length(vec)).as_py() or 0))
        n = int((table["side"].to_numpy() == 0).sum())
        if n == 0 or (n == len(ids) and not alone):
            return
        for columns in block((ids[:n], x[:n], extra[:n]), (ids[n:], x[n:], extra[n:])):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return rows.select("id", "vec", "extra", "side").mapInArrow(run, schema)


def tiled(left: DataFrame, right: DataFrame, block: Callable, schema: str, extra: str | None = None, tile: int = 1024) -> DataFrame:
    """What ``block`` makes of each pair of tiles of two tables ``(id, vec)``.

    Both are cut into tiles of ``tile`` rows or more by a hash of the id, MOST_TILES at most, and each
    pair of tiles is one task's work; neither side is collected or broadcast, and no table of pairs
    arises but what ``block`` returns. It gets ids, vectors and the left's column ``extra`` of both
    tiles, in order of id, and yields lists of columns, for as many rows at a time as it likes.
    """
    tiles = [tiles_of(d, tile) for d in (left, right)]

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(tiles[side])).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit(tiles[1 - side] - 1)))
        mine, theirs = ("qt", "bt") if side == 0 else ("bt", "qt")
        return _slim(rows, None if side else extra, F.lit(side).alias("side"), own.alias(mine), others.alias(theirs))

    both = dealt(left, 0).unionByName(dealt(right, 1)).repartitionById(tiles[0] * tiles[1], F.col("qt") * tiles[1] + F.col("bt"))
    return _met(both, block, schema)


def tiled_within(points: DataFrame, extra: str | None = None, tile: int = 1024, most: int = 12) -> Callable[[Callable, str], DataFrame]:
    """As ``tiled``, for one table with itself, each two tiles once: a function of ``block`` and ``schema``.

    Tiles are dealt out once, to a checkpoint, for any number of passes. Of a tile with itself
    ``block`` gets an empty second side.
    """
    tiles = tiles_of(points, tile, most)
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    rows = _slim(points, extra, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    place = (low * (2 * tiles - 1 - low) / 2).cast("int") + high
    dealt = rows.withColumn("side", (F.col("own") > low).cast("int")).repartitionById(tiles * (tiles + 1) // 2, place)
    dealt = checkpointed(dealt.select("id", "vec", "extra", "side"))
    return lambda block, schema: _met(dealt, block, schema, alone=True)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", keep_self: bool = True, tile: int = 1024) -> DataFrame:
    """``id, rank, other_id, score`` of the ``k`` best of ``base (id, vec)`` for each of ``queries (id, vec)``.

    k rows for each query leave a pair of tiles, and the best of these are taken at the end. Score is
    the cosine, the inner product (``dot``) or minus the squared distance (``l2``); ties go to the
    smaller id.
    """

    def block(left: tuple, right: tuple) -> Iterator[list[np.ndarray]]:
        (qi, q, _), (bi, b, _) = left, right
        if metric == "cosine":
            q, b = unit(q), unit(b)
        for at in steps(len(q), len(b)):
            rows = q[at]
            s = rows @ b.T
            if metric == "l2":
                s = -((rows * rows).sum(1)[:, None] + (b * b).sum(1) - 2 * s)
            if not keep_self:
                s = np.where(qi[at, None] == bi, -np.inf, s)
            if k == 1:
                least = s.max(1, keepdims=True)
            elif k < s.shape[1]:  # all that reach the k-th score, then in order
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
            else:
                least = np.full((len(s), 1), -np.inf)
            i, j = np.nonzero((s >= least) & (s > -np.inf))
            order = np.lexsort((j, -s[i, j], i))
            i, j = i[order], j[order]
            first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) if len(i) else i
            i, j = i[place < k], j[place < k]
            yield [qi[at][i], bi[j], s[i, j]]

    pairs = tiled(queries, base, block, "id long, other_id long, score double", tile=tile)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "other_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", F.col("rank").cast("int").alias("rank"), "other_id", "score")


def cross_gram(left: DataFrame, right: DataFrame) -> np.ndarray:
    """``X^T Y`` over rows of equal id: one partial product a batch, added up on the way."""
    both = left.select("id", F.col("vec").alias("x")).join(right.select("id", F.col("vec").alias("y")), "id").select("x", "y")
    size = both.agg(F.max(F.size("x")), F.max(F.size("y"))).first()
    d = max(size[0] or 0, size[1] or 0)
    if d * d > MOST_VALUES:
        raise ValueError("too large for the driver")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            total += matrix(batch.column(0), d).T @ matrix(batch.column(1), d)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    out = np.zeros((d, d))
    for r in both.mapInArrow(run, StructType([StructField("i", LongType()), StructField("j", LongType()), StructField("x", DoubleType())])).groupBy("i", "j").agg(F.sum("x")).collect():
        out[r[0], r[1]] = r[2]
    return out


def gram(points: DataFrame, vec: str = "vec") -> np.ndarray:
    """``X^T X`` of all vectors, in one pass."""
    d = points.agg(F.max(F.size(vec))).first()[0] or 0
    if d * d > MOST_VALUES:
        raise ValueError("too large for the driver")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, max(1, d), dtype=np.int32)), pa.array(total.ravel()))], ["i", "row"])

    parts = points.select(F.col(vec).cast("array<double>")).mapInArrow(run, "i long, row array<double>")
    return small_matrix(parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")), "i", "row")[1]

"""Near duplicates among embeddings by int8 tile products with rigorous error bounds.

Vectors are compared only within a label. Equal vectors are compared once and counted. Each is scaled
to unit length and quantised to int8 with a scale of its own; with q the quantised unit vector and
e = u - q its error, |u.v - q.q'| <= |q||e'| + |e||q'| + |e||e'|. Each label is cut into tiles by a
hash, and each pair of tiles is one task's unit of work, to which only codes, scales and norms are
sent. Pairs whose int8 product is below the threshold by more than the bound are no links, those above
it by more than the bound are. Where the bound leaves it open, the vectors concerned (not the pairs)
are sent to their pair of tiles once more, and these pairs are computed in double precision.

A vector that is null, empty, zero or holds a null or non-finite component, or whose label is null,
links with nothing. A null id links with nothing, has no component and is not kept. Repeated rows
count as vectors of their own. An empty table gives an empty result. Vectors of unequal length
never link. Extra columns are ignored. No cap is set on partners: for a hot label the number of tiles
grows, for copies the counts do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import Labels, by_key, checkpointed, components, small_batches, star

EXACT = 1024  # int8 products of this many components are exact in single precision


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the quantised vectors and of their errors."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(unit - rounded, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = np.float32 if a.shape[1] <= EXACT else np.float64
    return a.astype(kind) @ b.astype(kind).T


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def bounded(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], least: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of two quantised tables that may have a cosine >= ``least``, and whether they surely do."""
    (lc, ls, ln, le), (rc, rs, rn, re) = left, right
    for k in range(0, len(lc), block):
        p = slice(k, k + block)
        near = _product(lc[p], rc) * (ls[p][:, None] * rs)
        bound = ln[p][:, None] * re + le[p][:, None] * (rn + re) + 1e-9
        i, j = np.nonzero(near + bound >= least)
        yield k + i, j, (near - bound)[i, j] >= least


def exactly(left: np.ndarray, right: np.ndarray, least: float, pairs: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the open pairs of ``bounded`` whose cosine in double precision is >= ``least``."""
    for i, j, sure in bounded(quantise(_unit(left)), quantise(_unit(right)), least):
        i, j = i[~sure], j[~sure]
        for k in range(0, len(i), pairs):
            x, y = i[k : k + pairs], j[k : k + pairs]
            near = _exact(left[x], right[y]) >= least
            yield x[near], y[near]


QUANTISED = "codes binary, scale double, length double, error double"


def _quantised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("v"))
        dims = np.asarray(lists.value_lengths())
        codes, numbers = np.empty(batch.num_rows, object), np.zeros((3, batch.num_rows))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            q, *numbers_of = quantise(_unit(lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)))
            codes[at] = [row.tobytes() for row in q]
            numbers[:, at] = numbers_of
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(codes, pa.binary()), *[pa.array(x) for x in numbers]], [*batch.schema.names, "codes", "scale", "length", "error"]
        )


class _Cell:
    """What one pair of tiles finds: link counts, and what is connected."""

    def __init__(self, key: tuple, cell: pa.Table):
        self.key = key
        self.node, self.h, self.n, self.t = (cell.column(c).to_numpy() for c in ("node", "h", "n", "t"))
        self.a, self.b = np.flatnonzero(self.t == key[2]), np.flatnonzero(self.t == key[3])
        self.count, self.labels = np.zeros(len(self.node), np.int64), Labels(len(self.node))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.count, x, self.n[y])
        if self.key[2] != self.key[3]:  # else each pair comes in both orders
            np.add.at(self.count, y, self.n[x])
        self.labels.merge(x, y)

    def found(self, open_: np.ndarray) -> pa.RecordBatch:
        """Rows of three kinds: link counts of vectors (0), spanning links (1), vectors with open pairs (2)."""
        hit, (near, to) = np.flatnonzero(self.count), star(np.arange(len(self.node)), self.labels.root)
        at = np.concatenate([hit, near, np.flatnonzero(open_)])
        kind = np.repeat([0, 1, 2], [len(hit), len(near), int(open_.sum())])
        other = np.concatenate([hit, to, np.flatnonzero(open_)])
        label, dim, i, j = self.key
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kind.astype(np.int8)), *[pa.array(np.full(len(at), x), kind_) for x, kind_ in ((label, pa.int64()), (dim, pa.int32()), (i, pa.int32()), (j, pa.int32()))],
                pa.array(self.node[at]), pa.array(self.h[at]), pa.array(np.where(kind == 0, self.count[at], 0)), pa.array(self.node[other]),
            ],
            ["kind", "label", "dim", "i", "j", "node", "h", "links", "to"],
        )


FOUND = "kind byte, label long, dim int, i int, j int, node long, h long, links long, to long"


def near_duplicates(vectors: DataFrame, least: float = 0.93, tile: int = 4096) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors (vec_id, embedding, label)``."""
    parts = F.col("embedding").cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists(parts, lambda x: x != 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(sound, F.col("label").cast("long")).alias("label"),
        F.when(sound, F.transform(parts, lambda x: x + F.lit(0.0))).alias("v"),  # -0.0 becomes 0.0
    ).select("*", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"))
    # Equal vectors have both hashes equal, of 128 bits in all.
    keys = ["label", "h", "h2"]
    once = checkpointed(
        rows.filter("v is not null").groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v"))
    )
    # A tile's number of rows is bounded; the table below has a row for each label and length.
    shape = (
        once.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("_rows"))
        .select("label", "dim", F.ceil(F.col("_rows") / tile).cast("int").alias("tiles"))
    )
    tiled = (
        once.withColumn("dim", F.size("v")).join(shape, ["label", "dim"])
        .select("label", "dim", "tiles", F.pmod("h", F.col("tiles")).cast("int").alias("t"), "node", "h", "n", "v")
    )
    cell = ["label", "dim", "i", "j"]

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in by_key(batches, cell):
            x = _Cell(key, part)
            codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.int8).reshape(len(x.node), key[1])
            numbers = [part[c].to_numpy() for c in ("scale", "length", "error")]
            open_ = np.zeros(len(x.node), bool)
            for i, j, sure in bounded(*[(codes[at], *[v[at] for v in numbers]) for at in (x.a, x.b)], least):
                i, j = x.a[i], x.b[j]
                apart = i != j
                x.add(i[sure & apart], j[sure & apart])
                open_[i[~sure & apart]] = open_[j[~sure & apart]] = True
            yield x.found(open_)

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in by_key(batches, cell):
            x = _Cell(key, part)
            v = part["v"].combine_chunks()
            v = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy().reshape(-1, key[1])
            for i, j in exactly(v[x.a], v[x.b], least):
                i, j = x.a[i], x.b[j]
                apart = i != j
                x.add(i[apart], j[apart])
            yield x.found(np.zeros(len(x.node), bool))

    # Each tile goes to every pair of tiles that it is part of.
    names = [c.split()[0] for c in QUANTISED.split(", ")]
    coded = small_batches(tiled).mapInArrow(_quantised, f"label long, dim int, tiles int, t int, node long, h long, n long, v array<double>, {QUANTISED}")
    dealt = (
        coded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "dim", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), "t", "node", "h", "n", *names)
        .repartition(*cell).sortWithinPartitions(*cell)
    )
    sure = checkpointed(dealt.mapInArrow(first, FOUND))
    again = (
        sure.filter("kind = 2").select(*cell, F.col("node").alias("_node"), F.col("h").alias("_h")).distinct()
        .join(tiled.select(F.col("label").alias("_label"), "t", "node", "h", "n", "v"), (F.col("label") == F.col("_label")) & (F.col("_node") == F.col("node")) & (F.col("_h") == F.col("h")))
        .select(*cell, "t", "node", "h", "n", "v")
        .repartition(*cell).sortWithinPartitions(*cell)
    )
    found = checkpointed(sure.filter("kind < 2").unionByName(again.mapInArrow(second, FOUND)))
    roots = components(found.filter("kind = 1").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.filter("kind = 0").groupBy(F.col("label").alias("_label"), F.col("node").alias("_node"), F.col("h").alias("_h")).agg(F.sum("links").alias("_links"))
    classes = (
        once.join(counts, (F.col("label") == F.col("_label")) & (F.col("node") == F.col("_node")) & (F.col("h") == F.col("_h")), "left")
        .join(roots.withColumnRenamed("node", "_at"), F.col("node") == F.col("_at"), "left")
        .select(*[F.col(k).alias(f"{k}_of") for k in keys], (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_n"), F.coalesce("root", "node").alias("_root"))
    )
    same = (F.col("label") == F.col("label_of")) & (F.col("h") == F.col("h_of")) & (F.col("h2") == F.col("h2_of"))
    return rows.drop("v").join(classes, same, "left").select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_root", "vec_id"), F.lit(False)).alias("kept"),
    )

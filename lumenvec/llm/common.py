"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Where none is set, a temporary one is made and used from then on if all runs on this machine
    (``local[...]``, as in tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir()
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(df: DataFrame, records: int = 2000, megabytes: int = 32) -> DataFrame:
    """Bound the Arrow batches that Python functions over ``df`` get, by rows and by bytes.

    Spark has these settings for a session only, and reads them when a plan runs. They bound memory and
    change no result.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    return df


def by_key(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a partition that is sorted by ``keys`` (integers), one at a time.

    Memory holds one batch and one group.
    """
    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[s]) for c in columns)
            if key != open_key and parts:
                yield open_key, pa.Table.from_batches(parts)
                parts = []
            open_key = key
            parts.append(batch.slice(s, e - s))
    if parts:
        yield open_key, pa.Table.from_batches(parts)


class Labels:
    """Union-find over 0..n-1 that merges whole arrays of pairs; a root is its set's smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.root[left], self.root[right]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        pairs = np.unique(np.maximum(a, b) * len(self.root) + np.minimum(a, b))
        parent = self.root
        for pair in pairs.tolist():
            x, y = divmod(pair, len(parent))
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
        self.root = parent


def star(nodes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a set to the member with the smallest node id."""
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, nodes)
    to = least[roots]
    keep = nodes != to
    return nodes[keep], to[keep]


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges (a, b)`` as ``(node, root)``; root is the smallest node.

    Each round links a node and its smaller neighbours to the smallest of them, then skips one
    level of parents. Sums are taken before the shuffles (min, distinct), and what remains of a
    large hub is a sort-merge join that adaptive execution splits. Each round is checkpointed.
    Isolated nodes do not appear. Raises RuntimeError if ``most_rounds`` do not suffice.
    """
    now = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    before = _signature(now)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            now.join(least, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        parent = small.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("p"))
        now = checkpointed(
            small.join(parent, "b", "left")
            .select("a", F.coalesce("p", "b").alias("b"))
            .distinct()
        )
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return small_batches(df).mapInArrow(function, schema)


def ordered_sums(df: DataFrame, order: list[Column], values: dict[str, Column], parts: int = 16) -> DataFrame:
    """Add the sum of each of ``values`` over the rows before a row in a total order of the whole table.

    Rows are dealt out by ranges of the order; windows run inside a range, and the sums of whole
    ranges are added from a table of ``parts`` rows.
    """
    from pyspark.sql import Window as W

    named = {f"_value{k}": v for k, v in enumerate(values.values())}
    ranged = checkpointed(df.withColumns(named).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(F.col("_part").alias("_of")).agg(*[F.sum(n).alias(n) for n in named]).select(
        "_of", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before{n}") for n in named]
    )
    sums = {out: F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_before{n}") for out, n in zip(values, named, strict=True)}
    return ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).select(*df.columns, *[c.alias(out) for out, c in sums.items()])


def prefix_sums(df: DataFrame, group: str, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by ``part`` and then by ``order``. A window runs only inside one
    (group, part); the sums of whole parts are added from a table of one row for each part, so
    a hot group is spread over its parts.
    """
    from pyspark.sql import Window as W

    inside = W.partitionBy(group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        F.col(group).alias("_g"), F.col(part).alias("_p"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
    )
    ranked = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        ranked.join(offsets, (F.col(group) == F.col("_g")) & (F.col(part) == F.col("_p")))
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_g", "_p", "_before", "_inside")
    )

"""Dense numbers and ranks over a whole table without a window over the whole table.

Rows are dealt out by ranges of their order; what lies before a range is added from a table with one
row for each range.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``; a temporary one only where all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def sums_before(rows: DataFrame, order: list[Column], value: Column, out: str, parts: int = 32) -> DataFrame:
    """Add ``out``, the sum of ``value`` over all rows before each one in a total order."""
    ranged = checkpointed(rows.withColumn("_value", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)  # over one row a range
    offsets = ranged.groupBy(F.col("_part").alias("_of")).agg(F.sum("_value").alias("_sum")).select("_of", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_value").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).select(*rows.columns, (inside + F.col("_before")).alias(out))


def numbered(rows: DataFrame, order: list[Column], out: str, parts: int = 32) -> DataFrame:
    """Add ``out``, the place of each row in the order, from 0."""
    return sums_before(rows, order, F.lit(1).cast("long"), out, parts)


def mean_ranks(rows: DataFrame, column: str, out: str, parts: int = 32) -> DataFrame:
    """Add ``out``, the rank of ``column`` from 1; ties get their mean rank."""
    counts = rows.groupBy(F.col(column).alias("_key")).agg(F.count("*").alias("_n"))
    ranks = sums_before(counts, [F.col("_key").asc()], F.col("_n"), "_low", parts).select("_key", (F.col("_low") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(ranks, F.col(column) == F.col("_key")).drop("_key")

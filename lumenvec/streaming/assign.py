"""Assignment of a stream of vectors to frozen centroids, with running counts.

An extension of this library, not part of the batch workflows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenvec.operators.blocks import assign_to, small_matrix


def assigned(stream: DataFrame, centroids: DataFrame, metric: str = "cosine", vec: str = "vec") -> DataFrame:
    ids, c = small_matrix(centroids, "centroid_id", "vec")
    return assign_to(stream, ids, c, metric, vec)


def running_counts(stream: DataFrame, centroids: DataFrame, name: str, checkpoint: str, metric: str = "cosine") -> StreamingQuery:
    """Counts of each cluster, kept up to date in the in-memory table ``name``."""
    counts = assigned(stream, centroids, metric).groupBy("cluster_id").agg(F.count("*").alias("cnt"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()

"""The library's queries over the test tables, with equivalent DuckDB SQL.

Embeddings play the patches of images (25 to an image, on a grid of 5 by 5) and, by even and odd
ids, the two sides of a pair. Numbers are rounded to 6 decimals, since engines add up in different
order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions import images as I
from lumenvec.functions import vectors as V
from lumenvec.operators import blocks, cluster, matching, metrics, prepare, records, retrieval, sampling, solvers
from lumenvec.operators.order import shared_folder
from lumenvec.plans import alignment, image_query, projection
from lumenvec.streaming import assign as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            recursive = ", RECURSIVE " in sql  # the word belongs after WITH
            ORACLES[f.__name__] = COMMON.replace("WITH ", "WITH RECURSIVE ", 1) + sql.replace(", RECURSIVE ", ", ") if recursive else COMMON + sql
        return f

    return add


def r6(x: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


# Fixtures -------------------------------------------------------------------------------------

GRID = 5


def _e(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def _points(spark, sf) -> DataFrame:
    return _e(spark, sf).select(F.col("vec_id").alias("id"), "vec", "label")


def _patches(spark, sf) -> DataFrame:
    return _e(spark, sf).select(
        F.floor(F.col("vec_id") / 25).alias("image_index"), (F.col("vec_id") % 25).cast("int").alias("patch_index"), "vec", "vec_id", "label"
    )


def _side(spark, sf, odd: int) -> DataFrame:
    return _e(spark, sf).filter(F.col("vec_id") % 2 == odd).select(F.floor(F.col("vec_id") / 2).alias("id"), "vec")


def _small(spark, sf) -> DataFrame:
    return cluster.group_means(_e(spark, sf).withColumn("centroid_id", F.col("label").cast("int")), "centroid_id").select("centroid_id", "vec")


def _large(spark, sf) -> DataFrame:
    return cluster.group_means(_e(spark, sf).withColumn("centroid_id", (F.col("vec_id") % 40).cast("int")), "centroid_id").select("centroid_id", "vec")


def _assigned(spark, sf, metric: str = "cosine") -> DataFrame:
    return blocks.assign(_patches(spark, sf), _small(spark, sf), metric).drop("vec")


def _images(spark, sf) -> DataFrame:
    index = F.col("index")
    return (
        _patches(spark, sf).select(F.col("image_index").alias("index")).distinct()
        .withColumn("file_name", F.concat(F.lit("IMG_"), F.lpad(index.cast("string"), 12, "0"), F.lit(".jpg")))
        .withColumn("path", F.concat(F.lit("/images/"), "file_name"))
        .withColumn("orig_height", (301 + index * 7 % 50).cast("int")).withColumn("orig_width", (400 + index * 13 % 90).cast("int"))
    )


COMMON = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
 u AS (SELECT vec_id, v, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS n, label FROM e),
 vis AS (SELECT vec_id // 2 AS id, v, n FROM u WHERE vec_id % 2 = 0),
 txt AS (SELECT vec_id // 2 AS id, v, n FROM u WHERE vec_id % 2 = 1),
 d64 AS (SELECT unnest(range(1, 65)) AS i),
 sc AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT label AS c, i, avg(v[i]) AS m FROM e, d64 GROUP BY label, i) GROUP BY c),
 lc AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT (vec_id % 40)::INT AS c, i, avg(v[i]) AS m FROM e, d64 GROUP BY vec_id % 40, i) GROUP BY c),
 scn AS (SELECT c, v, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS n FROM sc),
 lcn AS (SELECT c, v, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS n FROM lc),
 ac AS (SELECT vec_id, vec_id // 25 AS image_index, (vec_id % 25)::INT AS patch_index, (arg_min(c, (d, c)))::INT AS cluster_id, min(d) AS distance
        FROM (SELECT vec_id, c, 1 - list_inner_product(u.n, scn.n) AS d FROM u, scn) GROUP BY vec_id),
 al AS (SELECT vec_id, vec_id // 25 AS image_index, (vec_id % 25)::INT AS patch_index, (arg_min(c, (d, c)))::INT AS cluster_id, min(d) AS distance
        FROM (SELECT vec_id, c, list_inner_product(e.v, e.v) + list_inner_product(sc.v, sc.v) - 2 * list_inner_product(e.v, sc.v) AS d FROM e, sc) GROUP BY vec_id),
 im AS (SELECT DISTINCT vec_id // 25 AS index, 'IMG_' || lpad((vec_id // 25)::VARCHAR, 12, '0') || '.jpg' AS file_name FROM e),
 img AS (SELECT index, file_name, '/images/' || file_name AS path, (301 + index * 7 % 50)::INT AS orig_height, (400 + index * 13 % 90)::INT AS orig_width FROM im)
"""


# Vectors --------------------------------------------------------------------------------------


def _exploded(rows: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    return rows.select(key, F.posexplode(vec).alias("i", "x")).select(key, "i", r6("x").alias("x"))


@query("SELECT vec_id AS id, (i - 1)::INT AS i, round(n[i], 6) + 0.0 AS x FROM u, d64")
def vec_normalize(spark, sf):
    return _exploded(prepare.of_unit_length(_points(spark, sf)))


@query("""SELECT id, (i - 1)::INT AS i, round(CASE WHEN i <= 48 THEN v[i] ELSE 0 END, 6) + 0.0 AS x FROM txt, d64""")
def vec_pad(spark, sf):
    cut = _side(spark, sf, 1).withColumn("vec", F.slice("vec", 1, 48))
    return _exploded(prepare.padded_pair(_side(spark, sf, 0), cut)[1])


@query("SELECT vis.id, round(list_inner_product(vis.v, txt.v), 6) + 0.0 AS dot FROM vis JOIN txt USING (id)")
def vec_dot(spark, sf):
    both = _side(spark, sf, 0).join(_side(spark, sf, 1).withColumnRenamed("vec", "y"), "id")
    return both.select("id", r6(V.dot(F.col("vec"), F.col("y"))).alias("dot"))


@query("SELECT vec_id AS id, (i - 1)::INT AS i, round(n[i], 6) + 0.0 AS x FROM u, d64")
def preprocess_l2(spark, sf):
    return _exploded(prepare.preprocessed(_points(spark, sf), "l2"))


@query(""", m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS a FROM e, d64 GROUP BY i)),
 c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: v[i] - m[i]) AS w FROM e, m)
 SELECT vec_id AS id, (i - 1)::INT AS i, round(w[i] / greatest(sqrt(list_inner_product(w, w)), 1e-12), 6) + 0.0 AS x FROM c, d64""")
def preprocess_center_l2(spark, sf):
    return _exploded(prepare.preprocessed(_points(spark, sf), "center_l2"))


@query("SELECT (i - 1)::INT AS i, round(avg(v[i]), 6) + 0.0 AS x FROM e, d64 GROUP BY i")
def mean_vector(spark, sf):
    return prepare.mean_vector(_points(spark, sf)).select(F.posexplode("mean").alias("i", "x")).select("i", r6("x").alias("x"))


@query("""SELECT a.id AS i, b.id AS j, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) + 0.0 AS s
 FROM vis a, txt b""")
def cos_sim_matrix(spark, sf):
    pairs = metrics.cos_sim_matrix(_side(spark, sf, 0), _side(spark, sf, 1))
    return pairs.select("i", "j", r6("s").alias("s"))


@query("""SELECT a.id AS i, b.id AS j, round(greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 0), 6) + 0.0 AS d
 FROM vis a, txt b""")
def pairwise_sq_dists(spark, sf):
    return metrics.squared_distances(_side(spark, sf, 0), _side(spark, sf, 1)).select("i", "j", r6("d").alias("d"))


@query("""SELECT a.id AS i, b.id AS j, round(greatest(1 - list_inner_product(a.v, b.v), 0), 6) + 0.0 AS d FROM vis a, txt b""")
def cosine_distances(spark, sf):
    return metrics.cosine_distances(_side(spark, sf, 0), _side(spark, sf, 1)).select("i", "j", r6("d").alias("d"))


@query("""SELECT id, (j - 1)::INT AS i, round(sum(v[k.i] * (((k.i * 7 + j * 3) % 11) - 5) / 10.0), 6) + 0.0 AS x
 FROM vis, d64 k, (SELECT unnest(range(1, 9)) AS j) GROUP BY id, j""")
def apply_map(spark, sf):
    w = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(1, 9)] for i in range(1, 65)])
    return _exploded(blocks.apply_map(_side(spark, sf, 0), w))


@query(""", mv AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS a FROM lc, d64 GROUP BY i)),
 c AS (SELECT c, list_transform(range(1, 65), lambda i: v[i] - m[i]) AS w FROM lc, mv)
 SELECT a.c AS i, b.c AS j, round(list_inner_product(a.w, b.w), 6) + 0.0 AS g FROM c a, c b""")
def centered_gram(spark, sf):
    ids, x = blocks.small_matrix(_large(spark, sf), "centroid_id", "vec")
    g = alignment.centred_gram(x)
    rows = [(int(i), int(j), float(g[p, q])) for p, i in enumerate(ids) for q, j in enumerate(ids)]
    return spark.createDataFrame(rows, "i int, j int, g double").select("i", "j", r6("g").alias("g"))


@query("SELECT (a.i - 1)::BIGINT AS i, (b.i - 1)::BIGINT AS j, round(sum(vis.v[a.i] * txt.v[b.i]), 6) + 0.0 AS g FROM vis JOIN txt USING (id), d64 a, d64 b GROUP BY a.i, b.i")
def cross_gram(spark, sf):
    g = blocks.cross_gram(_side(spark, sf, 0), _side(spark, sf, 1))
    rows = [(i, j, float(g[i, j])) for i in range(g.shape[0]) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, "i long, j long, g double").select("i", "j", r6("g").alias("g"))


@query("""SELECT image_index, (i - 1)::INT AS i, round(avg(v[i]), 6) + 0.0 AS x FROM (SELECT vec_id // 25 AS image_index, v FROM e), d64 GROUP BY image_index, i""")
def image_mean_pool(spark, sf):
    return _exploded(cluster.group_means(_patches(spark, sf), "image_index"), "image_index")


@query("SELECT vec_id // 25 // 8 AS chunk, count(DISTINCT vec_id // 25) AS images, count(*) AS vectors FROM e GROUP BY ALL")
def scan_chunks(spark, sf):
    return _patches(spark, sf).groupBy(F.floor(F.col("image_index") / 8).alias("chunk")).agg(F.countDistinct("image_index").alias("images"), F.count("*").alias("vectors"))


@query("""SELECT 'vision' AS modality, count(*) AS n, max(len(v))::INT AS dim FROM vis UNION ALL SELECT 'text', count(*), max(len(v))::INT FROM txt""")
def pair_source(spark, sf):
    sides = [_side(spark, sf, k).withColumn("modality", F.lit(m)) for k, m in enumerate(("vision", "text"))]
    return sides[0].unionByName(sides[1]).groupBy("modality").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))


# Assignment and clusters ----------------------------------------------------------------------


@query("SELECT vec_id, cluster_id, round(distance, 6) + 0.0 AS distance FROM ac")
def assign_cosine(spark, sf):
    return _assigned(spark, sf).select("vec_id", "cluster_id", r6("distance").alias("distance"))


@query("SELECT vec_id, cluster_id, round(distance, 6) + 0.0 AS distance FROM al")
def assign_l2(spark, sf):
    return _assigned(spark, sf, "l2").select("vec_id", "cluster_id", r6("distance").alias("distance"))


@query("SELECT cluster_id, (d64.i - 1)::INT AS i, round(avg(v[d64.i]), 6) + 0.0 AS x FROM ac JOIN e USING (vec_id), d64 GROUP BY cluster_id, d64.i")
def centroid_update(spark, sf):
    return _exploded(cluster.group_means(blocks.assign(_patches(spark, sf), _small(spark, sf)), "cluster_id"), "cluster_id")


@query("SELECT c.c::INT AS cluster_id, count(vec_id) AS cnt FROM (SELECT unnest(range(12)) AS c) c LEFT JOIN ac ON ac.cluster_id = c.c GROUP BY c.c")
def cluster_counts(spark, sf):
    return cluster.cluster_counts(_assigned(spark, sf), 12)


@query("""SELECT count(*) FILTER (n = 0) AS num_empty_clusters, min(n) AS min_cluster_count, max(n) AS max_cluster_count, round(avg(n), 6) AS mean_cluster_count, round(max(l), 6) AS avg_loss
 FROM (SELECT c.c, count(vec_id) AS n FROM (SELECT unnest(range(12)) AS c) c LEFT JOIN ac ON ac.cluster_id = c.c GROUP BY c.c), (SELECT avg(distance) AS l FROM ac)""")
def kmeans_log(spark, sf):
    rows = _assigned(spark, sf)
    loss = rows.agg(F.round(F.avg("distance"), 6).alias("avg_loss"))
    return cluster.cluster_counts(rows, 12).agg(
        F.count_if(F.col("cnt") == 0).alias("num_empty_clusters"), F.min("cnt").alias("min_cluster_count"), F.max("cnt").alias("max_cluster_count"),
        F.round(F.avg("cnt"), 6).alias("mean_cluster_count"),
    ).crossJoin(F.broadcast(loss))


@query("SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS centroid_id, vec_id AS id FROM (SELECT vec_id FROM e ORDER BY md5(concat_ws(':', vec_id::VARCHAR, '7')), vec_id LIMIT 10)")
def kmeans_init(spark, sf):
    return sampling.random_centroids(_points(spark, sf).withColumn("vec", F.col("id")), 10, 7).select("centroid_id", F.col("vec").alias("id"))


def _first_centroids(spark, sf) -> DataFrame:
    return _e(spark, sf).filter("vec_id < 8").select(F.col("vec_id").cast("int").alias("centroid_id"), "vec")


def _lloyd_sql(metric: str, iters: int) -> str:
    source, column = ("u", "n") if metric == "cosine" else ("e", "v")
    distance = "1 - list_inner_product(p.x, c.x)" if metric == "cosine" else "list_inner_product(p.x, p.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(p.x, c.x)"
    unit = "list_transform(x, lambda a: a / greatest(sqrt(list_inner_product(x, x)), 1e-12))" if metric == "cosine" else "x"
    parts = [f", pts AS (SELECT vec_id, {column} AS x FROM {source}), c0 AS (SELECT vec_id::INT AS c, x FROM pts WHERE vec_id < 8)"]
    for t in range(iters):
        parts.append(
            f"a{t} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c FROM (SELECT vec_id, c, {distance} AS d FROM pts p, c{t} c) GROUP BY vec_id),"
            f" m{t} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, avg(x[i]) AS m FROM a{t} JOIN pts USING (vec_id), d64 GROUP BY c, i) GROUP BY c),"
            f" c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce({unit.replace('x', 'n.x') if metric == 'l2' else 'n.x'}, o.x) AS x FROM c{t} o LEFT JOIN (SELECT c, {unit} AS x FROM m{t}) n USING (c))"
        )
    return ", ".join(parts) + f" SELECT c AS centroid_id, (i - 1)::INT AS i, round(x[i], 6) + 0.0 AS x FROM c{iters}, d64"


def _kmeans(spark, sf, metric: str) -> DataFrame:
    fitted = cluster.KMeansVec(8, 3, metric).fit(_points(spark, sf), _first_centroids(spark, sf))
    return _exploded(fitted.frame(spark), "centroid_id")


@query(_lloyd_sql("cosine", 3))
def kmeans_cosine_3it(spark, sf):
    return _kmeans(spark, sf, "cosine")


@query(_lloyd_sql("l2", 3))
def kmeans_l2_3it(spark, sf):
    return _kmeans(spark, sf, "l2")


@query()
def caption_kmeans(spark, sf):
    fitted, _ = cluster.cluster_embeddings(_points(spark, sf), 6, "center_l2", n_init=2, max_iter=5)
    return cluster.cluster_counts(fitted.assign(prepare.preprocessed(_points(spark, sf), "center_l2")), 6)


# Retrieval ------------------------------------------------------------------------------------

_PLACED = "(patch_index // 5)::INT AS patch_row, (patch_index % 5)::INT AS patch_col"


@query(f"""SELECT cluster_id, rank::INT AS rank, round(1 - distance, 6) + 0.0 AS score, round(distance, 6) + 0.0 AS distance, image_index, patch_index, {_PLACED}, file_name, path AS image_path
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY 1 - distance DESC, image_index, patch_index) AS rank FROM ac) JOIN img ON image_index = index WHERE rank <= 10""")
def topk_per_cluster(spark, sf):
    top = retrieval.topk_per_cluster(_assigned(spark, sf), _images(spark, sf), 10, GRID)
    return top.withColumn("score", r6("score")).withColumn("distance", r6("distance"))


@query(f""", ch AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY 1 - distance DESC, image_index, patch_index) AS t,
  row_number() OVER (PARTITION BY cluster_id ORDER BY 1 - distance, image_index // 8, image_index DESC, patch_index DESC) AS b FROM ac WHERE cluster_id IN (1, 3, 4)),
 tb AS (SELECT *, 'most_similar' AS grp, t AS rank FROM ch WHERE t <= 5 UNION ALL SELECT *, 'least_similar', b FROM ch WHERE b <= 5)
 SELECT grp AS "group", cluster_id, rank::INT AS rank, round(1 - distance, 6) + 0.0 AS score, round(distance, 6) + 0.0 AS distance, image_index, patch_index, {_PLACED}, file_name, path AS image_path
 FROM tb JOIN img ON image_index = index""")
def top_bottom_per_cluster(spark, sf):
    rows = retrieval.top_bottom_per_cluster(_assigned(spark, sf), _images(spark, sf), 5, GRID, retrieval.parse_clusters("1,3-4", 10), chunk_images=8)
    return rows.withColumn("score", r6("score")).withColumn("distance", r6("distance"))


@query(f"SELECT patch_index, {_PLACED}, cluster_id, round(distance, 6) + 0.0 AS distance, round(1 - distance, 6) + 0.0 AS cosine_similarity FROM ac WHERE image_index = 3")
def image_patch_rows(spark, sf):
    rows = retrieval.image_patch_rows(_assigned(spark, sf), 3, GRID)
    return rows.withColumn("distance", r6("distance")).withColumn("cosine_similarity", r6("cosine_similarity"))


@query("""SELECT (patch_index // 5)::INT AS patch_row, max(cluster_id) FILTER (patch_index % 5 = 0) AS c0, max(cluster_id) FILTER (patch_index % 5 = 1) AS c1,
 max(cluster_id) FILTER (patch_index % 5 = 2) AS c2, max(cluster_id) FILTER (patch_index % 5 = 3) AS c3, max(cluster_id) FILTER (patch_index % 5 = 4) AS c4
 FROM ac WHERE image_index = 3 GROUP BY patch_index // 5""")
def patch_grid(spark, sf):
    return retrieval.patch_grid(_assigned(spark, sf), 3, GRID)


_SUMMARY = """count(*) AS patch_count, round(count(*) / sum(count(*)) OVER (PARTITION BY image_index), 6) AS patch_ratio, round(avg(distance), 6) + 0.0 AS mean_distance,
 round(min(distance), 6) + 0.0 AS min_distance, round(max(distance), 6) + 0.0 AS max_distance, round(1 - avg(distance), 6) + 0.0 AS mean_cosine_similarity"""


@query(f"SELECT image_index, cluster_id, {_SUMMARY} FROM ac GROUP BY image_index, cluster_id")
def image_cluster_summary(spark, sf):
    found = retrieval.image_cluster_summary(_assigned(spark, sf))
    return found.select("image_index", "cluster_id", "patch_count", *[r6(c).alias(c) for c in ("patch_ratio", "mean_distance", "min_distance", "max_distance", "mean_cosine_similarity")])


@query(""", lca AS (SELECT vec_id, (arg_min(c, (d, c)))::INT AS cluster_id FROM (SELECT vec_id, c, 1 - list_inner_product(u.n, lcn.n) AS d FROM u, lcn) GROUP BY vec_id),
 ks AS (SELECT 10 AS k, cluster_id FROM ac WHERE image_index = 3 UNION ALL SELECT 40, cluster_id FROM lca WHERE vec_id // 25 = 3)
 SELECT k, cluster_id, n AS patch_count, r::INT AS rank FROM (SELECT k, cluster_id, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, cluster_id) AS r FROM ks GROUP BY k, cluster_id) WHERE r <= 10""")
def multi_k_index(spark, sf):
    rows = None
    for k, c in ((10, _small(spark, sf)), (40, _large(spark, sf))):
        own = blocks.assign(_patches(spark, sf), c).withColumn("k", F.lit(k)).select("k", "image_index", "patch_index", "cluster_id", "distance")
        rows = own if rows is None else rows.unionByName(own)
    found = image_query.image_clusters(rows, _images(spark, sf), (GRID, GRID), image_index=3)
    return found.index.select("k", "cluster_id", "patch_count", "rank")


@query(""", s AS (SELECT vec_id // 25 AS image_index, (vec_id % 25)::INT AS patch_index, c AS centroid_id, list_inner_product(u.n, scn.n) AS raw FROM u, scn)
 SELECT image_index, patch_index, centroid_id, round((raw - min(raw) OVER w) / greatest(max(raw) OVER w - min(raw) OVER w, 1e-12), 6) + 0.0 AS value FROM s WINDOW w AS (PARTITION BY image_index, centroid_id)""")
def similarity_map(spark, sf):
    found = retrieval.similarity_map(_patches(spark, sf), _small(spark, sf))
    return found.withColumn("value", r6("value"))


@query("SELECT index, file_name, orig_height, orig_width FROM img WHERE file_name = 'IMG_000000000007.jpg'")
def find_image(spark, sf):
    return retrieval.find_image(_images(spark, sf), name="x/IMG_000000000007.jpg").select("index", "file_name", "orig_height", "orig_width")


@query("SELECT index, file_name FROM img WHERE index < 5")
def first_n_images(spark, sf):
    return sampling.first_n(_images(spark, sf), 5, "index").select("index", "file_name")


@query("SELECT unnest([0, 2, 3, 4, 9]) AS cluster_id")
def parse_clusters(spark, sf):
    return spark.createDataFrame([(c,) for c in retrieval.parse_clusters("3, 2-4,0,9,3", 10)], "cluster_id int")


@query("""SELECT index, r::INT AS patch_row, c::INT AS patch_col, round_even(c * orig_width / 5, 0)::INT AS x0, round_even(r * orig_height / 5, 0)::INT AS y0,
 greatest(round_even(c * orig_width / 5, 0)::INT + 1, round_even((c + 1) * orig_width / 5, 0)::INT) AS x1,
 greatest(round_even(r * orig_height / 5, 0)::INT + 1, round_even((r + 1) * orig_height / 5, 0)::INT) AS y1 FROM img, range(5) t(r), range(5) s(c)""")
def patch_box(spark, sf):
    grid = _images(spark, sf).withColumn("patch_row", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("patch_col", F.explode(F.sequence(F.lit(0), F.lit(4))))
    box = I.patch_box(F.col("orig_width"), F.col("orig_height"), F.col("patch_row"), F.col("patch_col"), GRID, GRID)
    return grid.withColumn("box", box).select("index", "patch_row", "patch_col", "box.*")


@query("""SELECT k, round(greatest(0, least(1, 1.5 - abs(4 * k / 40.0 - 3))), 6) + 0.0 AS red, round(greatest(0, least(1, 1.5 - abs(4 * k / 40.0 - 2))), 6) + 0.0 AS green,
 round(greatest(0, least(1, 1.5 - abs(4 * k / 40.0 - 1))), 6) + 0.0 AS blue FROM range(41) t(k)""")
def colormap(spark, sf):
    rows = spark.range(41).withColumnRenamed("id", "k").withColumn("c", I.heat(F.col("k") / 40))
    return rows.select("k", *[r6(F.col("c")[n]).alias(n) for n in ("red", "green", "blue")])


# Manifests and captions -----------------------------------------------------------------------

_NAMES = """, nm AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'IMG_' || lpad(page_id::VARCHAR, 12, '0') || '.jpg' ELSE regexp_replace(url, '[?#].*$', '') END AS name FROM pages),
 bn AS (SELECT page_id, name, regexp_extract(name, '([^/]*)$', 1) AS base FROM nm),
 st AS (SELECT page_id, name, base, CASE WHEN position('.' IN base[2:]) > 0 THEN regexp_extract(base, '^(.+)\\.[^.]*$', 1) ELSE base END AS stem FROM bn)
"""


def _names(spark, sf) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = F.concat(F.lit("IMG_"), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".jpg"))
    return pages.select("page_id", F.when(F.col("page_id") % 3 == 0, made).otherwise(F.regexp_replace("url", "[?#].*$", "")).alias("name"))


@query(_NAMES + "SELECT page_id, coalesce(nullif(regexp_extract(base, '_(\\d{12})\\.', 1), ''), nullif(regexp_extract(stem, '(\\d+)', 1), ''))::BIGINT AS number FROM st")
def parse_id_first(spark, sf):
    return _names(spark, sf).select("page_id", I.first_number(F.col("name")).alias("number"))


@query(_NAMES + "SELECT page_id, coalesce(nullif(regexp_extract(base, '_(\\d{12})(?:\\.|$)', 1), ''), regexp_extract_all(stem, '\\d+')[-1])::BIGINT AS number FROM st")
def parse_id_last(spark, sf):
    return _names(spark, sf).select("page_id", I.last_number(F.col("name")).alias("number"))


def _annotated(spark, sf) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id")
    return docs.select(
        F.when(k % 4 != 1, k + 1000).alias("id"), F.concat(F.lit("img"), (997 * k % 1009).cast("string"), F.lit(".jpg")).alias("file_name"),
        F.when(k % 5 != 0, (100 + k % 7).cast("int")).alias("height"), F.when(k % 5 != 0, (200 + k % 9).cast("int")).alias("width"),
    )


_MANIFEST = """, dn AS (SELECT CASE WHEN doc_id % 4 <> 1 THEN doc_id + 1000 END AS id, 'img' || (997 * doc_id % 1009) || '.jpg' AS file_name, 997 * doc_id % 1009 AS num,
  CASE WHEN doc_id % 5 <> 0 THEN 100 + doc_id % 7 END AS height, CASE WHEN doc_id % 5 <> 0 THEN 200 + doc_id % 9 END AS width FROM documents),
 mf AS (SELECT row_number() OVER (ORDER BY file_name, id) - 1 AS index, * FROM dn)
"""


@query(_MANIFEST + """SELECT index, coalesce(id, nullif(num, 0), index)::BIGINT AS image_id, file_name, '/data/train/' || file_name AS path, 'train' AS split,
 coalesce(height, -1)::INT AS orig_height, coalesce(width, -1)::INT AS orig_width FROM mf""")
def manifest(spark, sf):
    return records.manifest(_annotated(spark, sf), "train", "/data/train/")


@query(_MANIFEST + "SELECT index, file_name, 14 AS patch_size, 256 AS num_patches, CASE WHEN index % 10 <> 3 THEN 'ok' ELSE 'failed_image_load_zero_filled' END AS status, CASE WHEN index % 10 = 3 THEN 'unreadable' END AS error FROM mf")
def manifest_enriched(spark, sf):
    rows = records.manifest(_annotated(spark, sf), "train", "/data/train").withColumn("ok", F.col("index") % 10 != 3).withColumn("error", F.lit("unreadable"))
    return records.enriched(rows, resize=224, patch_size=14, feature_dim=768).select("index", "file_name", "patch_size", "num_patches", "status", "error")


@query("SELECT doc_id AS index, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS local_shard_index FROM documents WHERE doc_id % 7 = 2")
def shard_mod(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("index"))
    return records.shard(rows, 2, 7).select("index", "local_shard_index")


@query(""", n AS (SELECT count(*) AS n FROM documents)
 SELECT doc_id AS index, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS local_shard_index FROM documents, n WHERE doc_id >= n * 2 // 7 AND doc_id < n * 3 // 7""")
def shard_contiguous(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("index"))
    return records.shard(rows, 2, 7, "contiguous").select("index", "local_shard_index")


@query(""", t AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
 SELECT 'PIC_' || lpad(conv_id::VARCHAR, 12, '0') || '.jpg' AS file_name, conv_id AS image_id, len(texts)::INT AS n_captions, md5(array_to_string(texts, chr(10))) AS digest FROM t""")
def captions_by_image(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    name = F.concat(F.lit("PIC_"), F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit(".jpg")).alias("file_name")
    names = talk.select("conv_id", name).distinct()
    # Half of the names are known images; the rest are read from the name.
    listed = names.filter(F.col("conv_id") % 2 == 0).select(F.col("conv_id").alias("id"), "file_name", F.lit(0).alias("pos"))
    notes = talk.select(F.col("turn").alias("pos"), F.col("conv_id").alias("image_id"), F.col("text").alias("caption"))
    found = records.captions(names.select("file_name"), listed, notes)
    return found.select("file_name", "image_id", F.size("captions").alias("n_captions"), F.md5(F.array_join("captions", "\n")).alias("digest"))


# Samples --------------------------------------------------------------------------------------


@query("SELECT vec_id AS id FROM e ORDER BY md5(concat_ws(':', vec_id::VARCHAR, '42')), vec_id LIMIT 50")
def sample_points(spark, sf):
    return sampling.sample_points(_points(spark, sf).select("id"), 50, 42)


@query("""SELECT 'vision' AS side, * FROM (SELECT id FROM vis ORDER BY md5(concat_ws(':', id::VARCHAR, '42')), id LIMIT 30)
 UNION ALL SELECT 'text', * FROM (SELECT id FROM txt ORDER BY md5(concat_ws(':', id::VARCHAR, '42')), id LIMIT 30)""")
def sample_pair(spark, sf):
    v, t, _ = sampling.sample_pair(_side(spark, sf, 0), _side(spark, sf, 1), 30, 42)
    return v.select(F.lit("vision").alias("side"), "id").unionByName(t.select(F.lit("text").alias("side"), "id"))


@query("""SELECT 'vision' AS side, * FROM (SELECT id FROM vis ORDER BY md5(concat_ws(':', id::VARCHAR, '5')), id LIMIT 30)
 UNION ALL SELECT 'text', * FROM (SELECT doc_id AS id FROM documents ORDER BY md5(concat_ws(':', doc_id::VARCHAR, '6')), doc_id LIMIT 30)""")
def sample_same_count(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"))
    v, t = sampling.sample_same_count(_side(spark, sf, 0), texts, 30, 5)
    return v.select(F.lit("vision").alias("side"), "id").unionByName(t.select(F.lit("text").alias("side"), "id"))


@query(""", h AS (SELECT count(*) - 50 AS size FROM vis)
 SELECT 'a' AS part, count(*) AS rows, min(id) AS low, max(id) AS high FROM vis, h WHERE id < size // 2 UNION ALL SELECT 'b', count(*), min(id), max(id) FROM txt, h WHERE id >= size // 2 AND id < size
 UNION ALL SELECT 'c', count(*), min(id), max(id) FROM vis, h WHERE id >= size UNION ALL SELECT 'd', count(*), min(id), max(id) FROM txt, h WHERE id >= size""")
def unpaired_split(spark, sf):
    parts = sampling.unpaired_split(_side(spark, sf, 0), _side(spark, sf, 1), 50)
    rows = None
    for name, p in zip("abcd", parts, strict=True):
        one = p.agg(F.count("*").alias("rows"), F.min("id").alias("low"), F.max("id").alias("high")).select(F.lit(name).alias("part"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


# Pairs and neighbours -------------------------------------------------------------------------


@query("SELECT round(avg(list_inner_product(a.n, b.n)), 6) + 0.0 AS all_pair_cosine_mean FROM vis a, txt b")
def all_pair_cosine_mean(spark, sf):
    v, t = (prepare.of_unit_length(_side(spark, sf, k)) for k in (0, 1))
    return metrics.all_pair_cosine_mean(v, t).select(r6("all_pair_cosine_mean").alias("all_pair_cosine_mean"))


@query("SELECT round(avg(list_inner_product(a.n, b.n)), 6) + 0.0 AS same_index_cosine_mean FROM vis a JOIN txt b USING (id)")
def paired_cosine_mean(spark, sf):
    return metrics.paired_cosine_mean(_side(spark, sf, 0), _side(spark, sf, 1)).select(r6("same_index_cosine_mean").alias("same_index_cosine_mean"))


@query("""SELECT id, rank::INT AS rank, other_id, round(s, 6) + 0.0 AS score FROM (SELECT a.id, b.id AS other_id, list_inner_product(a.n, b.n) AS s,
 row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.n, b.n) DESC, b.id) AS rank FROM vis a, txt b) WHERE rank <= 10""")
def knn_join(spark, sf):
    return blocks.knn(_side(spark, sf, 0), _side(spark, sf, 1), 10).select("id", "rank", "other_id", r6("score").alias("score"))


@query(""", k AS (SELECT id, other_id FROM (SELECT a.id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.n, b.n) DESC, b.id) AS r FROM vis a, txt b) WHERE r <= 5)
 SELECT k.id, (i - 1)::INT AS i, round(avg(txt.v[i]), 6) + 0.0 AS x FROM k JOIN txt ON txt.id = other_id, d64 GROUP BY k.id, i""")
def knn_mean_match(spark, sf):
    near = blocks.knn(_side(spark, sf, 0), _side(spark, sf, 1), 5)
    return _exploded(alignment.mean_match(near, _side(spark, sf, 1)))


@query(""", pv AS (SELECT id, list(list_inner_product(vis.n, scn.n) ORDER BY c) AS p FROM vis, scn GROUP BY id), pt AS (SELECT id, list(list_inner_product(txt.n, scn.n) ORDER BY c) AS p FROM txt, scn GROUP BY id)
 SELECT id, rank::INT AS rank, other_id, round(s, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other_id) AS rank FROM
 (SELECT a.id, b.id AS other_id, list_inner_product(a.p, b.p) / (sqrt(list_inner_product(a.p, a.p)) * sqrt(list_inner_product(b.p, b.p))) AS s FROM pv a, pt b)) WHERE rank <= 3""")
def profile_match(spark, sf):
    anchor = blocks.small_matrix(_small(spark, sf), "centroid_id", "vec")[1]
    v, t = (alignment._profiles(_side(spark, sf, k), anchor) for k in (0, 1))
    return blocks.knn(v, t, 3).select("id", "rank", "other_id", r6("score").alias("score"))


@query("""SELECT id, round(d, 6) + 0.0 AS radius FROM (SELECT a.id, greatest(1 - list_inner_product(a.n, b.n), 0) AS d,
 row_number() OVER (PARTITION BY a.id ORDER BY greatest(1 - list_inner_product(a.n, b.n), 0), b.id) AS r FROM vis a, vis b WHERE a.id <> b.id) WHERE r = 5""")
def kth_radius(spark, sf):
    return metrics.kth_radius(prepare.of_unit_length(_side(spark, sf, 0)), 5).select("id", r6("radius").alias("radius"))


# Matching and metrics -------------------------------------------------------------------------

_CANDIDATES = """, p AS (SELECT a.c AS small_index, b.c AS large_index, list_inner_product(a.n, b.n) AS s FROM scn a, lcn b)
"""
_CANDIDATE_ROWS = """SELECT small_index, large_index, round(s, 6) + 0.0 AS cosine_similarity, (rank() OVER (PARTITION BY small_index ORDER BY s DESC))::INT AS rank_in_small_to_large,
 (arg_max(large_index, (s, -large_index)) OVER (PARTITION BY small_index))::INT AS best_large_index_for_small, round(max(s) OVER (PARTITION BY small_index), 6) + 0.0 AS best_cosine_for_small,
 round(max(s) OVER (PARTITION BY small_index) - s, 6) + 0.0 AS gap_to_best FROM p"""
_MATCH_ROUNDED = ("cosine_similarity", "best_cosine_for_small", "gap_to_best")


def _rounded(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.select([r6(c).alias(c) if c in names else F.col(c) for c in rows.columns])


@query(_CANDIDATES + _CANDIDATE_ROWS)
def centroid_match_candidates(spark, sf):
    return _rounded(matching.match_candidates(_small(spark, sf), _large(spark, sf)), _MATCH_ROUNDED)


@query(""", k AS (SELECT a.c AS i, b.c AS j, -list_inner_product(a.n, b.n) AS cost FROM scn a, scn b WHERE a.c < 6 AND b.c >= 4),
 z AS (SELECT a.j AS a, b.j AS b, c.j AS c, d.j AS d, e2.j AS e2, f.j AS f, a.cost + b.cost + c.cost + d.cost + e2.cost + f.cost AS total FROM k a, k b, k c, k d, k e2, k f
  WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND d.i = 3 AND e2.i = 4 AND f.i = 5 AND b.j <> a.j AND c.j NOT IN (a.j, b.j) AND d.j NOT IN (a.j, b.j, c.j)
  AND e2.j NOT IN (a.j, b.j, c.j, d.j) AND f.j NOT IN (a.j, b.j, c.j, d.j, e2.j)),
 o AS (SELECT * FROM z ORDER BY total LIMIT 1)
 SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([a, b, c, d, e2, f]) AS j, round(total, 6) + 0.0 AS total FROM o""")
def hungarian_small(spark, sf):
    x = blocks.unit(blocks.small_matrix(_small(spark, sf), "centroid_id", "vec")[1])
    cost = -(x[:6] @ x[4:].T)
    chosen = solvers.hungarian(cost)
    total = float(cost[np.arange(6), chosen].sum())
    rows = [(i, int(j) + 4, total) for i, j in enumerate(chosen)]
    return spark.createDataFrame(rows, "i int, j int, total double").select("i", "j", r6("total").alias("total"))


_ASSIGNED = _CANDIDATES.replace(", p AS", ", RECURSIVE p AS") + """, st AS (SELECT -1 AS col, 0 AS mask, 0.0::DOUBLE AS total, []::INT[] AS chosen
  UNION ALL SELECT col, mask, min(total), arg_min(chosen, total) FROM (
   SELECT s.col + 1 AS col, s.mask, s.total, list_append(s.chosen, NULL::INT) AS chosen FROM st s WHERE s.col < 39
   UNION ALL SELECT s.col + 1, s.mask | (1 << p.small_index), s.total + p.s * -1, list_append(s.chosen, p.small_index::INT)
   FROM st s JOIN p ON p.large_index = s.col + 1 WHERE s.col < 39 AND (s.mask & (1 << p.small_index)) = 0) GROUP BY col, mask),
 best AS (SELECT chosen FROM st WHERE col = 39 AND mask = 1023),
 pairs AS (SELECT unnest(chosen) AS small_index, unnest(range(40)) AS large_index FROM best)
 """


@query(_ASSIGNED + "SELECT c.* FROM (" + _CANDIDATE_ROWS + ") c JOIN pairs USING (small_index, large_index)")
def hungarian_match(spark, sf):
    return _rounded(matching.match_centroids(_small(spark, sf), _large(spark, sf)), _MATCH_ROUNDED)


@query(_CANDIDATES + """, b AS (SELECT small_index, large_index, s FROM p QUALIFY row_number() OVER (PARTITION BY small_index ORDER BY s DESC, large_index) = 1)
 SELECT count(*) AS num_pairs, count(DISTINCT large_index) AS unique_large_indices, round(avg(s), 6) + 0.0 AS mean_cosine_similarity, round(min(s), 6) + 0.0 AS min_cosine_similarity FROM b""")
def centroid_match_summary(spark, sf):
    best = matching.match_candidates(_small(spark, sf), _large(spark, sf)).filter("large_index = best_large_index_for_small")
    return _rounded(matching.match_summary(best), ("mean_cosine_similarity", "min_cosine_similarity"))


@query(""", s AS (SELECT a.id AS i, b.id AS j, 'vv' AS b, greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 0) AS d FROM vis a, vis b
 UNION ALL SELECT a.id, b.id, 'tt', greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 0) FROM txt a, txt b
 UNION ALL SELECT a.id, b.id, 'vt', greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 0) FROM vis a, txt b),
 sg AS (SELECT greatest(sqrt(quantile_disc(d, 0.5) / 2), 1e-6) AS sigma FROM s WHERE d > 1e-9),
 k AS (SELECT b, avg(exp(-d / (2 * sigma * sigma))) AS m FROM s, sg GROUP BY b)
 SELECT round((SELECT m FROM k WHERE b = 'vv') + (SELECT m FROM k WHERE b = 'tt') - 2 * (SELECT m FROM k WHERE b = 'vt'), 6) + 0.0 AS mmd_rbf, round(sigma, 6) + 0.0 AS mmd_sigma FROM sg""")
def mmd_rbf(spark, sf):
    return _rounded(metrics.mmd_rbf(_side(spark, sf, 0), _side(spark, sf, 1)), ("mmd_rbf", "mmd_sigma"))


@query(""", vd AS (SELECT id, d FROM (SELECT a.id, greatest(1 - list_inner_product(a.n, b.n), 0) AS d, row_number() OVER (PARTITION BY a.id ORDER BY greatest(1 - list_inner_product(a.n, b.n), 0), b.id) AS r FROM vis a, vis b WHERE a.id <> b.id) WHERE r = 5),
 td AS (SELECT id, d FROM (SELECT a.id, greatest(1 - list_inner_product(a.n, b.n), 0) AS d, row_number() OVER (PARTITION BY a.id ORDER BY greatest(1 - list_inner_product(a.n, b.n), 0), b.id) AS r FROM txt a, txt b WHERE a.id <> b.id) WHERE r = 5),
 x AS (SELECT a.id AS i, b.id AS j, greatest(1 - list_inner_product(a.n, b.n), 0) AS d FROM vis a, txt b),
 ot AS (SELECT j, arg_min(i, (d, i)) AS id, min(d) AS d FROM x GROUP BY j), ov AS (SELECT i, arg_min(j, (d, j)) AS id, min(d) AS d FROM x GROUP BY i),
 pr AS (SELECT avg((ot.d <= vd.d)::INT) AS p, count(DISTINCT id) / (SELECT count(*) FROM vis) AS c FROM ot JOIN vd USING (id)),
 re AS (SELECT avg((ov.d <= td.d)::INT) AS p, count(DISTINCT id) / (SELECT count(*) FROM txt) AS c FROM ov JOIN td USING (id))
 SELECT round(pr.p, 6) AS precision_text_in_vision, round(re.p, 6) AS recall_vision_in_text, round(CASE WHEN pr.p + re.p > 0 THEN 2 * pr.p * re.p / (pr.p + re.p) ELSE 0 END, 6) AS precision_recall_f1,
 round(pr.c, 6) AS coverage_vision_by_text, round(re.c, 6) AS coverage_text_by_vision, 5 AS coverage_knn_k FROM pr, re""")
def precision_recall_coverage(spark, sf):
    v, t = (prepare.of_unit_length(_side(spark, sf, k)) for k in (0, 1))
    found = metrics.precision_recall_coverage(v, t, 5)
    return found.select(*[F.round(c, 6).alias(c) if c != "coverage_knn_k" else F.col(c) for c in found.columns])


@query(""", a AS (SELECT x.id AS i, y.id AS j, list_inner_product(x.n, y.n) AS s FROM vis x, vis y WHERE x.id < y.id),
 b AS (SELECT x.id AS i, y.id AS j, list_inner_product(x.n, y.n) AS s FROM txt x, txt y WHERE x.id < y.id),
 r AS (SELECT rank() OVER (ORDER BY a.s) + (count(*) OVER (PARTITION BY a.s) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b.s) + (count(*) OVER (PARTITION BY b.s) - 1) / 2.0 AS rb FROM a JOIN b USING (i, j))
 SELECT round(corr(ra, rb), 6) + 0.0 AS pairwise_spearman FROM r""")
def pairwise_spearman(spark, sf):
    v, t = (prepare.of_unit_length(_side(spark, sf, k)) for k in (0, 1))
    return metrics.pairwise_spearman(v, t).select(r6("pairwise_spearman").alias("pairwise_spearman"))


@query(""", s AS (SELECT a.id AS i, b.id AS j, list_inner_product(a.n, b.n) AS s FROM vis a, txt b), o AS (SELECT i, s AS own FROM s WHERE i = j),
 r AS (SELECT i, 1 + count(*) FILTER (s > own) AS r FROM s JOIN o USING (i) GROUP BY i) SELECT round(avg((r = 1)::INT), 6) AS top1, round(avg(r), 6) AS avg_rank FROM r""")
def retrieval_top1_rank(spark, sf):
    return _rounded(metrics.retrieval_top1_rank(_side(spark, sf, 0), _side(spark, sf, 1)), ("top1", "avg_rank"))


_SINK = """, k AS (SELECT a.c AS i, b.c AS j, -(1 - list_inner_product(a.n, b.n)) / 0.1 AS k FROM scn a, lcn b),
 u1 AS (SELECT i, -ln(10) - (ln(sum(exp(k - m))) + max(m)) AS u FROM (SELECT *, max(k) OVER (PARTITION BY i) AS m FROM k) GROUP BY i),
 v1 AS (SELECT j, -ln(40) - (ln(sum(exp(x - m))) + max(m)) AS v FROM (SELECT *, max(x) OVER (PARTITION BY j) AS m FROM (SELECT i, j, k + u AS x FROM k JOIN u1 USING (i))) GROUP BY j),
 u2 AS (SELECT i, -ln(10) - (ln(sum(exp(x - m))) + max(m)) AS u FROM (SELECT *, max(x) OVER (PARTITION BY i) AS m FROM (SELECT i, j, k + v AS x FROM k JOIN v1 USING (j))) GROUP BY i),
 v2 AS (SELECT j, -ln(40) - (ln(sum(exp(x - m))) + max(m)) AS v FROM (SELECT *, max(x) OVER (PARTITION BY j) AS m FROM (SELECT i, j, k + u AS x FROM k JOIN u2 USING (i))) GROUP BY j)
 SELECT i, j, round(exp(k + u + v), 6) + 0.0 AS p FROM k JOIN u2 USING (i) JOIN v2 USING (j)"""


def _plan(spark, sf, iters: int) -> DataFrame:
    a = blocks.unit(blocks.small_matrix(_small(spark, sf), "centroid_id", "vec")[1])
    b = blocks.unit(blocks.small_matrix(_large(spark, sf), "centroid_id", "vec")[1])
    p = solvers.sinkhorn(1 - a @ b.T, 0.1, iters)
    rows = [(i, j, float(p[i, j])) for i in range(p.shape[0]) for j in range(p.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, p double").select("i", "j", r6("p").alias("p"))


@query(_SINK)
def sinkhorn_2it(spark, sf):
    return _plan(spark, sf, 2)


@query(""", RECURSIVE m AS (SELECT list(r ORDER BY i) AS rows FROM (SELECT a.c AS i, list(-(1 - list_inner_product(a.n, b.n)) / 0.1 ORDER BY b.c) AS r FROM scn a, lcn b GROUP BY a.c)),
 mt AS (SELECT list(r ORDER BY j) AS cols FROM (SELECT b.c AS j, list(-(1 - list_inner_product(a.n, b.n)) / 0.1 ORDER BY a.c) AS r FROM scn a, lcn b GROUP BY b.c)),
 it AS (SELECT 0 AS t, list_transform(range(10), lambda x: 0.0::DOUBLE) AS u, list_transform(range(40), lambda x: 0.0::DOUBLE) AS v
  UNION ALL SELECT t, u, list_transform(cols, lambda r: -ln(40.0::DOUBLE) - ln(list_sum(list_transform(list_zip(r, u), lambda z: exp(z[1] + z[2]))))) FROM (
   SELECT t + 1 AS t, list_transform(rows, lambda r: -ln(10.0::DOUBLE) - ln(list_sum(list_transform(list_zip(r, v), lambda z: exp(z[1] + z[2]))))) AS u FROM it, m WHERE t < 50), mt)
 SELECT i::INT AS i, j::INT AS j, round(exp(rows[i + 1][j + 1] + u[i + 1] + v[j + 1]), 6) + 0.0 AS p FROM it, m, range(10) a(i), range(40) b(j) WHERE t = 50""")
def sinkhorn(spark, sf):
    return _plan(spark, sf, 50)


@query()
def gw_distance(spark, sf):
    v, t = (sampling.sample_points(prepare.of_unit_length(_side(spark, sf, k)), 300, 42 + k) for k in (0, 1))
    return spark.createDataFrame([(metrics.gw_distance(v, t),)], "gw_distance double").select(r6("gw_distance").alias("gw_distance"))


@query()
def cluster_wasserstein(spark, sf):
    value, k = metrics.cluster_wasserstein(_side(spark, sf, 0), _side(spark, sf, 1), 8, 42, 4)
    return spark.createDataFrame([(value, k)], "kmeans_wasserstein double, kmeans_k int").select(r6("kmeans_wasserstein").alias("kmeans_wasserstein"), "kmeans_k")


@query()
def distribution_metrics(spark, sf):
    found = metrics.distribution_metrics(_side(spark, sf, 0), _side(spark, sf, 1), k=8)
    rows = [(k, None if v is None else round(float(v), 6)) for k, v in sorted(found.items())]
    return spark.createDataFrame(rows, "metric string, value double")


# Alignment and projection ---------------------------------------------------------------------


@query()
def procrustes(spark, sf):
    w = solvers.procrustes(blocks.cross_gram(_side(spark, sf, 0), _side(spark, sf, 1)))
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(w)], "row int, vec array<double>")


@query()
def qap_align(spark, sf):
    a, b = alignment.anchors(_side(spark, sf, 0), _side(spark, sf, 1), 20, 30, 10_000, 0)
    value = float((alignment.centred_gram(a) * alignment.centred_gram(b)).sum())
    return spark.createDataFrame([(len(a), value)], "clusters int, objective double").select("clusters", r6("objective").alias("objective"))


@query()
def align_pipeline(spark, sf):
    parts = sampling.unpaired_split(_side(spark, sf, 0), _side(spark, sf, 1), 50)
    parts = [p.withColumn("id", F.col("id") - low) for p, low in zip(parts, [p.agg(F.min("id")).first()[0] for p in parts], strict=True)]
    out = alignment.fit_alignment(*parts, num_anchor_runs=2, qap_runs=30, num_clusters=20, refine_iters=2, refine2_clusters=6)
    rows = [("initial", out.initial_cosine)] + [(f"refine1_{k}", v) for k, v in enumerate(out.refine1_cosine)] + [("refine2", out.refine2_cosine), ("top1", out.top1), ("avg_rank", out.avg_rank)]
    return spark.createDataFrame(rows, "step string, value double").select("step", r6("value").alias("value"))


@query()
def pca_variance(spark, sf):
    _, shares = projection.project_2d(_side(spark, sf, 0), _side(spark, sf, 1))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(shares)], "component int, share double").select("component", r6("share").alias("share"))


@query()
def pca_2d(spark, sf):
    points, _ = projection.project_2d(_side(spark, sf, 0), _side(spark, sf, 1))
    return _rounded(points, ("x", "y"))


@query()
def tsne_2d(spark, sf):
    points, _ = projection.project_2d(_side(spark, sf, 0), _side(spark, sf, 1), "tsne")
    return points


# Extension: a stream ---------------------------------------------------------------------------


@query("SELECT cluster_id, count(*) AS cnt FROM ac GROUP BY cluster_id")
def stream_cluster_counts(spark, sf):
    arriving = (
        spark.readStream.schema("vec_id long, embedding array<float>, label int").parquet(f"{sf}/embeddings[.]parquet")  # a file, or a folder of files
        .select(F.col("embedding").cast("array<double>").alias("vec"))
    )
    name = f"counts_{uuid.uuid4().hex}"
    running = streams.running_counts(arriving, _small(spark, sf), name, f"{shared_folder(spark)}/{name}")
    running.processAllAvailable()
    running.stop()
    return spark.table(name)

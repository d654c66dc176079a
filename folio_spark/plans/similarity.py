"""Registered queries: exact and near duplicates, clusters and their quality, over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions import neighbours as nb
from folio_spark.operators import dedup
from folio_spark.registry import query, table

#: The vectors of the test tables lie far apart: this threshold leaves pairs and clusters to see.
T = 0.36
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
PAIRS = f"pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= {T})"
COMPONENTS = f"""{PAIRS},
edges AS (SELECT i AS s, j AS d FROM pairs UNION ALL SELECT j, i FROM pairs),
reach(s, d) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.s, e.d FROM reach r JOIN edges e ON r.d = e.s),
comp AS (SELECT s AS vec_id, min(d) AS cluster FROM reach GROUP BY s)"""
HASH = r"substr(sha256(lower(regexp_replace(text, '^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$', '', 'g'))), 1, 16)"


@query("exact_dedup", f"SELECT min(doc_id) AS doc_id, content_hash, count(*) AS group_size FROM (SELECT doc_id, {HASH} AS content_hash FROM documents) GROUP BY content_hash")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "content_hash", "group_size")


@query(
    "exact_dup_groups",
    f"SELECT content_hash, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS group_size FROM (SELECT doc_id, {HASH} AS content_hash FROM documents) GROUP BY 1 HAVING count(*) > 1",
)
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_groups(table(spark, d, "documents"))


@query("near_dup_pairs", f"WITH {PAIRS} SELECT i, j, round(sim, 6) AS sim FROM pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return nb.similarity_join(table(spark, d, "embeddings"), T).withColumn("sim", F.round("sim", 6))


@query("cluster_components", f"WITH RECURSIVE {COMPONENTS} SELECT vec_id, cluster FROM comp")
def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    return dedup.transitive(table(spark, d, "embeddings"), T)


@query("cluster_average_linkage")
def cluster_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    return dedup.average_linkage(table(spark, d, "embeddings"), T)


@query(
    "leader_dedup",
    f"""WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    c AS (SELECT a.i, coalesce(list(b.i ORDER BY b.i) FILTER (WHERE b.i IS NOT NULL), []) AS near FROM v a LEFT JOIN v b ON b.i < a.i AND list_cosine_similarity(a.x, b.x) >= {T} GROUP BY a.i),
    walk(i, heads, head) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT UNION ALL
      SELECT f.i, CASE WHEN f.head IS NULL THEN list_append(f.heads, f.i) ELSE f.heads END, coalesce(f.head, f.i)
      FROM (SELECT c.i, w.heads, list_min([j FOR j IN c.near IF list_contains(w.heads, j)]) AS head FROM walk w JOIN c ON c.i = w.i + 1) f)
    SELECT a.vec_id, b.vec_id AS leader, a.i = b.i AS is_leader FROM walk JOIN v a ON a.i = walk.i JOIN v b ON b.i = walk.head""",
)
def leader_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.leader(table(spark, d, "embeddings"), T)


@query(
    "cluster_centroid_merge",
    """WITH RECURSIVE m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    v AS (SELECT label::BIGINT AS cluster, list(m ORDER BY i) AS mean FROM m GROUP BY 1),
    e AS (SELECT a.cluster AS s, b.cluster AS d FROM v a JOIN v b ON a.cluster <> b.cluster WHERE list_cosine_similarity(a.mean, b.mean) >= 0.2),
    reach(s, d) AS (SELECT cluster, cluster FROM v UNION SELECT r.s, e.d FROM reach r JOIN e ON r.d = e.s)
    SELECT s AS cluster, min(d) AS merged FROM reach GROUP BY s""",
)
def cluster_centroid_merge(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merge_by_centroid(table(spark, d, "embeddings"), 0.2, cluster="label").withColumnRenamed("label", "cluster")


@query(
    "cluster_quality",
    f"""WITH p AS (SELECT a.label = b.label AS same, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
    q AS (SELECT avg(sim) FILTER (WHERE same) AS intra, avg(sim) FILTER (WHERE NOT same) AS inter FROM p),
    c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT round(intra, 6) AS intra_mean, round(inter, 6) AS inter_mean, round(intra - inter, 6) AS gap,
      (SELECT count(*) FROM c) AS n_clusters, (SELECT count(*) FROM c WHERE n = 1) AS singletons, (SELECT quantile_cont(n, 0.5) FROM c)::DOUBLE AS median_size FROM q""",
)
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    return dedup.quality(table(spark, d, "embeddings"), "label")


@query(
    "cluster_purity",
    f"""WITH RECURSIVE {COMPONENTS}, n AS (SELECT cluster, label, count(*) AS c FROM comp JOIN embeddings USING (vec_id) GROUP BY 1, 2), k AS (SELECT cluster, max(c) AS m, sum(c) AS n FROM n GROUP BY 1)
    SELECT round(sum(m) / sum(n), 6) AS purity, count(*) AS n_clusters, sum(n)::BIGINT AS n_rows FROM k""",
)
def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return dedup.purity(dedup.transitive(vectors, T).join(vectors.select("vec_id", "label"), "vec_id"), "cluster", "label")


@query(
    "knn_join",
    f"""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, neighbour) AS rank FROM s) SELECT id, neighbour, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5""",
)
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return nb.knn_join(table(spark, d, "embeddings"), 5).select("id", "neighbour", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("best_duplicate", f"""WITH h AS (SELECT doc_id, n_chars, {HASH} AS h, length(text) AS len FROM documents),
    v AS (SELECT *, 0.4 * len / max(len) OVER (PARTITION BY h) + 0.6 * (doc_id % 7) AS value FROM h)
    SELECT h AS content_hash, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY value DESC, doc_id) AS rn FROM v) WHERE rn = 1""")
def best_duplicate(spark: SparkSession, d: str) -> DataFrame:
    from folio_spark.functions import text as tx

    rows = table(spark, d, "documents").select("doc_id", "text", tx.content_hash(F.col("text")).alias("content_hash"), (F.col("doc_id") % 7).alias("score"))
    return dedup.best_duplicate(rows, "content_hash", "text", "score", "doc_id").select("content_hash", "doc_id")


@query("kmeans_tree")
def kmeans_tree(spark: SparkSession, d: str) -> DataFrame:
    return dedup.kmeans_tree(table(spark, d, "embeddings"))

"""Registered queries: tables of contents, page chunks, font sections, balanced chunks, topic clusters, zero-figure markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions import neighbours as nb
from folio_spark.operators import structure as st
from folio_spark.registry import query, table
from folio_spark.sources import sinks

ENTRIES_SQL = "e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 1000, o_orderkey) - 1 AS entry_no, o_orderkey % 3 + 1 AS level, o_orderpriority AS title, o_orderkey % 1000 AS page FROM orders)"


def _tocs(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct((F.col("o_orderkey") % 1000).alias("page"), "o_orderkey", (F.col("o_orderkey") % 3 + 1).alias("level"), F.concat(F.lit(" "), "o_orderpriority").alias("title"))
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("toc"))
    return st.toc_entries(docs.withColumn("toc", F.transform("toc", lambda e: F.struct(e["level"].alias("level"), e["title"].alias("title"), e["page"].alias("page")))), "o_custkey")


@query("toc_entries", f"WITH {ENTRIES_SQL} SELECT o_custkey, entry_no, level, title, page FROM e")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return _tocs(spark, d).withColumn("entry_no", F.col("entry_no").cast("long"))


@query("toc_ranges", f"WITH {ENTRIES_SQL} SELECT o_custkey, entry_no, page AS page_from, greatest(page, coalesce(lead(page) OVER (PARTITION BY o_custkey ORDER BY entry_no) - 1, 1000)) AS page_to FROM e")
def toc_ranges(spark: SparkSession, d: str) -> DataFrame:
    entries = _tocs(spark, d).withColumn("last_page", F.lit(1000).cast("long"))
    return st.toc_ranges(entries, "o_custkey", "entry_no", "page", "last_page").select("o_custkey", F.col("entry_no").cast("long").alias("entry_no"), "page_from", "page_to")


@query(
    "toc_chunks",
    f"""WITH {ENTRIES_SQL}, p AS (SELECT l_suppkey AS o_custkey, l_partkey % 1000 AS page, l_returnflag || l_linenumber AS t FROM lineitem),
    a AS (SELECT p.o_custkey, p.page, p.t, (SELECT max(entry_no) FROM e WHERE e.o_custkey = p.o_custkey AND e.page <= p.page) AS entry_no FROM p)
    SELECT o_custkey, entry_no, min(page) AS page_from, count(*) AS n_pages, md5(string_agg(t, chr(10) ORDER BY page, t)) AS content_md5 FROM a WHERE entry_no IS NOT NULL GROUP BY 1, 2""",
)
def toc_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("o_custkey"), (F.col("l_partkey") % 1000).alias("page"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"))
    out = st.toc_chunks(_tocs(spark, d), pages, "o_custkey", "entry_no", "page", "t")
    return out.select("o_custkey", F.col("entry_no").cast("long").alias("entry_no"), "page_from", "n_pages", F.md5("content").alias("content_md5"))


@query(
    "page_chunks",
    """SELECT l_orderkey, l_linenumber // 5 AS chunk_no, min(l_linenumber)::BIGINT AS page_from, max(l_linenumber)::BIGINT AS page_to, string_agg(l_returnflag || l_partkey, chr(10) ORDER BY l_linenumber, l_returnflag || l_partkey) AS content FROM lineitem GROUP BY 1, 2""",
)
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("page"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("t"))
    return st.page_chunks(li, "l_orderkey", "page", "t")


@query(
    "sections_by_font",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
    h AS (SELECT *, CASE WHEN length(line) < 3 OR length(line) > 100 THEN 0 WHEN 9 + n * 7 % 9 >= 16 THEN 1 WHEN 9 + n * 7 % 9 >= 14 THEN 2 WHEN n % 11 = 0 AND 9 + n * 7 % 9 >= 11 THEN 2
      WHEN regexp_matches(line, '^[0-9]+\.?[0-9]*\.?[0-9]*[ \t]+[A-Z][^.!?\n]{3,80}$') OR regexp_matches(line, '^[A-Z][A-Z \t]{4,60}$') OR regexp_matches(line, '^([A-Z][a-z]+ ?){2,8}$') THEN CASE WHEN regexp_matches(line, '^[0-9]+\.[0-9]+') THEN 2 ELSE 1 END ELSE 0 END AS lv FROM l),
    s AS (SELECT *, sum((lv > 0)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM h), k AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM s)
    SELECT doc_id, s::BIGINT AS section_no, coalesce(max(CASE WHEN lv > 0 THEN line END), 'Content') AS title, greatest(max(lv), 1) AS level, min(n // 20) AS page_start, max(n // 20) AS page_end, md5(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE lv = 0)) AS content_md5
    FROM k WHERE s > 0 OR top = 0 GROUP BY doc_id, s HAVING count(*) FILTER (WHERE lv = 0) > 0""",
)
def sections_by_font(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.select("doc_id", F.col("n").cast("long").alias("n"), "line", (9 + F.col("n") * 7 % 9).cast("double").alias("size"), F.when(F.col("n") % 11 == 0, 16).otherwise(0).alias("flags"), F.floor(F.col("n") / 20).cast("long").alias("page"))
    out = st.sections_by_font(lines, "doc_id", "n", "page", "line", "size", "flags")
    return out.select("doc_id", "section_no", "title", "level", "page_start", "page_end", F.md5("content").alias("content_md5"))


@query(
    "chunks_merge_small",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, trim(repeat('w ', l_quantity::INT)) || l_linenumber AS content, l_quantity::INT < 15 AS small, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
    r AS (SELECT *, sum((NOT small)::INT) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM c),
    p AS (SELECT *, CASE WHEN small THEN i - (row_number() OVER (PARTITION BY l_orderkey, run, small ORDER BY i) - 1) % 2 ELSE i END AS head FROM r)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY head) AS position, count(*) AS n_merged, md5(string_agg(content, chr(10) || chr(10) ORDER BY i)) AS content_md5 FROM p GROUP BY l_orderkey, head""",
)
def chunks_merge_small(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.trim(F.expr("repeat('w ', cast(l_quantity as int))")), F.col("l_linenumber").cast("string"))
    chunks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", text.alias("content"))
    out = st.merge_small(chunks, 50, 0.3, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return out.select("l_orderkey", F.col("position").cast("long").alias("position"), F.col("n_merged").cast("long").alias("n_merged"), F.md5("content").alias("content_md5"))


@query(
    "clusters_within_topic",
    """WITH RECURSIVE n AS (SELECT vec_id, coalesce(nullif('t' || label % 3, 't0'), 'general') AS topic, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.topic = b.topic AND list_cosine_similarity(a.v, b.v) >= 0.45),
    r(vec_id, c) AS (SELECT vec_id, vec_id FROM n UNION SELECT p.j, r.c FROM r JOIN p ON p.i = r.vec_id)
    SELECT r.vec_id, n.topic, min(c) AS cluster_id FROM r JOIN n USING (vec_id) GROUP BY 1, 2""",
)
def clusters_within_topic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    members = e.select("vec_id", F.when(F.col("label") % 3 != 0, F.concat(F.lit("t"), (F.col("label") % 3).cast("string"))).alias("topic"))
    vectors = e.join(members.select("vec_id", F.coalesce("topic", F.lit("general")).alias("topic")), "vec_id")
    return st.clusters_within(nb.similarity_join(vectors, 0.45, by="topic"), members, "vec_id", "topic")


@query(
    "zero_figure_markers",
    """SELECT p_partkey AS source_id, 'F' || l_orderkey || '-' || l_linenumber AS id, 'figure' AS format, l_returnflag AS caption FROM part JOIN (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey
    UNION ALL SELECT p_partkey, p_partkey || '_ZERO_FIGURES', 'marker', 'ZERO_FIGURES' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""",
)
def zero_figure_markers(spark: SparkSession, d: str) -> DataFrame:
    figures = table(spark, d, "lineitem").where("l_quantity > 45").select(
        F.col("l_partkey").alias("source_id"), F.concat_ws("-", F.concat(F.lit("F"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")).alias("id"), F.lit("figure").alias("format"), F.col("l_returnflag").alias("caption")
    )
    return sinks.with_zero_markers(figures.distinct(), table(spark, d, "part").select(F.col("p_partkey").alias("source_id")), "source_id")

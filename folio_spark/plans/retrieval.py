"""Registered queries: BM25, dense and hybrid retrieval, diversification, chapter ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.operators import inverted, ranking
from folio_spark.operators import retrieval as rt
from folio_spark.registry import query, table

BM25_QUERY = "atshsh bleble the the"

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

BM25_SQL = rf"""
tok AS (SELECT doc_id, source, coalesce({TOKENS}, []) AS t FROM documents),
qt AS (SELECT unnest(['atshsh', 'bleble', 'the']) AS term, unnest([1, 1, 2]) AS times),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc_id, source, len(t) AS dl, term, times, len(list_filter(t, lambda x: x = term)) AS f FROM tok, qt),
df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY term),
scored AS (SELECT doc_id, any_value(source) AS source,
    sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term), st GROUP BY doc_id HAVING score > 0)
"""

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _keyword(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    """Hits of the stored index of the documents; the first query over a table builds it."""
    path = inverted.index_of(table(spark, d, "documents"))
    return inverted.search(spark, path, BM25_QUERY, k).hits.withColumnRenamed("id", "doc_id")


@query("bm25_topk", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, 10).withColumn("score", F.round("score", 6))


def _probe(spark: SparkSession, d: str) -> list[float]:
    """The query vector: that of the smallest id, one row."""
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


PROBE_SQL = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("dense_topk", f"WITH {PROBE_SQL} SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, q WHERE {COS} >= 0.1 ORDER BY {COS} DESC, e.vec_id LIMIT 50")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return rt.dense(table(spark, d, "embeddings"), _probe(spark, d), 50, 0.1).withColumn("score", F.round("score", 6))


@query("dense_topk_filtered", f"WITH {PROBE_SQL} SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, q WHERE label IN (1, 3, 5) ORDER BY {COS} DESC, e.vec_id LIMIT 20")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rt.dense(table(spark, d, "embeddings"), _probe(spark, d), 20, where=F.col("label").isin(1, 3, 5)).withColumn("score", F.round("score", 6))


HYBRID_SQL = f"""
{BM25_SQL}, {PROBE_SQL},
dense AS (SELECT e.vec_id AS id, {COS} AS s FROM embeddings e, q WHERE {COS} >= 0.1 ORDER BY s DESC, id LIMIT 100),
sparse AS (SELECT doc_id AS id, score AS s FROM scored ORDER BY s DESC, id LIMIT 50),
dr AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS r FROM dense),
sr AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS r FROM sparse),
merged AS (SELECT coalesce(dr.id, sr.id) AS id, coalesce(dr.s, 0) AS dense_score, coalesce(sr.s, 0) AS sparse_score,
    CASE WHEN dr.id IS NULL THEN 'sparse' WHEN sr.id IS NULL THEN 'dense' ELSE 'both' END AS origin,
    least(coalesce(dr.r, 1073741824), coalesce(sr.r, 1073741824)) AS best
  FROM dr FULL OUTER JOIN sr ON dr.id = sr.id ORDER BY best, dense_score DESC, sparse_score DESC, id LIMIT 50)
"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    dense = rt.dense(table(spark, d, "embeddings"), _probe(spark, d), 100, 0.1).withColumnRenamed("vec_id", "id")
    sparse = _keyword(spark, d, 50).withColumnRenamed("doc_id", "id")
    return rt.hybrid_merge(dense, sparse)


@query(
    "hybrid_merge",
    f"""WITH {HYBRID_SQL} SELECT m.id, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, origin, coalesce(d.source, 'unknown') AS source, l.quality
    FROM merged m LEFT JOIN documents d ON d.doc_id = m.id LEFT JOIN labels l ON l.doc_id = m.id""",
)
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    pool = F.broadcast(_hybrid(spark, d))  # 50 rows at most
    out = meta.join(pool, "id", "right").join(labels, "id", "left")
    return out.select("id", F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"), "origin", F.coalesce("source", F.lit("unknown")).alias("source"), "quality")


@query(
    "hybrid_confidence",
    f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 50)),
    a AS (SELECT least(coalesce(avg(score) FILTER (WHERE rn <= 3), 0) / 30, 1) AS s, count(DISTINCT source) FILTER (WHERE rn <= 10) AS k, count(*) AS n FROM r),
    c AS (SELECT greatest(0, least(1, 0.4 * s + 0.3 * least(k / 3.0, 1) + 0.15 * least(n / 10.0, 1) + 0.15 * 0.8)) AS c, n, k FROM a)
    SELECT round(c, 6) AS confidence, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.70 THEN 'medium' WHEN c >= 0.50 THEN 'low' ELSE 'very_low' END AS level, n AS n_results, k AS n_sources FROM c""",
)
def hybrid_confidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = _keyword(spark, d, 50).join(docs.select("doc_id", "source"), "doc_id")
    return rt.confidence(hits, tiebreak="doc_id")


@query(
    "diversify_sources",
    f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM scored)
    SELECT doc_id, source, round(score, 6) AS score FROM r WHERE rn <= 10 ORDER BY r.score DESC, doc_id LIMIT 50""",
)
def diversify_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = _keyword(spark, d, None).join(docs.select("doc_id", "source"), "doc_id")
    return rt.diversify(hits, "source", "score", "doc_id").select("doc_id", "source", F.round("score", 6).alias("score"))


@query(
    "smart_select_balanced",
    """WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents)
    SELECT doc_id, source, n_chars FROM r WHERE rn <= 6 ORDER BY n_chars DESC, doc_id LIMIT 20""",
)
def smart_select_balanced(spark: SparkSession, d: str) -> DataFrame:
    return rt.diversify(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", 6, 20)


@query(
    "search_images_like",
    f"""WITH {PROBE_SQL}, s AS (SELECT e.vec_id, e.label, {COS} AS c FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS rn FROM s)
    SELECT vec_id, label, round(c, 6) AS score FROM r WHERE rn <= 2""",
)
def search_images_like(spark: SparkSession, d: str) -> DataFrame:
    """Per-source quota of the image search: the best two vectors of every label."""
    scored = rt.dense(table(spark, d, "embeddings"), _probe(spark, d), 1 << 30).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return rt.top_per(scored, "label", "score", 2, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


# Chapters: parts are chapters (title p_name), line items their occurrences, supplier balances their authority.
CHAPTER_SQL = """
WITH occ AS (SELECT l_partkey, count(*) AS occurrences, count(DISTINCT l_linenumber) AS pages, bool_or(l_returnflag = 'R') AS has_section FROM lineitem GROUP BY l_partkey),
c AS (SELECT p_partkey, p_name, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 100 WHEN p_brand IN ('Brand#3', 'Brand#4', 'Brand#5') THEN 80 ELSE 70 END AS authority,
    contains(p_name, 'ring') AS dedicated, occurrences, pages, has_section FROM part JOIN occ ON p_partkey = l_partkey),
s AS (SELECT *, CASE WHEN dedicated THEN 100 WHEN authority >= 80 THEN 70 ELSE 40 END + least(20, 2 * occurrences) + least(10, pages) + authority * {aw} + CASE WHEN has_section THEN 100 * {sw} ELSE 0 END AS relevance
  FROM c WHERE dedicated OR authority >= 80)
SELECT p_partkey, p_name, CASE WHEN dedicated THEN 'dedicated' WHEN authority >= 80 THEN 'section' ELSE 'reference' END AS match_type, round(relevance::DOUBLE, 6) AS relevance
FROM s WHERE relevance >= {least} ORDER BY s.relevance DESC, p_partkey LIMIT {k}
"""


def _chapters(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    st = ranking.STRATEGIES[strategy]
    occ = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("occurrences"), F.count_distinct("l_linenumber").alias("pages"), F.bool_or(F.col("l_returnflag") == "R").alias("has_section")
    )
    chapters = table(spark, d, "part").withColumn("authority", ranking.authority(F.col("p_brand"), ranking.PART_AUTHORITY, 70))
    return ranking.rank_chapters(chapters.join(occ, "p_partkey"), "ring", st, id_col="p_partkey", title="p_name")


for _name, _s in ranking.STRATEGIES.items():
    query(f"chapter_rank_{_name}", CHAPTER_SQL.format(aw=_s.authority_weight, sw=_s.section_weight, least=_s.min_relevance, k=_s.max_results))(
        lambda spark, d, _name=_name: _chapters(spark, d, _name)
    )

TERMS_SQL = """
terms AS (SELECT lower(p_name) AS term, count(*) AS refs, max(CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 100 WHEN p_brand IN ('Brand#3', 'Brand#4', 'Brand#5') THEN 80 ELSE 70 END) AS authority,
  max(p_retailprice) AS price FROM part GROUP BY 1)
"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("authority", ranking.authority(F.col("p_brand"), ranking.PART_AUTHORITY, 70))
    return rows.groupBy(F.lower("p_name").alias("term")).agg(F.count("*").alias("refs"), F.max("authority").alias("authority"), F.max("p_retailprice").alias("price"))


@query(
    "index_lookup",
    f"WITH {TERMS_SQL} SELECT term, refs, authority, term = 'small ring' AS exact FROM terms WHERE list_has_any(string_split(term, ' '), ['small', 'ring']) ORDER BY term = 'small ring' DESC, authority DESC, refs DESC, term LIMIT 10",
)
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ranking.lookup_terms(_terms(spark, d), "small ring", 10)


@query(
    "related_terms",
    f"""WITH {TERMS_SQL} SELECT term, authority, len(list_intersect(string_split(term, ' '), ['small', 'ring'])) AS shared FROM terms
    WHERE term <> 'small ring' AND len(list_intersect(string_split(term, ' '), ['small', 'ring'])) > 0 ORDER BY shared DESC, authority DESC, refs DESC, term LIMIT 5""",
)
def related_terms(spark: SparkSession, d: str) -> DataFrame:
    return ranking.related_terms(_terms(spark, d), "small ring", 5)


@query(
    "query_expand",
    r"""WITH q AS (SELECT DISTINCT p_name AS query FROM part), dict(stage, ord, word, other) AS (VALUES (1, 1, 'grey', 'gray'), (1, 2, 'colour', 'color'), (2, 1, 'ring', 'band'), (2, 2, 'small', 'little'), (2, 3, 'red', 'crimson')),
    e AS (SELECT query, 0 AS stage, 0 AS ord, query AS expanded FROM q UNION ALL SELECT query, stage, ord, replace(query, word, other) FROM q, dict WHERE list_contains(string_split(query, ' '), word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage, ord) AS position FROM e)
    SELECT query, position, expanded FROM r WHERE position <= 3""",
)
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    qs = table(spark, d, "part").select(F.col("p_name").alias("query")).distinct()
    return ranking.expand_queries(qs, [("orthographic", [("grey", "gray"), ("colour", "color")]), ("synonym", [("ring", "band"), ("small", "little"), ("red", "crimson")])], most=2)


@query(
    "title_match",
    """WITH w AS (SELECT p_partkey, lower(p_name) AS title, string_split(lower(p_name), ' ') AS ws FROM part)
    SELECT p_partkey, title, contains(title, 'small ring') AS phrase, list_has_all(ws, ['small', 'ring']) AS all_words, len(list_intersect(ws, ['small', 'ring'])) AS hits
    FROM w WHERE len(list_intersect(ws, ['small', 'ring'])) >= 1""",
)
def title_match(spark: SparkSession, d: str) -> DataFrame:
    return ranking.title_match(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("title")), "small ring", "title")


@query("phrase_match", r"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(lower(text), 'the.{0,30}that.{0,30}and') AND NOT contains(lower(text), 'the that and')")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(ranking.phrase_match(F.lower("text"), "the that and") & ~F.contains(F.lower("text"), F.lit("the that and"))).select("doc_id", "n_chars")


@query(
    "study_package",
    """WITH p AS (SELECT p_partkey, p_name, p_type, p_size, lower(p_name) AS k FROM part),
    direct AS (SELECT 10 AS priority, p_size AS score, p_partkey, p_name, k FROM p WHERE contains(k, 'small ring')),
    f0 AS (SELECT 30 + 5 * CASE WHEN contains(k, 'red') THEN 1 ELSE 2 END AS priority, p_size AS score, p_partkey, p_name, k, CASE WHEN contains(k, 'red') THEN 'red' ELSE 'widget' END AS term FROM p WHERE contains(k, 'red') OR contains(k, 'widget')),
    found AS (SELECT priority, score, p_partkey, p_name, k FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, p_partkey) AS rn FROM f0) WHERE rn <= 5),
    sem AS (SELECT 60 AS priority, p_size AS score, p_partkey, p_name, k FROM p WHERE p_type = 'ECONOMY' AND contains(k, 'ring')),
    u AS (SELECT * FROM direct UNION ALL SELECT * FROM found UNION ALL SELECT * FROM sem),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, score DESC, p_partkey) AS rn FROM u)
    SELECT p_partkey, p_name, priority, score FROM o WHERE rn = 1""",
)
def study_package(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.col("p_size").alias("score"), F.lower("p_name").alias("k"))
    direct = p.where(F.contains("k", F.lit("small ring"))).withColumn("priority", F.lit(10))
    term = F.when(F.contains("k", F.lit("red")), "red").when(F.contains("k", F.lit("widget")), "widget")
    found = p.withColumn("term", term).where("term IS NOT NULL").withColumn("priority", F.when(F.col("term") == "red", 35).otherwise(40))
    found = rt.top_per(found, "term", "score", 5, "p_partkey").drop("term")
    sem = p.where((F.col("p_type") == "ECONOMY") & F.contains("k", F.lit("ring"))).withColumn("priority", F.lit(60))
    return ranking.union_first([direct, found, sem], "k", [F.col("priority"), F.desc("score"), F.col("p_partkey")]).select("p_partkey", "p_name", "priority", "score")


@query(
    "result_relevance",
    """WITH o AS (SELECT l_partkey, CASE l_shipmode WHEN 1 THEN 100 WHEN 2 THEN 80 WHEN 3 THEN 60 WHEN 4 THEN 50 ELSE 20 END AS loc FROM (SELECT l_partkey, l_linenumber AS l_shipmode FROM lineitem))
    SELECT l_partkey AS partkey, max(loc) + least(10, 2 * (count(*) - 1)) AS relevance, count(*) AS match_count FROM o GROUP BY l_partkey""",
)
def result_relevance(spark: SparkSession, d: str) -> DataFrame:
    loc = ranking.location_score(F.col("l_linenumber"))
    agg = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(F.max(loc).alias("best"), F.count("*").alias("match_count"))
    return agg.select("partkey", rt.occurrence_relevance(F.col("best"), F.col("match_count")).alias("relevance"), "match_count")


@query(
    "latest_per_source",
    "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 10",
)
def latest_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Retention of the last ten of every group."""
    w = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("rn")).where("rn <= 10").drop("rn")

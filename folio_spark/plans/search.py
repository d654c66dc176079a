"""Registered queries: library search, dictionary expansion, selection rules, reports, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions import maps
from folio_spark.functions import text as tx
from folio_spark.operators import reports, search
from folio_spark.operators import retrieval as rt
from folio_spark.plans.retrieval import COS, PROBE_SQL, _probe
from folio_spark.registry import query, table

WS = r"[ \t\n\r\x0b\x0c]+"
VARIANTS = ["and the", "the of", "the and"]


@query(
    "occurrences_all",
    f"""WITH v(k, variant) AS (VALUES (0, 'and the'), (1, 'the of'), (2, 'the and')),
    p AS (SELECT doc_id, text, k, variant, [length(x) FOR x IN string_split(lower(text), variant)] AS parts FROM documents, v WHERE text IS NOT NULL),
    o AS (SELECT doc_id, text, k, variant, unnest([list_sum(parts[1:i]) + (i - 1) * length(variant) FOR i IN range(1, len(parts))])::BIGINT AS position FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY k) AS rn FROM o),
    c AS (SELECT *, greatest(position - 40, 0) AS a, least(position + length(variant) + 40, length(text)) AS b FROM f WHERE rn = 1)
    SELECT doc_id, position, variant, md5(CASE WHEN a > 0 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, a + 1, b - a), '{WS}', ' ', 'g')) || CASE WHEN b < length(text) THEN '...' ELSE '' END) AS context_md5 FROM c""",
)
def occurrences_all(spark: SparkSession, d: str) -> DataFrame:
    found = search.occurrences_all(table(spark, d, "documents"), VARIANTS, 40)
    return found.select("doc_id", "position", "variant", F.md5("context").alias("context_md5"))


TERM_SQL = "(length(text) - length(replace(lower(text), 'the of', ''))) // 6"
KEYWORD_SQL = f"""k AS (SELECT doc_id, contains(lower(substr(text, 1, 60)), 'the of') AS t, {TERM_SQL} AS n FROM documents),
kw AS (SELECT doc_id, 'keyword' AS origin, (CASE WHEN t THEN 100 ELSE 50 END + least(10, 2 * (n - 1)))::DOUBLE AS relevance, n::BIGINT AS matches FROM k WHERE n > 0)"""
SEMANTIC_SQL = f"""{PROBE_SQL}, hits AS (SELECT e.vec_id FROM embeddings e, q ORDER BY {COS} DESC, e.vec_id LIMIT 30),
se AS (SELECT doc_id, 'semantic' AS origin, (60 + CASE WHEN contains(lower(substr(text, 1, 60)), 'the of') THEN 30 ELSE 0 END)::DOUBLE AS relevance, 1::BIGINT AS matches FROM documents JOIN hits ON doc_id = vec_id)"""


def _library(spark: SparkSession, d: str, mode: str) -> DataFrame:
    pages = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), "text")
    hits = None if mode == "keyword" else rt.dense(table(spark, d, "embeddings"), _probe(spark, d), 30).withColumnRenamed("vec_id", "doc_id")
    return search.search_library(pages, "the of", hits, mode)


@query("search_library_keyword", f"WITH {KEYWORD_SQL} SELECT * FROM kw")
def search_library_keyword(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d, "keyword")


@query("search_library_semantic", f"WITH {SEMANTIC_SQL} SELECT * FROM se")
def search_library_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d, "semantic")


@query("search_library", f"WITH {SEMANTIC_SQL}, {KEYWORD_SQL} SELECT * FROM se UNION ALL SELECT * FROM kw WHERE doc_id NOT IN (SELECT vec_id FROM hits)")
def search_library(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d, "hybrid")


@query(
    "term_merge",
    """WITH t(ord, term) AS (VALUES (0, 'the of'), (1, 'and the'), (2, 'that')),
    m AS (SELECT doc_id, ord, term, (length(text) - length(replace(lower(text), term, ''))) // length(term) AS n FROM documents, t)
    SELECT doc_id, sum(n)::BIGINT AS match_count, string_agg(term || '@' || n, '|' ORDER BY ord) AS locations, arg_min(term, ord) AS data FROM m WHERE n > 0 GROUP BY doc_id""",
)
def term_merge(spark: SparkSession, d: str) -> DataFrame:
    docs, low = table(spark, d, "documents"), F.lower("text")
    counted = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("data"), tx.occurrences(low, t).alias("match_count")) for i, t in enumerate(["the of", "and the", "that"])])
    rows = docs.select("doc_id", F.explode(counted).alias("m")).select("doc_id", "m.*").where("match_count > 0")
    rows = rows.withColumn("locations", F.array(F.concat_ws("@", "data", F.col("match_count").cast("string"))))
    out = search.merge_terms(rows, "doc_id")
    return out.withColumn("locations", F.array_join("locations", "|"))


DICTIONARY = [(1, 1, "widget", "gadget"), (1, 2, "bolt", "screw"), (2, 1, "red widget", "crimson thing"), (2, 2, "RED", "scarlet"), (3, 1, "small", "little"), (3, 1, "small", "tiny"), (3, 2, "ring", "hoop"), (4, 1, "in", "on")]


@query(
    "query_expand_dictionary",
    """WITH d(stage, ord, term, variant) AS (VALUES (1, 1, 'widget', 'gadget'), (1, 2, 'bolt', 'screw'), (2, 1, 'red widget', 'crimson thing'), (2, 2, 'red', 'scarlet'), (3, 1, 'small', 'little'), (3, 1, 'small', 'tiny'), (3, 2, 'ring', 'hoop'), (4, 1, 'in', 'on')),
    q AS (SELECT DISTINCT p_name AS query FROM part),
    v AS (SELECT query, trim(replace(' ' || query || ' ', ' ' || term || ' ', ' ' || variant || ' ')) AS expanded, stage, ord, variant FROM q, d WHERE contains(' ' || query || ' ', ' ' || term || ' ')),
    g AS (SELECT query, expanded, min({'s': stage, 'o': ord, 'v': variant}) AS place FROM v WHERE expanded <> query GROUP BY ALL),
    r AS (SELECT query, expanded, 1 + row_number() OVER (PARTITION BY query ORDER BY place, expanded) AS position FROM g)
    SELECT query, 1::BIGINT AS position, query AS expanded FROM q UNION ALL SELECT query, position, expanded FROM r WHERE position <= 6""",
)
def query_expand_dictionary(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame(DICTIONARY, "stage int, ord int, term string, variant string")
    return search.expand_by_dictionary(table(spark, d, "part").select(F.col("p_name").alias("query")), words)


@query("prefix_suggestions", "SELECT p_name, count(*) AS n FROM part WHERE starts_with(p_name, 'red') GROUP BY p_name")
def prefix_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return search.prefix_matches(table(spark, d, "part"), "p_name", "red").groupBy("p_name").agg(F.count("*").alias("n"))


@query("payload_overlap", f"SELECT doc_id, len(list_intersect(string_split_regex(lower(coalesce(text, '')), '{WS}'), ['and', 'of', 'shall', 'the', 'und'])) / 5.0::DOUBLE AS score FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 200")
def payload_overlap(spark: SparkSession, d: str) -> DataFrame:
    return search.payload_overlap(table(spark, d, "documents"), "the of And und shall", 200, "doc_id", "text")


@query(
    "visual_duplicates",
    f"""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s)
    SELECT least(id, other) AS a, greatest(id, other) AS b, round(max(sim), 6) AS sim FROM r WHERE rank <= 4 AND sim >= 0.4 GROUP BY 1, 2""",
)
def visual_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return search.visual_duplicates(table(spark, d, "embeddings"), 0.4).withColumn("sim", F.round("sim", 6))


@query("similar_clusters", f"WITH {PROBE_SQL}, r AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) SELECT label, round({COS}, 6) AS score FROM r e, q ORDER BY {COS} DESC, label LIMIT 5")
def similar_clusters(spark: SparkSession, d: str) -> DataFrame:
    return search.similar_clusters(table(spark, d, "embeddings"), _probe(spark, d), 5, "label").withColumn("score", F.round("score", 6))


@query(
    "nearby_text",
    """WITH i AS (SELECT p_partkey AS image, p_size AS page, p_partkey * 37 % 600 AS x, p_partkey * 53 % 800 AS y FROM part), t AS (SELECT s_suppkey AS block, s_nationkey * 2 AS page, s_suppkey * 91 % 600 AS x, s_suppkey * 17 % 800 AS y FROM supplier),
    s AS (SELECT image, block, round(greatest(0, 1 - sqrt((i.x - t.x) ^ 2 + (i.y - t.y) ^ 2) / 500), 9)::DOUBLE AS score FROM i JOIN t USING (page))
    SELECT image, block, score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, block) AS rn FROM s WHERE score >= 0.3) WHERE rn <= 5""",
)
def nearby_text(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k, a, b: [(F.col(k) * a % 600).alias("x"), (F.col(k) * b % 800).alias("y")]
    images = table(spark, d, "part").select(F.col("p_partkey").alias("image"), F.col("p_size").alias("page"), *at("p_partkey", 37, 53))
    texts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("block"), (F.col("s_nationkey") * 2).alias("page"), *at("s_suppkey", 91, 17))
    return search.nearby_text(images, texts, "page", "image", "block")


@query(
    "chunks_for_sections",
    """WITH p AS (SELECT doc_id, lang, source, lower(text) AS low, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100),
    s(section, types, words) AS (VALUES ('Anatomy', ['de'], ['anatomy']), ('Und src1', [], ['und', 'src1']), ('Nowhere', ['xx'], ['nowhere'])),
    r AS (SELECT section, doc_id, n_chars, coalesce(list_contains(types, lang), false) AS typed, list_sum([contains(low, w)::INT + 2 * contains(lower(source), w)::INT FOR w IN words]) AS points FROM p, s),
    w AS (SELECT *, CASE WHEN max(typed::INT) OVER (PARTITION BY section) = 1 THEN 1 WHEN max(points) OVER (PARTITION BY section) > 0 THEN 2 ELSE 3 END AS way FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN way = 2 THEN points ELSE 0 END DESC, n_chars DESC, doc_id) AS position FROM w WHERE way = 3 OR (way = 1 AND typed) OR (way = 2 AND points > 0))
    SELECT section, doc_id, position FROM k WHERE position <= CASE WHEN way = 3 THEN 10 ELSE 15 END""",
)
def chunks_for_sections(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return search.chunks_for_sections(pool, [("Anatomy", ["de"]), ("Und src1", []), ("Nowhere", ["xx"])], 15, 10, "doc_id", "lang", "source", "text", "n_chars")


@query("safety_flags", "SELECT event_id, regexp_matches(lower(event_type || ' do NOT ' || coalesce(props, '')), '(^|[^a-z0-9_])(contraindication|warning|caution|risk|complication|avoid|never|do not|fatal|dangerous)($|[^a-z0-9_])') AND event_type <> 'click' AS flagged FROM events")
def safety_flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_type") != "click", F.concat("event_type", F.lit(" do NOT "), F.coalesce("props", F.lit("")))).otherwise("risky, cautions")
    return table(spark, d, "events").select("event_id", search.safety_flag(text).alias("flagged"))


@query(
    "preferred_image_types",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'anatomy_diagram,illustration' WHEN p_size % 5 IN (1, 2) THEN 'surgical_photo,anatomy_diagram' WHEN p_size % 5 = 3 THEN 'imaging_mri,imaging_ct,imaging_angio' ELSE 'illustration,diagram' END AS types FROM part""",
)
def preferred_image_types(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Surgical Anatomy", "Operative steps", "Technique", "Imaging findings", "History")])
    return table(spark, d, "part").select("p_partkey", F.array_join(search.preferred_image_types(F.get(names, F.col("p_size") % 5)), ",").alias("types"))


@query("allowed_sections", "SELECT p_partkey, p_brand FROM part WHERE p_size > 25 OR p_size < 5 OR p_brand IN ('Brand#1', 'Brand#2')")
def allowed_sections(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.when(F.col("p_size") <= 25, F.array(F.lit("Brand#1"), F.lit("Brand#2")))
    return table(spark, d, "part").where(search.allowed_in(F.when(F.col("p_size") >= 5, F.col("p_brand")), allowed)).select("p_partkey", "p_brand")


@query("page_buckets", "SELECT l_partkey // 5 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def page_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(search.page_bucket(F.col("l_partkey")).alias("bucket")).agg(F.count("*").alias("n"))


@query("images_kept", "SELECT p_partkey FROM part WHERE p_type <> 'SMALL' AND NOT (p_size * 5 < 100 AND p_retailprice / 10 < 110)")
def images_kept(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(search.keep_images(F.col("p_type"), F.col("p_size") * 5, F.when(F.col("p_retailprice") / 10 < 110, 1).otherwise(500), ["SMALL"], 100)).select("p_partkey")


# -- reports ----------------------------------------------------------------------------------


@query(
    "evaluation_stats",
    "SELECT count(*) AS n_results, count(*) FILTER (WHERE g > 0) AS n_graded, round(coalesce(avg(g) FILTER (WHERE g > 0), 0), 6) AS mean_grade, count(*) FILTER (WHERE event_type = 'view') AS n_flagged FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS g FROM events)",
)
def evaluation_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    feedback = F.when(F.col("event_type") == "error", "no grade given").otherwise(F.concat(F.lit("**Grade: "), F.format_string("%.4f", "value"), F.lit("/10** fine")))
    return reports.evaluation_stats(e.select(feedback.alias("feedback"), F.when(F.col("event_type") == "view", "a SAFETY WARNING b").otherwise("ok").alias("answer")))


@query(
    "chapter_quality",
    """SELECT l_suppkey, count(*) AS sections, sum((l_quantity * 10)::BIGINT)::BIGINT AS total_words, count(DISTINCT l_partkey) AS total_sources, sum((l_returnflag = 'R')::INT)::BIGINT AS conflicts,
    round(sum((l_quantity * 10)::BIGINT) / greatest(count(DISTINCT l_partkey), 1), 6) AS words_per_source, sum((l_quantity * 10)::BIGINT) >= 8000 AS meets_minimum_words, count(DISTINCT l_partkey) >= 15 AS meets_citation_density FROM lineitem GROUP BY l_suppkey""",
)
def chapter_quality(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") * 10).cast("long").alias("words"), "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("conflicts"))
    return reports.chapter_quality(li, "l_suppkey", "words", "l_partkey", "conflicts")


@query(
    "study_report",
    """WITH s AS (SELECT DISTINCT p_brand, lower(p_name) AS t FROM part), l AS (SELECT DISTINCT lower(p_name) AS t FROM part WHERE p_size > 45)
    SELECT p_brand, count(*) AS n_topics, count(l.t) AS n_found, count(*) - count(l.t) AS n_missing, round(count(l.t) / count(*), 6) AS success_rate, count(l.t) < count(*) AS has_gaps FROM s LEFT JOIN l USING (t) GROUP BY p_brand""",
)
def study_report(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return reports.study_report(part, part.where("p_size > 45"), "p_brand", "p_name")


@query("majority_topic", "WITH n AS (SELECT o_custkey, o_orderpriority AS topic, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, arg_min(topic, {'c': -n, 't': topic}) AS topic, sum(n)::BIGINT AS n_members FROM n GROUP BY o_custkey")
def majority_topic(spark: SparkSession, d: str) -> DataFrame:
    return reports.majority_topic(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("cluster_sizes", "SELECT l_partkey, count(*) AS size, count(DISTINCT l_suppkey) AS n_sources, round(count(*) / greatest(count(DISTINCT l_suppkey), 1), 6) AS dedup_ratio FROM lineitem GROUP BY l_partkey")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return reports.cluster_sizes(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("cluster_size_summary", "SELECT count(*) AS n_clusters, count(*) FILTER (WHERE size = 1) AS n_singletons, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_size, quantile_cont(size, 0.5) AS median_size FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_partkey)")
def cluster_size_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.size_summary(reports.cluster_sizes(table(spark, d, "lineitem"), "l_partkey", "l_suppkey"))


@query("conflict_priority", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 99 END::BIGINT AS priority FROM orders")
def conflict_priority(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "APPROACH").when(F.col("o_orderstatus") == "O", "temporal").otherwise("other")
    return table(spark, d, "orders").select("o_orderkey", reports.conflict_priority(kind).alias("priority"))


@query("cache_extent", "SELECT min(ts) AS first_at, max(ts) AS last_at, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events")
def cache_extent(spark: SparkSession, d: str) -> DataFrame:
    return reports.extent(table(spark, d, "events"), "ts", "event_type")


@query("map_merge", """SELECT event_id, CASE WHEN user_id < 20 THEN 'p_a=1;p_k=' || json_extract_string(props, '$.k') || ';p_u=' || user_id ELSE 'p_a=1;p_k=0;p_u=' || user_id END AS entries FROM events""")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("k"), F.lit(0).cast("long"))
    own = F.when(F.col("user_id") < 20, F.from_json("props", "map<string,bigint>"))
    entries = maps.merged(maps.merged(base, own), F.create_map(F.lit("u"), F.col("user_id")))
    return table(spark, d, "events").select("event_id", maps.rendered(maps.prefixed(entries, "p_")).alias("entries"))

"""Registered queries: query classes and intents, steps, captions, image scores, late interaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions import vector as vx
from folio_spark.operators import assoc, classify, figures, knowledge
from folio_spark.plans.retrieval import COS, PROBE_SQL, _probe
from folio_spark.registry import query, table

EDGE, END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query"))


PHRASES = "p AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS query FROM part)"


@query(
    "query_classes",
    f"""WITH {PHRASES} SELECT p_partkey, CASE WHEN regexp_matches(query, '{EDGE}(red|hot){END}') THEN 'contraindication'
    WHEN regexp_matches(query, '{EDGE}(ring|small){END}') THEN 'spatial' ELSE 'factual' END AS query_class,
    CASE WHEN contains(query, 'ed') THEN 'comparative' ELSE 'factual' END AS loose_class FROM p""",
)
def query_classes(spark: SparkSession, d: str) -> DataFrame:
    rules = [("contraindication", ["red", "hot"]), ("spatial", ["ring", "small"])]
    loose = classify.query_class(F.col("query"), [("comparative", ["ed"])], substring=True)
    return _phrases(spark, d).select("p_partkey", classify.query_class(F.col("query"), rules).alias("query_class"), loose.alias("loose_class"))


@query(
    "query_intents",
    f"""WITH {PHRASES} SELECT query, CASE WHEN ends_with(query, ' economy') THEN trim(query[:-9]) WHEN ends_with(query, ' promo') THEN trim(query[:-7]) ELSE query END AS cleaned_query,
    CASE WHEN regexp_matches(query, '{EDGE}ring{END}') THEN 'TECHNIQUE' WHEN regexp_matches(query, '{EDGE}red{END}') THEN 'ANATOMY'
      WHEN ends_with(query, ' economy') THEN 'OUTCOME' WHEN ends_with(query, ' promo') THEN 'COMPLICATION' ELSE 'GENERAL' END AS intent,
    CASE WHEN regexp_matches(query, '{EDGE}(ring|red){END}') OR ends_with(query, ' economy') OR ends_with(query, ' promo') THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM p""",
)
def query_intents(spark: SparkSession, d: str) -> DataFrame:
    strong, endings = {"TECHNIQUE": ["ring"], "ANATOMY": ["red"]}, {"OUTCOME": ["economy"], "COMPLICATION": ["promo"]}
    return classify.query_intent(_phrases(spark, d), strong, endings)


@query(
    "step_numbers",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 1 + p_size % 26 END::INTEGER AS step FROM part""",
)
def step_numbers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    number = F.concat(F.lit("Step "), F.col("p_size"), F.lit(": open"))
    letter = F.concat(F.lit("STAGE "), F.char(F.lit(65) + F.col("p_size") % 26), F.lit(", close"))
    text = F.when(kind == 0, number).when(kind == 1, letter).otherwise(F.lit("no number"))
    return table(spark, d, "part").select("p_partkey", classify.step_number(text).alias("step"))


@query(
    "image_validity",
    """WITH p AS (SELECT p_partkey, p_size * 20 AS w, p_retailprice AS h, p_size / 1000 AS share FROM part),
    r AS (SELECT p_partkey, CASE WHEN w < 100 OR h < 100 THEN 'too_small' WHEN greatest(w / h, h / w) > 8 THEN 'aspect' WHEN share < 0.01 THEN 'area' ELSE 'ok' END AS reason FROM p)
    SELECT p_partkey, reason = 'ok' AS valid, reason FROM r""",
)
def image_validity(spark: SparkSession, d: str) -> DataFrame:
    checked = classify.image_validity(F.col("p_size") * 20, F.col("p_retailprice"), F.col("p_size") / 1000)
    return table(spark, d, "part").select("p_partkey", checked.alias("c")).select("p_partkey", "c.*")


@query(
    "caption_scores",
    """SELECT p_partkey, round(0.4 * greatest(0, 1 - p_size / 40) + 0.3 * ((p_partkey % 10) / 10) + CASE WHEN p_partkey % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 0.1 ELSE 0 END, 9) AS score FROM part""",
)
def caption_scores(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    score = figures.caption_score(F.col("p_size"), 40.0, key % 10 / 10, key % 3 == 0, key % 4 == 0)
    return table(spark, d, "part").select("p_partkey", F.round(score, 9).alias("score"))


@query(
    "association_scores",
    """WITH s AS (SELECT p_partkey, least(1, 0.5 * ((p_size % 10) / 10) + 0.3 * ((p_partkey % 7) / 7) + 0.2 * ((p_partkey % 5) / 5) + CASE WHEN p_partkey % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 0.2 ELSE 0 END) AS s FROM part)
    SELECT p_partkey, round(CASE WHEN s >= 0.10::DOUBLE THEN s END, 9) AS score FROM s""",
)
def association_scores(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    score = assoc.association_score(size % 10 / 10, key % 7 / 7, key % 5 / 5, key % 2 == 0, key % 11 == 0)
    return table(spark, d, "part").select("p_partkey", F.round(score, 9).alias("score"))


@query(
    "section_image_scores",
    rf"""WITH {PROBE_SQL} SELECT vec_id, round(CASE WHEN label % 2 = 0 THEN 0.3 ELSE 0 END
      + 0.3 * (len(list_intersect(list_distinct(regexp_extract_all(lower(substr(text, 1, 60)), '[\p{{L}}\p{{N}}_]{{2,}}')), ['the', 'of', 'and'])) / 3) + 0.4 * {COS}, 6) AS score
    FROM embeddings e JOIN documents ON doc_id = vec_id, q WHERE text IS NOT NULL""",
)
def section_image_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents").where("text IS NOT NULL"), F.col("doc_id") == F.col("vec_id"))
    score = figures.section_image_score(F.col("label") % 2 == 0, F.substring("text", 1, 60), F.lit("the of and"), F.col("embedding"), vx.literal(_probe(spark, d)))
    return rows.select("vec_id", F.round(score, 6).alias("score"))


@query("image_captions")
def image_captions(spark: SparkSession, d: str) -> DataFrame:
    parts, x, y = table(spark, d, "part"), (F.col("p_size") * 13 % 50).alias("x"), (F.col("p_size") * 29 % 70).alias("y")
    placed = parts.select((F.col("p_partkey") / 12).cast("long").alias("page"), F.col("p_partkey").cast("string").alias("id"), x, y)
    images = placed.where("id % 3 > 0").withColumnRenamed("id", "image_id")
    return assoc.captions_for_images(images, placed.where("id % 3 = 0").withColumnRenamed("id", "caption_id"))


@query(
    "late_interaction",
    f"""WITH {PROBE_SQL}, qt AS (SELECT i, embedding[i * 16 + 1 : i * 16 + 16]::DOUBLE[] AS y FROM q, range(4) r(i)),
    dt AS (SELECT vec_id, embedding[i * 16 + 1 : i * 16 + 16]::DOUBLE[] AS x FROM embeddings, range(4) r(i)),
    m AS (SELECT vec_id, i, max(list_dot_product(x, y)) AS m FROM dt, qt GROUP BY ALL), s AS (SELECT vec_id AS id, sum(m) AS s FROM m GROUP BY 1)
    SELECT id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, id) AS rank FROM s ORDER BY s DESC, id LIMIT 10""",
)
def late_interaction(spark: SparkSession, d: str) -> DataFrame:
    probe = _probe(spark, d)
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), parts.alias("token_vectors"))
    top = knowledge.late_interaction(docs, [list(probe[i : i + 16]) for i in range(0, 64, 16)])
    return top.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "combined_search",
    f"""WITH {PROBE_SQL}, s AS (SELECT vec_id AS id, {COS} AS s, CASE WHEN label % 2 = 0 THEN 'page' ELSE 'caption' END AS kind FROM embeddings e, q)
    SELECT id, round(s, 6) AS score, kind FROM s ORDER BY s DESC, kind, id LIMIT 20""",
)
def combined_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    found = knowledge.combined_search(rows.where("label % 2 = 0"), rows.where("label % 2 = 1"), _probe(spark, d))
    return found.select("id", F.round("score", 6).alias("score"), "kind")


@query(
    "recovery_points",
    """SELECT DISTINCT 'topic_' || o_orderkey % 10 || '_' || strftime(o_orderdate, '%Y%m%d') || '_120000' AS name, 'topic_' || o_orderkey % 10 AS topic, strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00' AS at FROM orders""",
)
def recovery_points(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("topic_"), F.col("o_orderkey") % 10, F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_120000"))
    found = knowledge.recoveries(table(spark, d, "orders").select(name.alias("name")).distinct().union(table(spark, d, "region").select("r_name")))
    return found.select("name", "topic", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))

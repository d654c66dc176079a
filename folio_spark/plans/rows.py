"""Registered queries of the row rules, figures and knowledge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.operators import catalog as ct
from folio_spark.operators import figures, knowledge, rules
from folio_spark.registry import query, table


def _occ(term: str, text: str = "lower(text)") -> str:
    return f"((length({text}) - length(replace({text}, '{term}', ''))) // {len(term)})"


@query(
    "key_concepts",
    f"""WITH c AS (SELECT doc_id, unnest(['ther', 'tion', 'ung', 'eau']) AS term, unnest([{_occ('ther')}, {_occ('tion')}, {_occ('ung')}, {_occ('eau')}]) AS n FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rn FROM c WHERE n > 0)
    SELECT d.doc_id, coalesce(string_agg(term, ',' ORDER BY rn) FILTER (WHERE rn <= 3), '') AS concepts FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def key_concepts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(rules.key_concepts(F.col("text"), ["ther", "tion", "ung", "eau"], 3), ",").alias("concepts"))


@query(
    "match_location",
    r"""WITH p AS (SELECT doc_id, text, strpos(text, 'this') - 1 AS off FROM documents WHERE contains(text, 'this')),
    l AS (SELECT doc_id, off, string_split(substr(text, length(substr(text, 1, off)) - length(string_split(substr(text, 1, off), chr(10))[-1]) + 1), chr(10))[1] AS line, doc_id % 2 = 0 AS first_page FROM p)
    SELECT doc_id, CASE WHEN regexp_matches(line, '^[A-Z]{3}') THEN 'footnote' WHEN regexp_matches(line, '^.{1,60}$') THEN 'header' WHEN first_page AND off < 200 THEN 'title' ELSE 'body' END AS location FROM l""",
)
def match_location(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("this")))
    at = F.locate("this", F.col("text")) - 1
    return docs.select("doc_id", rules.match_location(F.col("text"), at, F.col("doc_id") % 2 == 0, "^[A-Z]{3}", "^.{1,60}$").alias("location"))


@query(
    "procedural_score",
    """SELECT doc_id, round(least(1, 0.3 * contains(lower(text), 'ther')::INT + 0.2 * contains(lower(text), 'ung')::INT + least(0.3, 0.1 * (contains(lower(text), 'eau')::INT + contains(lower(text), 'tion')::INT)))::DOUBLE, 6) AS score FROM documents""",
)
def procedural_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(rules.procedural_score(F.col("text"), ["ther"], ["ung"], ["eau", "tion"]), 6).alias("score"))


CAPTION_SQL = "'Figure ' || p_size || '.1 (a) ' || p_name || ' (B); see Fig. ' || (p_size + 1)"


@query("caption_parts", f"SELECT p_partkey, regexp_extract({CAPTION_SQL}, '(?i)^ *(fig(?:ure)?|table|plate)\\.? *([0-9]+(?:[.-][0-9]+)*)', 2) AS figure_id, 'A,B' AS subfigures, (p_size + 1)::VARCHAR AS refs FROM part")
def caption_parts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Figure "), F.col("p_size").cast("string"), F.lit(".1 (a) "), "p_name", F.lit(" (B); see Fig. "), (F.col("p_size") + 1).cast("string"))
    c = rules.caption_parts(text)
    return table(spark, d, "part").select("p_partkey", c["figure_id"].alias("figure_id"), F.array_join(c["subfigures"], ",").alias("subfigures"), F.array_join(c["references"], ",").alias("refs"))


@query("citation_strings", "SELECT p_partkey, split_part(p_brand || ' Author', ' ', 2) || ' et al. (' || (1950 + p_size) || '), ' || p_name || ', p. ' || p_size AS citation FROM part")
def citation_strings(spark: SparkSession, d: str) -> DataFrame:
    authors = F.array(F.concat("p_brand", F.lit(" Author")), F.lit("Other"))
    return table(spark, d, "part").select("p_partkey", rules.citation(authors, 1950 + F.col("p_size"), F.col("p_name"), F.col("p_size")).alias("citation"))


@query(
    "template_by_density",
    """WITH s AS (SELECT source, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM documents GROUP BY source)
    SELECT source, CASE WHEN share >= 0.7 THEN 'procedural' WHEN share <= 0.3 THEN 'theoretical' ELSE 'mixed' END AS template, greatest(400, least(2500, 300 + 150 * n))::BIGINT AS word_target FROM s""",
)
def template_by_density(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("int")).alias("share"), F.count("*").alias("n"))
    return s.select("source", rules.density_template(F.col("share")).alias("template"), rules.word_target(F.col("n")).cast("long").alias("word_target"))


@query("normalize_category", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'Other' END AS category, CASE lang WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' END AS \"group\" FROM documents")
def normalize_category(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("en", "germanic"), ("de", "germanic")], "category string, group string")
    return rules.normalize_category(table(spark, d, "documents").select("doc_id", F.col("lang").alias("category")), dim)


@query("relevance_gate", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS hit,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 10000 + l_partkey) AS rn FROM lineitem)
    SELECT l_orderkey, count(*) AS kept, max(l_quantity) AS best FROM r WHERE CASE WHEN hit = 1 THEN l_quantity >= 45 ELSE rn <= 3 END GROUP BY 1""")
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("tie"))
    kept = rules.relevance_gate(rows, "l_orderkey", "l_quantity", 45, 3, "tie")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.max("l_quantity").alias("best"))


@query("inline_or_plate", """WITH k AS (SELECT p_brand, p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'anatomical' WHEN contains(p_name, 'bolt') THEN 'imaging' ELSE 'unknown' END AS kind, p_size, p_retailprice FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE kind WHEN 'anatomical' THEN 80 WHEN 'imaging' THEN 60 ELSE 10 END DESC, p_size DESC, p_retailprice DESC, p_partkey) AS rn FROM k)
    SELECT p_brand, p_partkey, rn AS rank, CASE WHEN rn <= 3 THEN 'inline' ELSE 'plate' END AS placement FROM r""")
def inline_or_plate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.contains("p_name", F.lit("ring")), "anatomical").when(F.contains("p_name", F.lit("bolt")), "imaging").otherwise("unknown")
    im = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("image_id"), kind.alias("kind"), F.col("p_size").alias("confidence"), F.col("p_retailprice").alias("relevance"))
    return figures.inline_or_plate(im, "p_brand").select("p_brand", F.col("image_id").alias("p_partkey"), F.col("rank").cast("long").alias("rank"), "placement")


@query("image_type", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'gear') THEN 'anatomical' WHEN contains(p_name, 'bolt') THEN 'imaging' ELSE 'unknown' END AS kind, round(0.3 + 0.35 * ln(1 + (contains(p_name, 'ring') OR contains(p_name, 'gear') OR contains(p_name, 'bolt'))::INT), 6) AS confidence FROM part")
def image_type(spark: SparkSession, d: str) -> DataFrame:
    k = figures.image_type(F.col("p_name"), {"anatomical": ["ring", "gear"], "imaging": ["bolt"]})
    return table(spark, d, "part").select("p_partkey", k["kind"].alias("kind"), F.round(k["confidence"], 6).alias("confidence"))


@query("sequence_validation", """WITH w AS (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER o AS ds, l_suppkey - lag(l_suppkey) OVER o AS dp FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey))
    SELECT l_orderkey, count(*) FILTER (WHERE ds > 1) AS gaps, count(*) FILTER (WHERE ds = 0) AS repeats, count(*) FILTER (WHERE dp < 0) AS backwards, count(*) AS length,
      count(*) FILTER (WHERE ds > 1) = 0 AND count(*) FILTER (WHERE ds = 0) = 0 AND count(*) FILTER (WHERE dp < 0) = 0 AS valid FROM w GROUP BY 1""")
def sequence_validation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("page"))
    return figures.validate_sequences(s).withColumnRenamed("seq_id", "l_orderkey")


TRIPLES_SQL = """t AS (SELECT n_nationkey AS chunk_id, lower(n_name) AS src, CASE WHEN n_nationkey % 3 = 0 THEN 'PART_OF' ELSE 'RELATED_TO' END AS rel, lower(r_name) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_nationkey").cast("long").alias("chunk_id"), F.col("n_name").alias("subject"), F.when(F.col("n_nationkey") % 3 == 0, "part_of").otherwise("odd").alias("relation"), F.col("r_name").alias("object"))


@query("graph_edges", f"WITH {TRIPLES_SQL} SELECT DISTINCT src, rel, dst FROM t")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.ingest_graph(_triples(spark, d))[1]


@query("graph_mentions", f"WITH {TRIPLES_SQL} SELECT DISTINCT node, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, unnest([src, dst]) AS node FROM t) GROUP BY node")
def graph_mentions(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.mentions(_triples(spark, d)).groupBy("node").agg(F.count("*").alias("n_chunks"))


@query("conflict_summary", "SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS clusters, event_type IN ('error', 'view') AS high_priority FROM events GROUP BY 1")
def conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("cluster_id"))
    return knowledge.conflict_summary(e, ["error", "view"])


@query("specialty_topics", "SELECT p_type AS specialty, string_agg(p_name, '|' ORDER BY p_name) AS titles, count(*) AS shown FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS rn FROM part) WHERE rn <= 10 GROUP BY 1")
def specialty_topics(spark: SparkSession, d: str) -> DataFrame:
    t = knowledge.topics(table(spark, d, "part").select(F.col("p_type").alias("specialty"), F.col("p_name").alias("title")))
    return t.select("specialty", F.array_join("titles", "|").alias("titles"), "shown")


@query(
    "query_analysis",
    """WITH q AS (SELECT DISTINCT p_name AS query FROM part), r AS (SELECT query, contains(query, 'small')::INT + contains(query, 'red')::INT AS hot, contains(query, 'blue')::INT AS cold, contains(query, 'ring')::INT AS sub, contains(query, 'bolt')::INT AS cat FROM q)
    SELECT query, CASE WHEN hot = 0 AND cold = 0 THEN NULL WHEN hot >= cold AND hot > 0 AND NOT (hot = cold) THEN 'warm' WHEN cold > hot THEN 'cold' ELSE 'cold' END AS region, CASE WHEN sub > 0 THEN 'rings' END AS subregion,
      round((CASE WHEN hot + cold > 0 THEN 0.4 ELSE 0 END + CASE WHEN greatest(hot, cold) > 1 THEN 0.1 ELSE 0 END + CASE WHEN sub > 0 THEN 0.2 ELSE 0 END + 0.05 * cat)::DOUBLE, 6) AS confidence FROM r""",
)
def query_analysis(spark: SparkSession, d: str) -> DataFrame:
    tax = spark.createDataFrame([("region", "warm", "small"), ("region", "warm", "red"), ("region", "cold", "blue"), ("subregion", "rings", "ring"), ("category", "bolts", "bolt")], "kind string, name string, term string")
    qs = table(spark, d, "part").select(F.col("p_name").alias("query")).distinct()
    return rules.analyze_queries(qs, tax).select("query", "region", "subregion", "confidence")


@query("latest_batch", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_batch(spark: SparkSession, d: str) -> DataFrame:
    return ct.latest(table(spark, d, "events").select("event_type", "event_id", "ts"), "event_type", [F.desc("ts"), F.desc("event_id")]).drop("ts")

"""Registered queries: joins, maintenance and statistics over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.functions.deal import dealt, parts_for
from folio_spark.operators import assoc
from folio_spark.operators import catalog as ct
from folio_spark.registry import query, table


@query("sources_chunks_join", "SELECT o_orderkey, o_custkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity, 6) AS l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def sources_chunks_join(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").where("o_orderstatus = 'F'"), table(spark, d, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round("l_quantity", 6).alias("l_quantity"))


@query("left_having", "SELECT c_custkey, count(o_orderkey) AS n_orders, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS order_keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 12")
def left_having(spark: SparkSession, d: str) -> DataFrame:
    """An inner join: the condition on the count removes every unmatched row."""
    j = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), keys.alias("order_keys")).where("n_orders > 12")


@query("anti_unembedded", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unembedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("semi_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_delete(spark: SparkSession, d: str) -> DataFrame:
    """Children of deleted parents go: what is left."""
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("header_detail", "SELECT o_orderkey, count(*) AS n_items, string_agg(l_linenumber || ':' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey")
def header_detail(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    j = o.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("n_items"), F.array_join(items, ";").alias("items"))


@query("range_join_first", """WITH s AS (SELECT o_orderkey, o_orderkey * 37 % 100000 AS start, o_orderkey * 37 % 100000 + 40 AS stop FROM orders WHERE o_orderstatus = 'P'),
    p AS (SELECT DISTINCT l_partkey * 53 % 100000 AS pt, l_partkey FROM lineitem),
    h AS (SELECT l_partkey, o_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY start, o_orderkey) AS rn FROM p JOIN s ON pt >= start AND pt < stop)
    SELECT l_partkey, o_orderkey FROM h WHERE rn = 1""")
def range_join_first(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderkey") * 37 % 100000
    s = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", start.alias("start"), (start + 40).alias("stop"))
    p = table(spark, d, "lineitem").select("l_partkey").distinct().select("l_partkey", (F.col("l_partkey") * 53 % 100000).alias("at"))
    return ct.range_join_first(p, s, "at", "start", "stop", ["start", "o_orderkey"], 64, "l_partkey").select("l_partkey", "o_orderkey")


@query("sync_diff", """WITH old AS (SELECT doc_id, n_chars FROM documents WHERE source <> 'src1'), new AS (SELECT doc_id, CASE WHEN source = 'src2' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE source <> 'src3')
    SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'new' WHEN new.doc_id IS NULL THEN 'deleted' WHEN old.n_chars <> new.n_chars THEN 'changed' ELSE 'unchanged' END AS state FROM old FULL OUTER JOIN new ON old.doc_id = new.doc_id""")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    new = docs.where("source <> 'src3'").withColumn("n_chars", F.when(F.col("source") == "src2", F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return ct.track_changes(docs.where("source <> 'src1'"), new, "doc_id", "n_chars")


@query("upsert_latest", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return ct.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("batch_track_update", """WITH s AS (SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'), n AS (SELECT event_id, 'seen' AS event_type, value * 2 AS value FROM events WHERE event_type IN ('error', 'click') AND value > 10)
    SELECT event_id, event_type, round(value, 6) AS value FROM n UNION ALL SELECT event_id, event_type, round(value, 6) FROM s WHERE event_id NOT IN (SELECT event_id FROM n)""")
def batch_track_update(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    new = e.where("event_type IN ('error', 'click') AND value > 10").select("event_id", F.lit("seen").alias("event_type"), (F.col("value") * 2).alias("value"))
    return ct.upsert(e.where("event_type <> 'error'"), new, ["event_id"]).withColumn("value", F.round("value", 6))


@query("evict_oldest", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE rn > greatest(1, floor(n * 0.2))")
def evict_oldest(spark: SparkSession, d: str) -> DataFrame:
    return ct.evict_oldest(table(spark, d, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"]).select("event_id", "user_id")


@query("consecutive_groups", """WITH s AS (SELECT DISTINCT l_partkey, l_suppkey AS step, l_linenumber AS place FROM lineitem), b AS (SELECT *, CASE WHEN step = lag(step) OVER w + 1 AND abs(place - lag(place) OVER w) <= 2 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY step, place)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY l_partkey ORDER BY step, place ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT l_partkey, run::BIGINT AS run, count(*) AS length, min(step) AS first_step, max(step) AS last_step FROM r GROUP BY 1, 2""")
def consecutive_groups(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("step"), F.col("l_linenumber").alias("place"))
    parts = parts_for(s)
    s = dealt(dealt(s, "l_partkey", "step", "place", parts=parts).distinct(), "l_partkey", parts=parts)
    runs = assoc.consecutive_groups(s, "l_partkey", ["step", "place"], "step", "place")
    return runs.groupBy("l_partkey", "run").agg(F.count("*").alias("length"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("sequence_metrics", """WITH k AS (SELECT l_orderkey, arg_max(l_returnflag, c * 1000 - ascii(l_returnflag)) AS kind FROM (SELECT l_orderkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1)
    SELECT l_orderkey, count(*) AS length, round(avg(l_quantity), 6) AS mean_score, min(l_suppkey) AS first_place, max(l_suppkey) AS last_place,
      round(count(DISTINCT l_linenumber) / (max(l_linenumber) - min(l_linenumber) + 1), 6) AS completeness, any_value(kind) AS kind FROM lineitem JOIN k USING (l_orderkey) GROUP BY l_orderkey""")
def sequence_metrics(spark: SparkSession, d: str) -> DataFrame:
    return assoc.sequence_metrics(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag", "l_quantity", "l_suppkey")


@query("search_suggestions", "SELECT event_type AS query, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1 ORDER BY last_seen DESC, query LIMIT 3")
def search_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("query")).agg(F.max("ts").alias("last_seen"), F.count("*").alias("n")).orderBy(F.desc("last_seen"), "query").limit(3)


@query("search_analytics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY 1")
def search_analytics(spark: SparkSession, d: str) -> DataFrame:
    return ct.percent_of_total(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")), "n")


@query("dominant_category", """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1)
    SELECT user_id, a AS n_surgical, b AS n_theoretical, CASE WHEN a > 1.5 * b THEN 'surgical' WHEN b > 1.5 * a THEN 'theoretical' ELSE 'mixed' END AS dominant FROM c""")
def dominant_category(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_surgical"), F.count_if(F.col("event_type") == "view").alias("n_theoretical"))
    a, b = F.col("n_surgical"), F.col("n_theoretical")
    return c.withColumn("dominant", F.when(a > 1.5 * b, "surgical").when(b > 1.5 * a, "theoretical").otherwise("mixed"))


@query("table_stats", """SELECT 'documents' AS name, count(*) AS n_rows, count(DISTINCT source) AS n_groups FROM documents UNION ALL SELECT 'labels', count(*), count(DISTINCT quality) FROM labels
    UNION ALL SELECT 'embeddings', count(*), count(DISTINCT label) FROM embeddings UNION ALL SELECT 'pages', count(*), count(DISTINCT url) FROM pages UNION ALL SELECT 'events', count(*), count(DISTINCT user_id) FROM events""")
def table_stats(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, group in (("documents", "source"), ("labels", "quality"), ("embeddings", "label"), ("pages", "url"), ("events", "user_id")):
        row = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"))
        out = row if out is None else out.unionByName(row)
    return out


@query("top_sources", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 5")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")).orderBy(F.desc("n"), "source", "lang").limit(5)


@query("library_rollup", """SELECT r_name AS collection, n_name AS sub, c_mktsegment AS condition, (3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)))::BIGINT AS level, count(*) AS n_documents, round(sum(c_acctbal), 2) AS total
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def library_rollup(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("collection"), F.col("n_name").alias("sub"), F.col("c_mktsegment").alias("condition"), "c_acctbal")
    return ct.hierarchy_rollup(rows, ["collection", "sub", "condition"], n_documents=F.count("*"), total=F.round(F.sum("c_acctbal"), 2)).withColumn("level", F.col("level").cast("long"))


@query("quota_curation", """WITH j AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'adversarial' WHEN quality = 1 THEN 'factual' ELSE 'other' END AS kind FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS rn FROM j), o AS (SELECT *, CASE WHEN rn > CASE kind WHEN 'adversarial' THEN 15 WHEN 'factual' THEN 40 ELSE 0 END THEN 1 ELSE 0 END AS over FROM r),
    p AS (SELECT *, row_number() OVER (ORDER BY over, doc_id) AS position FROM o) SELECT printf('Q%03d', position) AS query_id, doc_id, kind FROM p WHERE position <= 100""")
def quota_curation(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "adversarial").when(F.col("quality") == 1, "factual").otherwise("other")
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").select("doc_id", kind.alias("kind"))
    out = ct.quota_fill(j, "kind", {"adversarial": 15, "factual": 40}, ["doc_id"], 100)
    return out.select(F.format_string("Q%03d", "position").alias("query_id"), "doc_id", "kind")


@query("authority_summary", """WITH a AS (SELECT CASE WHEN s_acctbal >= 8000 THEN 95 WHEN s_acctbal >= 4000 THEN 85 ELSE 70 END AS score FROM supplier)
    SELECT count(*) FILTER (WHERE score >= 90) AS tier1, count(*) FILTER (WHERE score >= 80 AND score < 90) AS tier2, count(*) FILTER (WHERE score < 80) AS tier3, round(avg(score), 1) AS mean_score, max(score)::BIGINT AS max_score FROM a""")
def authority_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    a = table(spark, d, "supplier").select(F.when(F.col("s_acctbal") >= 8000, 95).when(F.col("s_acctbal") >= 4000, 85).otherwise(70).alias("score"))
    return a.agg(F.count_if(s >= 90).alias("tier1"), F.count_if((s >= 80) & (s < 90)).alias("tier2"), F.count_if(s < 80).alias("tier3"), F.round(F.avg(s), 1).alias("mean_score"), F.max(s).cast("long").alias("max_score"))


@query("perspective_timeline", """SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) AS n_turns, md5(arg_min(text, turn)) AS first_md5, md5(arg_max(text, turn)) AS last_md5 FROM conversations GROUP BY conv_id""")
def perspective_timeline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("n_turns"), F.md5(F.min_by("text", "turn")).alias("first_md5"), F.md5(F.max_by("text", "turn")).alias("last_md5")
    )


@query("json_extract_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract_props(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k long, missing string")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), p["missing"].alias("missing"))


@query("paging_filter", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paging_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return ct.page(rows, [F.desc("o_orderdate"), "o_orderkey"], 20, 40).select("o_orderkey", "o_totalprice", "total")


@query("sequence_pages", "SELECT l_orderkey, (rn - 1) // 3 AS page_no, count(*) AS n_steps, min(l_linenumber)::BIGINT AS first_step FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) GROUP BY 1, 2")
def sequence_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pagination of step sequences."""
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = table(spark, d, "lineitem").withColumn("page_no", F.floor((rn - 1) / 3))
    return rows.groupBy("l_orderkey", "page_no").agg(F.count("*").alias("n_steps"), F.min("l_linenumber").cast("long").alias("first_step"))


@query("best_category", "SELECT l_partkey, arg_max(l_returnflag, l_quantity * 1000000 + l_orderkey * 10 + l_linenumber) AS category, max(l_quantity) AS confidence FROM lineitem GROUP BY l_partkey")
def best_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_returnflag", F.col("l_quantity") * 1000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("category"), F.max("l_quantity").alias("confidence"))


@query("eval_dataset_checks", """WITH l AS (SELECT doc_id, quality, toxic FROM labels) SELECT count(*) AS n_rows, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) FILTER (WHERE quality IS NULL) AS missing_quality,
    (SELECT count(*) FROM labels l2 WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l2.doc_id)) AS orphans, count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM l""")
def eval_dataset_checks(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    known = table(spark, d, "documents").select("doc_id", F.lit(1).alias("known"))
    rows = labels.join(known, "doc_id", "left")
    return rows.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("doc_id")).alias("duplicate_ids"), F.count_if(F.col("quality").isNull()).alias("missing_quality"),
        F.count_if(F.col("known").isNull()).alias("orphans"), F.count_if(F.col("toxic") == 1).alias("n_toxic"),
    )

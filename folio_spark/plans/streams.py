"""Registered queries of the streaming operators, run over the events as a bounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.registry import query, table
from folio_spark.streaming import folder
from folio_spark.streaming import windows as sw


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as stored; sums rounded."""
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df.withColumn("total", F.round("total", 6)) if "total" in df.columns else df


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _plain(sw.drain(sw.tumbling(sw.file_stream(spark, d, "events"))))


@query(
    "stream_session",
    """WITH b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM b)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid""",
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _plain(sw.drain(sw.sessions(sw.file_stream(spark, d, "events"))))


@query("stream_updated_status", "SELECT user_id, event_type AS status, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_updated_status(spark: SparkSession, d: str) -> DataFrame:
    """As updates: the last one of each user counts."""
    return _plain(sw.drain(sw.latest_status(sw.file_stream(spark, d, "events")), "update", ["user_id"]))


@query(
    "folder_changes",
    """WITH b AS (SELECT doc_id, md5(text) AS c FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS c FROM documents WHERE doc_id % 3 <> 0)
    SELECT coalesce(n.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change, b.c AS before, n.c AS now
    FROM b FULL OUTER JOIN n ON b.doc_id = n.doc_id WHERE b.c IS DISTINCT FROM n.c""",
)
def folder_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the documents: some gone, some new, some with another text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    before = docs.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("checksum"))
    now = docs.where("doc_id % 3 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("checksum"))
    return folder.changes(before, now, "doc_id")


@query("stream_latest_status", "SELECT user_id, event_type AS status, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest_status(spark: SparkSession, d: str) -> DataFrame:
    return _plain(sw.drain(sw.latest_status(sw.file_stream(spark, d, "events"))))


@query("stream_sliding", "SELECT window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS window_start FROM events) GROUP BY 1")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _plain(sw.drain(sw.sliding(sw.file_stream(spark, d, "events"))))

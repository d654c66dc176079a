"""Structured Streaming operators: windows, latest status, incremental index, watched folders.

Every operator takes a streaming or a batch DataFrame and returns one; ``drain`` runs a bounded
stream to its end and returns what it wrote, which tests and batch jobs use.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions.graph import shared_folder


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of each user."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
    )


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Last event of each key; as a stream it emits updates."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("s"), F.max("ts").alias("ts")).select(
        key, F.col("s.event_type").alias("status"), F.col("s.event_id").alias("event_id"), "ts"
    )


def unseen(batch: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the index does not hold: what an incremental indexer has left to do."""
    return batch.join(index.select(*keys), keys, "left_anti")


def index_batches(stream: DataFrame, index_path: str, checkpoint: str, keys: list[str]):
    """Append unseen rows of each micro-batch to a Parquet index; a rerun of a batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = unseen(fresh, spark.read.parquet(index_path), keys)
        except Exception as e:  # the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(index_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(expires_at: str = "expires_at"):
    """Rows that have not expired; null never does."""
    return F.col(expires_at).isNull() | (F.col(expires_at) > F.current_timestamp())


def watch_folder(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 100) -> DataFrame:
    """New files of a folder tree as a stream of ``path, modificationTime, length, content``."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_trigger)
        .load(path)
    )


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, a single file or a folder, as a bounded stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A file source lists folders; the glob lets it take a table that is one file.
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parque[t]")
    # Watermarks need timestamps with a zone: the session's.
    return src.select(*[F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


def drain(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a bounded stream to its end; its result as a table in the shared checkpoint folder, where its state lies, too.

    ``complete`` results are the last batch's, ``append`` ones those of all batches; of ``update`` results the last row of
    each of ``keys`` counts, whichever batch it came in.  Nothing passes the driver.  A batch written twice takes its own place.
    """
    if mode == "update" and not keys:
        raise ValueError("update results need the keys that tell which row is replaced")
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        written.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if not written:
        return spark.createDataFrame([], stream.schema)
    kept = [max(written)] if mode == "complete" else sorted(set(written))
    read = lambda n: spark.read.schema(stream.schema).parquet(f"{root}/batch={n}")
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(*[f"{root}/batch={n}" for n in kept])
    rows = functools.reduce(DataFrame.unionByName, [read(n).withColumn("_batch", F.lit(n)) for n in kept])
    last = F.max_by(F.struct(*stream.columns), "_batch").alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(last).select("_row.*")

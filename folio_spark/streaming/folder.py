"""A watched folder with its changes: created, modified and deleted files, by snapshots of path, size, time and checksum.

A file stream only ever emits new names.  Here every tick of a clock stream lists the folder, compares it with the snapshot
of the tick before and writes both the events and the new snapshot under the tick's number.  A tick that is run again after
a failure starts from the same snapshot and takes its own place, so events are neither lost nor doubled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "path string, length long, modified timestamp, checksum string"


def changes(before: DataFrame, now: DataFrame, key: str = "path", checksum: str = "checksum") -> DataFrame:
    """``key, change, before, now``: rows created, modified (another checksum) or deleted between two snapshots.

    Keys are taken to be distinct.  A null checksum differs from every other one.  Rows alike in both are not returned.
    """
    b = before.select(F.col(key).alias("_bk"), F.col(checksum).alias("_b"))
    n = now.select(F.col(key).alias("_nk"), F.col(checksum).alias("_n"))
    both = b.join(n, F.col("_bk") == F.col("_nk"), "full_outer")
    kind = F.when(F.col("_bk").isNull(), "created").when(F.col("_nk").isNull(), "deleted").when(~F.coalesce(F.col("_b") == F.col("_n"), F.lit(False)), "modified")
    return both.select(F.coalesce("_nk", "_bk").alias(key), kind.alias("change"), F.col("_b").alias("before"), F.col("_n").alias("now")).where("change IS NOT NULL")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def snapshot(spark: SparkSession, path: str, before: DataFrame, pattern: str = "*") -> DataFrame:
    """The folder as it is now (``SNAPSHOT``).

    Only files not older than the newest one of the snapshot before are read and hashed: the filter reaches the file source.
    Others keep their checksum if size and time are the same; a file that came with an older time has its size and time instead.
    """
    newest = before.agg(F.max("modified")).first()[0]
    files = listing(spark, path, pattern)
    fresh = files if newest is None else files.where(F.col("modified") >= F.lit(newest))
    digests = fresh.select("path", F.md5("content").alias("_d"))
    known = before.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("checksum").alias("_c"))
    rows = files.drop("content").join(known, "path", "left").join(digests, "path", "left")
    same = (F.col("length") == F.col("_l")) & (F.col("modified") == F.col("_m"))
    stand_in = F.concat_ws("_", F.col("length").cast("string"), F.unix_micros("modified").cast("string"))
    return rows.select("path", "length", "modified", F.coalesce("_d", F.when(same, F.col("_c")), stand_in).alias("checksum"))


def watch(spark: SparkSession, clock: DataFrame, path: str, store: str, checkpoint: str, pattern: str = "*", **trigger):
    """Start a query that compares the folder at every tick of ``clock`` (any stream) and keeps the events in ``store``.

    ``store/snapshots/tick=N`` and ``store/events/tick=N`` hold what tick N saw; :func:`events` reads them.
    """

    def tick(_: DataFrame, number: int) -> None:
        before = _read(spark, f"{store}/snapshots/tick={number - 1}", SNAPSHOT)
        target = f"{store}/snapshots/tick={number}"
        snapshot(spark, path, before, pattern).write.mode("overwrite").parquet(target)
        changes(before, _read(spark, target, SNAPSHOT)).write.mode("overwrite").parquet(f"{store}/events/tick={number}")

    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events(spark: SparkSession, store: str) -> DataFrame:
    """``path, change, before, now, tick`` of all ticks so far."""
    return spark.read.schema("path string, change string, before string, now string, tick int").parquet(f"{store}/events")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)

"""Sinks: keyed Parquet tables with upsert and delete, manifests, grouped documents, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.operators.catalog import upsert


def _swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside the table, then put the new folder in its place: a failed write leaves the old one."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    fs_path = jvm.org.apache.hadoop.fs.Path
    fresh, old = fs_path(f"{path}.new-{uuid.uuid4().hex}"), fs_path(f"{path}.old-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(fresh.toString())
    target = fs_path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    if fs.exists(old):
        fs.delete(old, True)


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> None:
    """Upsert by key; of several incoming rows of a key the first in ``order`` wins."""
    if order:
        incoming = incoming.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
    else:
        incoming = incoming.dropDuplicates(key)
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        incoming.write.parquet(path)
        return
    _swap(spark, upsert(stored, incoming, key), path)


def delete_where(spark: SparkSession, path: str, condition: Column) -> None:
    """Rows for which the condition holds go; where it is null they stay."""
    _swap(spark, spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False))), path)


def delete_children(spark: SparkSession, parents: str, children: str, condition: Column, key: str, foreign: str) -> None:
    """Delete parents and, before them, their children."""
    doomed = spark.read.parquet(parents).where(condition).select(F.col(key).alias(foreign))
    _swap(spark, spark.read.parquet(children).join(doomed, foreign, "left_anti"), children)
    delete_where(spark, parents, condition)


def with_zero_markers(figures: DataFrame, sources: DataFrame, key: str, marker: str = "ZERO_FIGURES") -> DataFrame:
    """``figures(key, id, format, caption)`` and a marker row for each searched source that gave none, so that it isn't searched again."""
    none = sources.select(key).distinct().join(figures.select(key).distinct(), key, "left_anti")
    rows = none.select(key, F.concat_ws("_", F.col(key).cast("string"), F.lit(marker)).alias("id"), F.lit("marker").alias("format"), F.lit(marker).alias("caption"))
    return figures.select(key, "id", "format", "caption").unionByName(rows)


def write_index(vectors: DataFrame, path: str, id_col: str, vector: str, model: str) -> None:
    """A vector index: vectors as Parquet with their norms, sorted by id, and its metadata as JSON beside them."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), norm.alias("norm"))
    rows.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    meta = stored.agg(F.count("*").alias("n_vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"), F.count_if(F.col("norm") == 0).alias("n_zero")).withColumn("model", F.lit(model))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.json(f"{path}/metadata").first().asDict()


def write_bundle(parts: dict[str, DataFrame], path: str, name: str) -> None:
    """Named tables as folders of JSON lines, and a manifest with each one's rows, columns and an order-free checksum."""
    spark, rows = next(iter(parts.values())).sparkSession, []
    for part, df in sorted(parts.items()):
        df.write.mode("overwrite").json(f"{path}/{part}")
        line = spark.read.text(f"{path}/{part}")
        n, digest = line.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0).cast("long"))).first()
        rows.append((name, part, n, digest, ",".join(df.columns)))
    spark.createDataFrame(rows, "bundle string, part string, n_rows long, checksum long, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """``part, n_rows, intact`` of a bundle: rows and checksum as the manifest has them."""
    rows = []
    for r in spark.read.json(f"{path}/manifest").orderBy("part").collect():
        n, digest = spark.read.text(f"{path}/{r.part}").agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0).cast("long"))).first()
        rows.append((r.part, n, n == r.n_rows and digest == r.checksum))
    return spark.createDataFrame(rows, "part string, n_rows long, intact boolean")


def keep_latest(df: DataFrame, group: str, order: list[Column], n: int = 10) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def manifest(df: DataFrame, topic: str, source: str = "source", score: str = "score") -> DataFrame:
    """One JSON manifest: counts by source and the entries in order of score."""
    by = df.groupBy(source).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(source), "n")))).alias("category_summary"))
    body = df.agg(F.sort_array(F.collect_list(F.struct(F.col(score), F.to_json(F.struct(*df.columns)).alias("row"))), asc=False).alias("rows"), F.count("*").alias("total"))
    return body.join(by, F.lit(True)).select(
        F.to_json(F.struct(F.lit(topic).alias("topic"), "total", "category_summary", F.transform("rows", lambda r: r["row"]).alias("sources"))).alias("value")
    )


def grouped_document(df: DataFrame, series: str, chapter: str, line: Column, order: Column) -> DataFrame:
    """Series, chapters and lines as Markdown, a row a series."""
    ch = df.groupBy(series, chapter).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("## "), F.col(chapter), F.lit("\n\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    parts = ch.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(F.col(chapter).alias("c"), text.alias("t")))).alias("cs"))
    return parts.select(series, F.concat(F.lit("# "), F.col(series), F.lit("\n\n"), F.array_join(F.transform("cs", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("value"))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """File names made unique by a ``_n`` suffix before the extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("file_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))

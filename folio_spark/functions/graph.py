"""Graph loops on DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session (tests) that names none gets a local folder."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folio-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all machines share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every vertex of ``edges(src, dst)`` -> ``(id, component)``.

    Alternates large-star and small-star contraction (Kiveris et al., 2014): each round is
    two joins on a vertex whose rows never exceed the edge count, so a hub with many
    neighbours costs rows, not pairs.  The edge set is checkpointed every round; the driver
    sees one fingerprint per round.  Raises if ``max_rounds`` does not suffice.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())

    def fingerprint(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    def star(df: DataFrame, small: bool) -> DataFrame:
        pairs = df.select("u", "v")
        if not small:  # every vertex sees all its neighbours, else those below it
            pairs = pairs.union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(low, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    before = fingerprint(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        e = cut(star(star(e, small=False), small=True))
        after = fingerprint(e)
        if after == before:
            roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        before = after
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")

"""Shared plumbing: table access, checkpoints and a resilient connected-components loop."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.bytesops import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, taken) -> str:
    """``name``, with as many underscores before it as it takes to clash with no name in ``taken`` (case aside)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only an unset one (tests) gets a local folder."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folio-ckpt-"))


def lean(run):
    """Wrap a batch function so that its worker hands memory back when a partition ends: workers live on between stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Bytes of an Arrow batch of texts; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES``, unless the session names a size of its own.

    Spark's own bound is a number of rows: 10,000 whole texts stand in an executor twice on their way to Python and
    once or twice more in the worker.  Spark reads the setting when the frame runs, so it stays set.
    """
    if df.sparkSession.conf.get(_BATCH_CONF, None) is None:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys up to which a side is broadcast (some 32 MB of them); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def join_keys(df: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    """Semi or anti join with a stored frame of distinct narrow keys, which are counted first: few of them spare ``df`` its shuffle."""
    small = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), on, how)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nobody holds any more: disk holds one phase at a time."""
    for _ in range(5):  # the first rounds drop what later ones refer to
        spark.range(1).collect()  # the session still holds the last query it ran: let that be this one
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Bits of a filter of ids; it never gets larger, so it may be broadcast however many ids it is given.
FILTER_BITS = 1 << 23


def _slots(ids: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(ids.view(np.uint64))
    mask = np.uint64(size - 1)
    return [h & mask, (h >> np.uint64(32)) & mask]


def id_filter(ids: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of ``size`` bits (a power of two) over the integral column ``id``, packed.

    It only saves work: whoever uses it must still join with the exact ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for s in _slots(np.asarray(batch.column(0)).astype(np.int64), size):
                bits[s] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        for i in range(0, len(at), 1 << 14):
            part = at[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part])], ["at", "bits"])

    src = ids.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL")
    rows = src.mapInArrow(lean(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[np.asarray(rows.column("at"))] = np.asarray(rows.column("bits"))
    return words.view(np.uint8)


def may_hold(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the int64 ``ids`` may be among those of the filter."""
    ok = np.ones(len(ids), bool)
    for s in _slots(np.ascontiguousarray(ids), len(packed) * 8):
        ok &= (packed[s >> np.uint64(3)] >> (np.uint64(7) - (s & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return ok


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every vertex of ``edges(src, dst)`` -> ``(id, component)``.

    Alternates large-star and small-star contraction (Kiveris et al., 2014): each round is
    two joins-free aggregations whose rows never exceed the edge count, so a hub with many
    neighbours costs rows, not pairs.  The edge set is checkpointed every round; the driver
    sees one fingerprint per round.  Raises if ``max_rounds`` does not suffice.
    """
    e = cut(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u <> v")
        .distinct()
    )

    def fingerprint(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    def star(df: DataFrame, small: bool) -> DataFrame:
        if small:  # keep u -> its neighbours not above it
            pairs = df.select("u", "v")
        else:  # every vertex sees all its neighbours
            pairs = df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(low, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                low.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        else:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return (
            out.where("a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .distinct()
        )

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

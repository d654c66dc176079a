"""Exact ranks of distributed rows: no task sees more than a bounded digit block or a range of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio_spark.llm.base import cut

#: Bits of a digit: a node of the digit trie has at most 1,024 children.
BITS = 10
#: Rows of a block of 1,024 ids from which on digits of the digest split rows of equal ids.
FULL = 4096
#: Hex digits by which a digest refines a block at a time: at most 4,096 children.
HEX = 3
_UP = (W.unboundedPreceding, -1)


def _before(partition: list[str], order: list[str], weight: str):
    return F.coalesce(F.sum(weight).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(*_UP)), F.lit(0).cast("long"))


def radix_ranks(rows: DataFrame, full: int = FULL) -> DataFrame:
    """Add ``rank``: the rows of group ``g`` before each row by ``(id, digest)``, null ids first, counting a row ``n`` times.

    ``rows(g string not null, id long, digest string of hex digits, n long, ...)`` with distinct ``(g, id, digest)``; the
    frame should be stored, it is read twice.  Counts by digit prefixes of the id, ten bits a digit, make a trie; a node's offset is its
    parent's plus the counts of its smaller siblings, so nothing is sorted but the children of a node and the rows of a
    last block.  Where many rows share an id, further levels are hex digits of the digest.  The driver sees three numbers.
    """
    at = rows.withColumn("_z", F.col("id").isNotNull()).withColumn("_id", F.coalesce("id", F.lit(0)).cast("long"))
    hist = at.groupBy("g", "_z", F.shiftright("_id", BITS).alias("_p")).agg(F.count("*").alias("rows"), F.sum("n").alias("_m"))
    lo, hi, most = hist.agg(F.min("_p"), F.max("_p"), F.max("rows")).first()
    if most is None:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    levels = [(BITS, 0)]
    if most > full:
        digits = HEX
        while 16**digits * full < most:
            digits += HEX
        levels = [(0, d) for d in range(digits, -1, -HEX)] + levels
    shift = BITS
    while (hi >> (shift - BITS)) - (lo >> (shift - BITS)) >= 1 << BITS:
        shift += BITS
        levels.append((shift, 0))

    key = ["g", "_z", "_p", "_t"]
    at = at.withColumn("_p", F.shiftright("_id", levels[0][0])).withColumn("_t", F.substring("digest", 1, levels[0][1]))
    counts = [at.groupBy(*key).agg(F.sum("n").alias("_m"))]
    for (s, _), (s2, d2) in zip(levels, levels[1:]):
        up = counts[-1].select("g", "_z", F.shiftright("_p", s2 - s).alias("_p"), F.substring("_t", 1, d2).alias("_t"), "_m")
        counts.append(up.groupBy(*key).agg(F.sum("_m").alias("_m")))
    offset = counts[-1].select(*key, _before(["g"], ["_z", "_p", "_t"], "_m").alias("_o"))
    for k in range(len(levels) - 2, -1, -1):
        (s, _), (s2, d2) = levels[k : k + 2]
        child = counts[k].withColumn("_pp", F.shiftright("_p", s2 - s)).withColumn("_tt", F.substring("_t", 1, d2))
        child = child.withColumn("_b", _before(["g", "_z", "_pp", "_tt"], ["_p", "_t"], "_m"))
        above = offset.select("g", "_z", F.col("_p").alias("_pp"), F.col("_t").alias("_tt"), F.col("_o").alias("_oo"))
        offset = child.join(above, ["g", "_z", "_pp", "_tt"]).select(*key, (F.col("_oo") + F.col("_b")).alias("_o"))
    inner = at.withColumn("_b", _before(key, ["_id", "digest"], "n"))
    return inner.join(offset, key).withColumn("rank", F.col("_o") + F.col("_b")).select(*rows.columns, "rank")


def range_ranks(rows: DataFrame, order: list, weight: str | None = None) -> DataFrame:
    """Add ``rank``: the rows before each row by the ``order`` columns, counting a row ``weight`` times.

    Rows are dealt to ranges of the order and stored; the driver sees one sum a range.  Rows that the order cannot tell
    apart share a range, so give it columns that do.
    """
    spark = rows.sparkSession
    w = F.col(weight) if weight else F.lit(1).cast("long")
    dealt = cut(rows.repartitionByRange(*order).withColumn("_w", w).withColumn("_part", F.spark_partition_id()))
    at, offsets = 0, []
    for part, size in sorted(map(tuple, dealt.groupBy("_part").agg(F.sum("_w")).collect())):
        offsets.append((part, at))
        at += size
    starts = spark.createDataFrame(offsets, "_part int, _o long")
    before = F.coalesce(F.sum("_w").over(W.partitionBy("_part").orderBy(*order).rowsBetween(*_UP)), F.lit(0).cast("long"))
    return dealt.withColumn("_b", before).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_o") + F.col("_b")).select(*rows.columns, "rank")

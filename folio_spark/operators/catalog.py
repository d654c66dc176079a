"""Catalog maintenance: upserts, diffs, eviction, range joins, rollups, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Last write of every key; ``order`` is descending and ends in a unique tiebreak."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with those of ``incoming`` put in their place; of rows of one key in ``incoming`` the last given column set must be unique."""
    return stored.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def track_changes(stored: DataFrame, seen: DataFrame, key: str, checksum: str) -> DataFrame:
    """``key, state``: new, changed, unchanged or deleted, by a full outer join on the key."""
    a, b = stored.select(key, F.col(checksum).alias("old")), seen.select(key, F.col(checksum).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def evict_oldest(df: DataFrame, order: list[str], share: float = 0.2) -> DataFrame:
    """What stays after the oldest ``share`` (one row at least) is evicted.

    Order columns have no nulls and end in a unique one.  Approximate percentiles of the first
    column bracket the boundary, rows below the bracket are counted, and only those in it are
    sorted; the rest is one filter.
    """
    first = F.col(order[0])
    around = [F.percentile_approx(first, F.lit(max(0.0, min(1.0, share + e))), F.lit(10_000)) for e in (-0.002, 0.002)]
    n, lo, hi = df.agg(F.count("*"), *around).first()
    if n == 0:
        return df
    gone = max(1, int(n * share))
    below, upto = df.agg(F.count_if(first < F.lit(lo)), F.count_if(first <= F.lit(hi))).first()
    band = df.where(first.between(F.lit(lo), F.lit(hi))) if below < gone <= upto else df
    skip = gone - 1 - (below if below < gone <= upto else 0)
    last = band.select(*order).orderBy(*order).offset(skip).limit(1).first()
    after = F.lit(False)
    for c, v in reversed(list(zip(order, last, strict=True))):
        after = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & after)
    return df.where(after)


def range_join_first(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, order: list[str], bucket: int, key: str) -> DataFrame:
    """Each point with the first span that holds it (``start <= at < stop``), by buckets of the axis instead of a theta join.

    ``order`` names columns of the spans.  Of spans with the same ends only the first can be one's first, and points of one
    place have the same, so what meets is bounded by the places there are.
    """
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    p = points.select(at).distinct().withColumn("_b", F.floor(F.col(at) / bucket))
    s = spans.withColumn("_rn", rank(start, stop)).where("_rn = 1").drop("_rn").withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(stop) - 1) / bucket))))
    hit = p.join(s, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop)))
    hit = points.join(hit.withColumn("_rn", rank(at)).where("_rn = 1").drop("_rn", "_b"), at)
    return hit.withColumn("_rn", rank(key)).where("_rn = 1").drop("_rn")


def hierarchy_rollup(df: DataFrame, levels: list[str], **measures: Column) -> DataFrame:
    """Counts and measures at every level of a hierarchy and in total; ``level`` is how many columns are given."""
    agg = df.rollup(*levels).agg(F.grouping_id().alias("_g"), *[c.alias(k) for k, c in measures.items()])
    return agg.withColumn("level", F.lit(len(levels)) - F.bit_count("_g")).drop("_g")


def quota_fill(df: DataFrame, kind: str, quotas: dict[str, int], order: list[str], total: int) -> DataFrame:
    """Rows up to each kind's quota, then the rest in order until ``total``: ``..., position``."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(kind)), F.lit(0))
    rows = df.withColumn("_over", (rank > limit).cast("int")).orderBy("_over", *order).limit(total)
    return rows.withColumn("position", F.row_number().over(Window.orderBy("_over", *order))).drop("_over")


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int) -> DataFrame:
    """One page and the total before paging."""
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def percent_of_total(counts: DataFrame, value: str) -> DataFrame:
    return counts.withColumn("percent", F.round(100.0 * F.col(value) / F.sum(value).over(Window.partitionBy()), 6))

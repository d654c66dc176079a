"""Vectors in array columns: norms, cosines, means and late interaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0, null for null vectors; widths must agree."""
    a, b = as_double(a), as_double(b)
    n = norm(a) * norm(b)
    same = F.assert_true(F.size(a) == F.size(b), "vectors differ in width")
    return F.when(a.isNull() | b.isNull(), None).when(same.isNotNull(), None).otherwise(F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0))))


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def mean_vector(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Element-wise mean by group, as ``group, mean``."""
    parts = df.select(*group, F.posexplode(as_double(F.col(vector))).alias("i", "x")).groupBy(*group, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def maxsim(query_vectors: list[list[float]], tokens: Column) -> Column:
    """Late-interaction score: for each query vector the best dot product among the document's token vectors, summed."""
    total = F.lit(0.0)
    for q in query_vectors:
        total = total + F.coalesce(F.array_max(F.transform(tokens, lambda t: dot(as_double(t), literal(q)))), F.lit(0.0))  # noqa: B023
    return total


"""Retrieval and ranking: BM25, dense search, hybrid merge, diversification, confidence."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as tx
from folio_spark.functions import vector as vx


def bm25(docs: DataFrame, query: str, k: int | None = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 scores above 0: ``id, score``; the best ``k``, ties by id (None: all).

    Query tokens count as often as they stand in the query.  Corpus statistics come from one
    narrow aggregate (document lengths and, for the query's tokens only, frequencies); no token
    is exploded.  A null text is an empty document.
    """
    wanted = Counter(t for t in _query_tokens(query))
    terms = sorted(wanted)
    base = docs.select(F.col(id_col), F.coalesce(tx.tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
    tf = [F.size(F.filter("t", _equals(term))) for term in terms]
    freq = base.select(id_col, F.size("t").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    stats = freq.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"n{i}") for i in range(len(terms))]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        df = stats[f"n{i}"] or 0
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        f = F.col(f"tf{i}")
        score = score + wanted[term] * idf * (f * (k1 + 1)) / (f + k1 * (1 - b + b * F.col("dl") / avgdl))
    out = freq.select(id_col, score.alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), id_col).limit(k)


def _equals(term: str):
    return lambda x: x == term


def _query_tokens(query: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}_]{2,}", query.lower())


def dense(vectors: DataFrame, query: list[float], k: int = 50, min_score: float | None = None, id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """Cosine top-k: ``id, score``.  Filters run on the stored columns before any vector is scored."""
    src = vectors if where is None else vectors.where(where)
    scored = src.where(F.col(vector).isNotNull()).select(id_col, vx.cosine(F.col(vector), vx.literal(query)).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def hybrid_merge(dense_hits: DataFrame, sparse_hits: DataFrame, pool: int = 50) -> DataFrame:
    """Full outer merge of ``(id, score)`` lists; missing scores 0; both lists enter the pool by their ranks."""
    d = dense_hits.select("id", F.col("score").alias("dense_score"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("dr"))
    s = sparse_hits.select("id", F.col("score").alias("sparse_score"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("sr"))
    both = d.join(s, "id", "full_outer")
    best = F.least(F.coalesce("dr", F.lit(1 << 30)), F.coalesce("sr", F.lit(1 << 30)))
    rows = both.select(
        "id",
        F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"),
        F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"),
        F.when(F.col("dr").isNull(), "sparse").when(F.col("sr").isNull(), "dense").otherwise("both").alias("origin"),
        best.alias("best"),
    )
    return rows.orderBy("best", F.desc("dense_score"), F.desc("sparse_score"), "id").limit(pool).drop("best")


def rerank(pool: DataFrame, scorer: Column, k: int = 10) -> DataFrame:
    """Reorder a pool by any score expression; where it is null the dense score decides."""
    return pool.withColumn("final_score", F.coalesce(scorer, F.col("dense_score"))).orderBy(F.desc("final_score"), "id").limit(k)


def top_per(df: DataFrame, group: str | list[str], score: str, n: int, tiebreak: str) -> DataFrame:
    """The ``n`` best rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tiebreak))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def diversify(df: DataFrame, source: str, score: str, tiebreak: str, per_source: int = 10, k: int = 50) -> DataFrame:
    """At most ``per_source`` rows of a source, then the best ``k``: what a greedy pass in score order keeps."""
    return top_per(df, source, score, per_source, tiebreak).orderBy(F.desc(score), F.asc(tiebreak)).limit(k)


def confidence(ranked: DataFrame, score: str = "score", source: str = "source", tiebreak: str = "id", reranked: bool = True, type_score: float = 0.8) -> DataFrame:
    """One row: ``.40 score + .30 diversity + .15 count + .15 type``, clamped, and its level."""
    rn = ranked.withColumn("rn", F.row_number().over(Window.orderBy(F.desc(score), tiebreak)))
    agg = rn.agg(
        F.avg(F.when(F.col("rn") <= 3, F.col(score))).alias("top3"),
        F.count_distinct(F.when(F.col("rn") <= 10, F.col(source))).alias("sources"),
        F.count("*").alias("n"),
    )
    s = F.least(F.coalesce("top3", F.lit(0.0)) / (30.0 if reranked else 1.0), F.lit(1.0))  # no result: no score
    c = 0.40 * s + 0.30 * F.least(F.col("sources") / 3.0, F.lit(1.0)) + 0.15 * F.least(F.col("n") / 10.0, F.lit(1.0)) + 0.15 * type_score
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return agg.select(F.round(c, 6).alias("confidence"), confidence_level(c).alias("level"), F.col("n").alias("n_results"), F.col("sources").alias("n_sources"))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.70, "medium").when(c >= 0.50, "low").otherwise("very_low")


def occurrence_relevance(location_score: Column, count: Column) -> Column:
    """Best location plus up to ten points for repeats."""
    return location_score + F.least(F.lit(10), 2 * (count - 1))


def chapter_relevance(base: Column, occurrences: Column, pages: Column, authority: Column, has_section: Column, authority_weight: float, section_weight: float) -> Column:
    return base + F.least(F.lit(20), 2 * occurrences) + F.least(F.lit(10), pages) + authority * authority_weight + F.when(has_section, 100 * section_weight).otherwise(0.0)

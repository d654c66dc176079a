"""Title, phrase and index-term matching; chapter ranking; ordered unions; associations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.operators.retrieval import chapter_relevance


@dataclass(frozen=True)
class Strategy:
    authority_weight: float
    section_weight: float
    max_results: int
    min_relevance: float


#: Search strategies.
STRATEGIES = {"strict": Strategy(0.0, 1.5, 30, 40), "standard": Strategy(0.5, 1.0, 50, 0), "broad": Strategy(0.3, 0.5, 100, 0)}
#: Score of a match by its place, best first.
LOCATION_SCORES = [("title", 100), ("header", 80), ("semantic", 60), ("body", 50), ("footnote", 20)]
#: Authority tiers of the demonstration catalog.
PART_AUTHORITY = [(["Brand#1", "Brand#2"], 100), (["Brand#3", "Brand#4", "Brand#5"], 80)]


def authority(source: Column, tiers: list[tuple[list[str], int]], default: int = 70) -> Column:
    out = None
    for names, score in tiers:
        out = F.when(source.isin(names), score) if out is None else out.when(source.isin(names), score)
    return out.otherwise(default)


def location_score(place: Column) -> Column:
    """Score of a location given as its number from 1 (title); further ones count as the last."""
    out = None
    for i, (_, s) in enumerate(LOCATION_SCORES[:-1], 1):
        out = F.when(place == i, s) if out is None else out.when(place == i, s)
    return out.otherwise(LOCATION_SCORES[-1][1])


def rank_chapters(chapters: DataFrame, phrase: str, strategy: Strategy, id_col: str, title: str) -> DataFrame:
    """Rank ``chapters`` (title, authority, occurrences, pages, has_section): dedicated titles, then authoritative sources."""
    dedicated = F.contains(F.col(title), F.lit(phrase))
    rows = chapters.where(dedicated | (F.col("authority") >= 80))
    kind = F.when(dedicated, "dedicated").when(F.col("authority") >= 80, "section").otherwise("reference")
    base = F.when(dedicated, 100).when(F.col("authority") >= 80, 70).otherwise(40)
    score = chapter_relevance(base, F.col("occurrences"), F.col("pages"), F.col("authority"), F.col("has_section"), strategy.authority_weight, strategy.section_weight)
    rows = rows.select(id_col, title, kind.alias("match_type"), score.cast("double").alias("relevance")).where(F.col("relevance") >= strategy.min_relevance)
    return rows.orderBy(F.desc("relevance"), id_col).limit(strategy.max_results).withColumn("relevance", F.round("relevance", 6))


def _words(text: str) -> Column:
    return F.array(*[F.lit(w) for w in text.split(" ")])


def lookup_terms(terms: DataFrame, wanted: str, k: int) -> DataFrame:
    """Index terms that share a word: the exact one first, then by authority and references."""
    rows = terms.where(F.arrays_overlap(F.split("term", " "), _words(wanted))).select("term", "refs", "authority", (F.col("term") == wanted).alias("exact"))
    return rows.orderBy(F.desc("exact"), F.desc("authority"), F.desc("refs"), "term").limit(k)


def related_terms(terms: DataFrame, wanted: str, k: int) -> DataFrame:
    shared = F.size(F.array_intersect(F.split("term", " "), _words(wanted)))
    rows = terms.where(F.col("term") != wanted).withColumn("shared", shared).where("shared > 0")
    return rows.orderBy(F.desc("shared"), F.desc("authority"), F.desc("refs"), "term").limit(k).select("term", "authority", F.col("shared").cast("long").alias("shared"))


def expand_queries(queries: DataFrame, stages: list[tuple[str, list[tuple[str, str]]]], most: int = 2, query: str = "query") -> DataFrame:
    """``query, position, expanded``: the query itself, then ``most`` variants in dictionary order."""
    variants = [F.struct(F.lit(0).alias("stage"), F.lit(0).alias("ord"), F.col(query).alias("expanded"))]
    for s, (_, pairs) in enumerate(stages, 1):
        for o, (word, other) in enumerate(pairs, 1):
            has = F.array_contains(F.split(query, " "), word)
            variants.append(F.when(has, F.struct(F.lit(s).alias("stage"), F.lit(o).alias("ord"), F.replace(F.col(query), F.lit(word), F.lit(other)).alias("expanded"))))
    kept = F.slice(F.array_compact(F.array(*variants)), 1, most + 1)
    return queries.select(query, F.posexplode(kept).alias("p", "v")).select(query, (F.col("p") + 1).cast("long").alias("position"), F.col("v.expanded").alias("expanded"))


def title_match(titles: DataFrame, phrase: str, title: str) -> DataFrame:
    """How a title matches a phrase: as a whole, by all its words, by how many of them."""
    ws = F.split(title, " ")
    hits = F.size(F.array_intersect(ws, _words(phrase)))
    return titles.withColumn("phrase", F.contains(F.col(title), F.lit(phrase))).withColumn("all_words", hits == len(set(phrase.split(" ")))).withColumn("hits", hits.cast("long")).where("hits >= 1")


def phrase_match(text: Column, phrase: str, gap: int = 30) -> Column:
    """Words of the phrase in order, at most ``gap`` characters apart on one line."""
    return text.rlike((".{0,%d}" % gap).join(re.escape(w) for w in phrase.split(" ")))


def union_first(frames: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Union of ordered lists; of rows with one key the first in ``order`` stays."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` holds."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)

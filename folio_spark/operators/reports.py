"""Reports: evaluation statistics, chapter quality, study coverage, cluster topics and statistics, conflict order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conflict types, most important first; others come last.
CONFLICT_ORDER = ["contradictory", "quantitative", "approach", "temporal", "terminology", "emphasis"]
UNKNOWN_PRIORITY = 99
#: What a chapter must reach.
MINIMUM_WORDS, MINIMUM_SOURCES = 8000, 15


def parsed_grade(feedback: Column) -> Column:
    """The number behind the first ``Grade:``, before the slash; 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(feedback, r"Grade: *([0-9]+(?:\.[0-9]+)?) */", 1), F.lit("")).cast("double"), F.lit(0.0))


def evaluation_stats(results: DataFrame, feedback: str = "feedback", answer: str = "answer", flag: str = "SAFETY WARNING") -> DataFrame:
    """One row: answers, graded ones, their mean grade (0 without any) and answers with the flag."""
    g = parsed_grade(F.col(feedback))
    return results.agg(
        F.count("*").alias("n_results"),
        F.count_if(g > 0).alias("n_graded"),
        F.round(F.coalesce(F.avg(F.when(g > 0, g)), F.lit(0.0)), 6).alias("mean_grade"),
        F.count_if(F.contains(answer, F.lit(flag))).alias("n_flagged"),
    )


def chapter_quality(sections: DataFrame, chapter: str, words: str, source: str, conflicts: str) -> DataFrame:
    """A row a chapter: sections, words, distinct sources, conflicts, words a source and whether the minima are met."""
    out = sections.groupBy(chapter).agg(F.count("*").alias("sections"), F.sum(words).cast("long").alias("total_words"), F.count_distinct(source).alias("total_sources"), F.sum(conflicts).cast("long").alias("conflicts"))
    return out.withColumns(
        {
            "words_per_source": F.round(F.col("total_words") / F.greatest(F.col("total_sources"), F.lit(1)), 6),
            "meets_minimum_words": F.col("total_words") >= MINIMUM_WORDS,
            "meets_citation_density": F.col("total_sources") >= MINIMUM_SOURCES,
        }
    )


def study_report(suggested: DataFrame, library: DataFrame, group: str, topic: str) -> DataFrame:
    """A row a study: topics suggested, found in the library and missing, the success rate (0 without topics) and whether gaps are left."""
    have = library.select(F.lower(topic).alias("_t")).distinct().withColumn("_have", F.lit(1))
    rows = suggested.select(group, F.lower(topic).alias("_t")).distinct().join(have, "_t", "left")
    out = rows.groupBy(group).agg(F.count("_t").alias("n_topics"), F.count_if(F.col("_have") == 1).alias("n_found"))
    return out.select(
        group, "n_topics", "n_found", (F.col("n_topics") - F.col("n_found")).alias("n_missing"),
        F.round(F.coalesce(F.col("n_found") / F.nullif(F.col("n_topics"), F.lit(0)), F.lit(0.0)), 6).alias("success_rate"), (F.col("n_found") < F.col("n_topics")).alias("has_gaps"),
    )


def majority_topic(members: DataFrame, cluster: str, category: str) -> DataFrame:
    """``cluster, topic, n_members``: the commonest category, the smaller one on ties; null categories don't vote."""
    n = members.groupBy(cluster, category).agg(F.count("*").alias("n"))
    votes = F.min(F.when(F.col(category).isNotNull(), F.struct((-F.col("n")).alias("c"), F.col(category).alias("topic"))))
    return n.groupBy(cluster).agg(votes.alias("v"), F.sum("n").alias("n_members")).select(cluster, F.col("v.topic").alias("topic"), "n_members")


def cluster_sizes(members: DataFrame, cluster: str, source: str) -> DataFrame:
    """``cluster, size, n_sources, dedup_ratio``: members, distinct sources and members a source."""
    out = members.groupBy(cluster).agg(F.count("*").alias("size"), F.count_distinct(source).alias("n_sources"))
    return out.withColumn("dedup_ratio", F.round(F.col("size") / F.greatest(F.col("n_sources"), F.lit(1)), 6))


def size_summary(sizes: DataFrame, size: str = "size") -> DataFrame:
    """One row: clusters, singletons, mean, deviation and exact median of the sizes."""
    return sizes.agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col(size) == 1).alias("n_singletons"), F.round(F.avg(size), 6).alias("mean_size"), F.round(F.stddev_pop(size), 6).alias("std_size"), F.percentile(size, 0.5).alias("median_size")
    )


def conflict_priority(kind: Column) -> Column:
    """Place of a conflict's type in the order of importance, from 0; 99 for others."""
    place = F.array_position(F.array(*[F.lit(x) for x in CONFLICT_ORDER]), F.lower(kind))
    return F.when(place > 0, place - 1).otherwise(UNKNOWN_PRIORITY).cast("long")


def extent(df: DataFrame, at: str, names: str) -> DataFrame:
    """One row: first and last time, and the distinct names in order."""
    return df.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.array_join(F.array_sort(F.collect_set(names)), ",").alias("names"))

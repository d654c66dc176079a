"""Small rules over single rows: intents, locations, scores, labels, citation strings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import text as tx


def hybrid_intent(lean: DataFrame, cache: DataFrame, threshold: float = 0.8, key: str = "query") -> DataFrame:
    """The rule's intent where it is sure, else a model's cached one, else the rule's: ``..., intent, confidence, source``."""
    c = cache.select(key, F.col("intent").alias("_ai"), F.col("confidence").alias("_conf"))
    sure = (F.col("confidence") >= threshold) | F.col("_ai").isNull()
    out = lean.join(c, key, "left")
    return out.select(
        *[k for k in lean.columns if k not in ("intent", "confidence")],
        F.when(sure, F.col("intent")).otherwise(F.col("_ai")).alias("intent"),
        F.when(sure, F.col("confidence")).otherwise(F.col("_conf")).alias("confidence"),
        F.when(sure, "rules").otherwise("cache").alias("source"),
    )


def analyze_queries(queries: DataFrame, taxonomy: DataFrame, query: str = "query") -> DataFrame:
    """``query, region, subregion, domain, categories, confidence`` from ``taxonomy(kind, name, term)``.

    The name of most terms found wins, the smaller name on ties.  Confidence: .4 for a region, .1 for
    more than one of its terms, .2 subregion, .15 domain, .05 a category up to .15.  Terms are
    found anywhere in a query; they meet by an equi-join on their first three characters, so no
    query is tried against the whole taxonomy.
    """
    low, heads = F.lower(query), F.substring(F.lower("term"), 1, 3)
    grams = F.flatten(F.array(*[F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), _gram(low, n))).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
    asked = queries.select(query).distinct().withColumn("_g", F.explode(F.array_distinct(grams)))
    hits = asked.join(taxonomy.withColumn("_g", heads), "_g").where(F.contains(low, F.lower("term")))
    n = hits.groupBy(query, "kind", "name").agg(F.count("*").alias("n"))
    best = n.groupBy(query, "kind").agg(F.min(F.struct((-F.col("n")).alias("c"), "name")).alias("b"), F.array_sort(F.collect_list("name")).alias("names"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = best.groupBy(query).agg(
        pick("region", "b.name").alias("region"), (-pick("region", "b.c")).alias("hits"), pick("subregion", "b.name").alias("subregion"), pick("domain", "b.name").alias("domain"), pick("category", "names").alias("categories")
    )
    cats = F.coalesce(F.size("categories"), F.lit(0))
    conf = (
        F.when(F.col("region").isNotNull(), 0.4).otherwise(0.0)
        + F.when(F.col("hits") > 1, 0.1).otherwise(0.0)
        + F.when(F.col("subregion").isNotNull(), 0.2).otherwise(0.0)
        + F.when(F.col("domain").isNotNull(), 0.15).otherwise(0.0)
        + F.least(F.lit(0.15), 0.05 * F.greatest(cats, F.lit(0)))
    )
    return queries.join(wide, query, "left").select(*queries.columns, "region", "subregion", "domain", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.round(F.coalesce(conf, F.lit(0.0)), 6).alias("confidence"))


def _gram(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def match_location(text: Column, offset: Column, first_page: Column, footnote: str, header: str) -> Column:
    """Footnote, header, title (first page, among the first 200 characters) or body, from the line that holds ``offset`` (from 0)."""
    before = F.substring(text, F.lit(1), offset)
    start = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    line = F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1)
    return F.when(line.rlike(footnote), "footnote").when(line.rlike(header), "header").when(first_page & (offset < 200), "title").otherwise("body")


def key_concepts(text: Column, terms: list[str], n: int = 5) -> Column:
    """The dictionary's terms by number of occurrences, then name."""
    found = F.array(*[F.struct((-tx.occurrences(F.lower(text), t)).alias("c"), F.lit(t).alias("term")) for t in terms])
    return F.transform(F.slice(F.array_sort(F.filter(found, lambda x: x["c"] < 0)), 1, n), lambda x: x["term"])


def annotate(patterns: dict[str, str]) -> Callable[[Column], Column]:
    """Puts ``[label]`` behind every match; places depend on the text, so a Pandas function splices them."""
    import re

    compiled = [(label, re.compile(p, re.I)) for label, p in patterns.items()]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            marks = sorted({(m.end(), label) for label, p in compiled for m in p.finditer(t)}, reverse=True)
            for end, label in marks:
                t = f"{t[:end]} [{label}]{t[end:]}"
            return t

        return texts.map(one)

    return run


def cue_score(context: Column) -> Column:
    """Figure references .4, demonstratives .2, a direct reference .4."""
    low = F.lower(context)
    return (
        F.when(low.rlike(r"fig(ure|\.)? *[0-9]+"), 0.4).otherwise(0.0)
        + F.when(low.rlike(r"(this|these|the following|above|below) +(image|figure|photograph|diagram)"), 0.2).otherwise(0.0)
        + F.when(low.rlike(r"(as shown|see|illustrated|depicted) +(in|by) +fig"), 0.4).otherwise(0.0)
    )


def procedural_score(text: Column, strong: list[str], medium: list[str], weak: list[str]) -> Column:
    """.3 for each strong, .2 medium, .1 weak term (those .3 together at most), 1 at most."""
    low = F.lower(text)
    return F.least(F.lit(1.0), 0.3 * tx.presence(low, strong) + 0.2 * tx.presence(low, medium) + F.least(F.lit(0.3), 0.1 * tx.presence(low, weak)))


def caption_parts(text: Column) -> Column:
    """``struct<is_caption, figure_id, subfigures, references>`` of a text block."""
    head = r"(?i)^ *(fig(?:ure)?|table|plate)\.? *([0-9]+(?:[.-][0-9]+)*)"
    fid = F.regexp_extract(text, head, 2)
    return F.struct(
        text.rlike(head).alias("is_caption"),
        F.when(fid != "", fid).alias("figure_id"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\(([A-Ha-h])\)"), 1), F.upper)).alias("subfigures"),
        F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, head, ""), F.lit(r"(?i)fig(?:ure)?s?\.? *([0-9]+(?:[.-][0-9]+)*)"), 1)).alias("references"),
    )


def density_template(share: Column) -> Column:
    return F.when(share >= 0.7, "procedural").when(share <= 0.3, "theoretical").otherwise("mixed")


def word_target(clusters: Column, base: int = 300, each: int = 150, least: int = 400, most: int = 2500) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), base + each * clusters))


def normalize_category(df: DataFrame, dimension: DataFrame, category: str = "category", default: str = "Other") -> DataFrame:
    """Categories of the dimension ``(category, group)`` keep their group; unknown ones become the default without one."""
    return df.join(dimension.withColumnRenamed("group", "_group"), category, "left").select(
        *[c for c in df.columns if c not in (category, "group")], F.when(F.col("_group").isNull(), default).otherwise(F.col(category)).alias(category), F.col("_group").alias("group")
    )


def citation(authors: Column, year: Column, title: Column, page: Column) -> Column:
    """``Last et al. (year), title, p. n``; missing parts are left out."""
    last = F.element_at(F.split(F.get(authors, 0), " "), -1)
    who = F.when(F.size(authors) > 1, F.concat(last, F.lit(" et al."))).otherwise(last)
    return F.concat_ws(", ", F.concat_ws(" ", who, F.concat(F.lit("("), year.cast("string"), F.lit(")"))), title, F.concat(F.lit("p. "), page.cast("string")))


def within(root: str, path: Column) -> Column:
    """Whether a path stays below the root, after ``..`` steps are refused."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)")


def first_valid(*attempts: Column) -> Column:
    """Result of the first attempt that is not null: fallbacks as columns."""
    return F.coalesce(*attempts)


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of the bytes, in bits."""

    @F.pandas_udf("double")
    def run(blobs: pd.Series) -> pd.Series:
        import numpy as np

        def one(b) -> float | None:
            if b is None:
                return None
            p = np.bincount(np.frombuffer(b, np.uint8), minlength=256) / max(1, len(b))
            p = p[p > 0]
            return float(-(p * np.log2(p)).sum()) + 0.0

        return blobs.map(one)

    return run(content)


def model_hook(reply: Callable[[str], str] | None = None) -> Callable[[Column], Column]:
    """A text model as a column function: prompts in, replies out.  Without one, an extract: the first two sentences."""
    import re

    def extract(prompt: str) -> str:
        return " ".join(re.split(r"(?<=[.!?])\s+", prompt.strip())[:2])

    f = reply or extract

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else f(p))

    return run


def relevance_gate(df: DataFrame, key: str, score: str, least: int = 7, fallback: int = 3, tiebreak: str = "id") -> DataFrame:
    """Rows graded ``least`` or more; where a key has none, its best three."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    rows = df.withColumn("_any", F.max((F.col(score) >= least).cast("int")).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc(score), tiebreak)))
    return rows.where(F.when(F.col("_any") == 1, F.col(score) >= least).otherwise(F.col("_rn") <= fallback)).drop("_any", "_rn")

"""Library search: occurrences with variants, dictionary expansion, keyword / semantic / hybrid dispatch, section and image selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions.graph import cut
from folio_spark.functions import text as tx
from folio_spark.functions import neighbours as nb
from folio_spark.operators.retrieval import dense, occurrence_relevance

#: Relevance of a semantic hit, what a title match adds, and the score of a keyword match in title and body.
SEMANTIC, TITLE_BONUS, TITLE, BODY = 60, 30, 100, 50
#: Words that flag safety content.
SAFETY = ["contraindication", "warning", "caution", "risk", "complication", "avoid", "never", "do not", "fatal", "dangerous"]
#: Preferred image types by words of a section's name, first match first; the last entry is the default.
IMAGE_TYPES = [
    (["anatomy"], ["anatomy_diagram", "illustration"]),
    (["technique", "operative"], ["surgical_photo", "anatomy_diagram"]),
    (["imaging", "diagnosis"], ["imaging_mri", "imaging_ct", "imaging_angio"]),
    (["complication"], ["surgical_photo", "imaging_ct"]),
    ([], ["illustration", "diagram"]),
]


def positions(text: Column, term: str) -> Column:
    """Starts, from 0, of the non-overlapping occurrences of a literal, whatever its case."""
    parts = F.transform(F.split(F.lower(text), re.escape(term.lower()), -1), F.length)
    n = F.size(parts) - 1
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(term))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def context(text: Column, at: Column, length: Column, window: int = 500) -> Column:
    """Text ``window`` characters around a match, white space collapsed, with ellipses where it was cut."""
    start, stop = F.greatest(at - window, F.lit(0)), F.least(at + length + window, F.length(text))
    body = tx.collapse(F.substring(text, start + 1, stop - start))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(stop < F.length(text), "...").otherwise(""))


def occurrences_all(docs: DataFrame, variants: list[str], window: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, position, variant, context``: every start once, with the first of the ``variants`` that matches there.

    Matching ignores case; null texts have no occurrences.
    """
    found = F.flatten(F.array(*[_placed(F.col(text_col), v, k) for k, v in enumerate(variants)]))
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col, found.alias("f"))
    # The first variant of each start: sorted by start and variant, an entry stays if the one before it starts elsewhere.
    first = F.filter(F.col("s"), lambda x, i: F.coalesce(F.get("s", i - 1)["p"] != x["p"], F.lit(True)))
    rows = rows.where(F.size("f") > 0).select(id_col, text_col, F.array_sort("f").alias("s")).select(id_col, text_col, F.explode(first).alias("o"))
    names = F.array(*[F.lit(v) for v in variants])
    out = rows.select(id_col, text_col, F.col("o.p").alias("position"), F.get(names, F.col("o.k")).alias("variant"))
    return out.select(id_col, F.col("position").cast("long").alias("position"), "variant", context(F.col(text_col), F.col("position"), F.length("variant"), window).alias("context"))


def _placed(text: Column, variant: str, number: int) -> Column:
    return F.transform(positions(text, variant), lambda p: F.struct(p.alias("p"), F.lit(number).alias("k")))


def merge_terms(matches: DataFrame, key: str = "page", order: str = "ord") -> DataFrame:
    """``key, match_count, locations, data`` of pages found by several terms: counts add up, locations follow in the terms' order, the first term's data stays."""
    return matches.groupBy(key).agg(
        F.sum("match_count").alias("match_count"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "locations"))), lambda x: x["locations"])).alias("locations"),
        F.min_by("data", order).alias("data"),
    )


def expand_by_dictionary(queries: DataFrame, dictionary: DataFrame, most: int = 5, longest: int | None = None, query: str = "query") -> DataFrame:
    """``query, position, expanded``: the query, then up to ``most`` variants from ``dictionary(stage, ord, term, variant)``.

    A term matches as whole words, case ignored, wherever it stands; each variant replaces all its
    places.  Variants come by stage, order and variant; equal ones and the query itself count once.
    Queries give runs of up to ``longest`` words (the longest term's, if not given), which meet the
    terms by an equi-join: no query is tried against the whole dictionary.
    """
    if longest is None:
        longest = dictionary.select(F.max(F.size(F.split(F.trim("term"), " +")))).first()[0] or 1
    clean = F.array_join(F.filter(F.split(F.lower(query), " "), lambda w: w != ""), " ")
    words = F.split("_q", " ")
    runs = F.flatten(F.array(*[F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), _run(words, n))).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]))
    base = queries.select(query).distinct().withColumn("_q", clean)
    terms = dictionary.select("stage", "ord", F.lower("term").alias("_t"), F.lower("variant").alias("_v"))
    hits = base.withColumn("_t", F.explode(F.array_distinct(runs))).join(terms, "_t")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    once = lambda c: F.replace(c, padded(F.col("_t")), padded(F.col("_v")))
    hits = hits.withColumn("expanded", F.trim(once(once(padded(F.col("_q"))))))  # twice: neighbours share a blank
    variants = hits.where(F.col("expanded") != F.col("_q")).groupBy(query, "expanded").agg(F.min(F.struct("stage", "ord", "_v")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("at.stage", "at.ord", "at._v", "expanded"))
    kept = variants.withColumn("position", rank + 1).where(F.col("position") <= most + 1).select(query, F.col("position").cast("long").alias("position"), "expanded")
    return base.select(query, F.lit(1).cast("long").alias("position"), F.col(query).alias("expanded")).unionByName(kept)


def _run(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def keyword_pages(pages: DataFrame, term: str, key: str, title: str, text: str) -> DataFrame:
    """``key, relevance, matches`` of the pages that hold the term: best location, then repeats."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    in_title = F.contains(F.lower(title), F.lit(term.lower()))
    rows = pages.select(key, in_title.alias("_t"), tx.occurrences(low, term.lower()).alias("matches")).where("matches > 0")
    place = F.when(F.col("_t"), TITLE).otherwise(BODY)
    return rows.select(key, occurrence_relevance(place, F.col("matches")).cast("double").alias("relevance"), "matches")


def search_library(pages: DataFrame, term: str, semantic: DataFrame | None = None, mode: str = "hybrid", key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """``key, origin, relevance, matches`` of a library search.

    ``semantic``: ranked hits ``(key, score)``, a few by their top-k.  ``keyword`` searches the
    pages for the term, ``semantic`` takes the hits, ``hybrid`` the hits and then the pages they
    have not named.  A page comes once; callers order by relevance and key.
    """
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "keyword" and semantic is None:
        raise ValueError("semantic hits are needed")
    keyword = keyword_pages(pages, term, key, title, text).withColumn("origin", F.lit("keyword"))
    if mode == "keyword":
        return keyword.select(key, "origin", "relevance", "matches")
    hits = semantic.select(key).distinct()
    in_title = F.contains(F.lower(title), F.lit(term.lower()))
    found = pages.select(key, title).join(hits, key).select(key, F.lit("semantic").alias("origin"), (F.lit(SEMANTIC) + F.when(in_title, TITLE_BONUS).otherwise(0)).cast("double").alias("relevance"), F.lit(1).cast("long").alias("matches"))
    if mode == "semantic":
        return found
    return found.unionByName(keyword.join(hits, key, "left_anti").select(key, "origin", "relevance", "matches"))


def prefix_matches(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column starts with the prefix taken literally; a pushed filter."""
    return df.where(F.startswith(column, F.lit(prefix)))


def payload_overlap(df: DataFrame, query: str, k: int, id_col: str, caption: str) -> DataFrame:
    """``id, score``: share of the query's words in a caption, best ``k``."""
    wanted = sorted(set(query.lower().split()))
    words = F.split(F.lower(F.coalesce(F.col(caption), F.lit(""))), r"[ \t\n\r\x0b\x0c]+")
    score = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted]))) / F.lit(float(max(1, len(wanted))))
    return df.select(id_col, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def visual_duplicates(df: DataFrame, threshold: float = 0.95, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``a, b, sim``: unordered pairs of which one is among the other's ``k`` nearest, itself counted, at the threshold or above."""
    near = nb.knn_join(df, k - 1, id_col, vector).where(F.col("sim") >= threshold)
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def similar_clusters(members: DataFrame, query: list[float], k: int = 5, cluster: str = "cluster_id", order: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``cluster, score`` of the clusters whose first member is nearest."""
    first = members.where(F.col(vector).isNotNull()).groupBy(cluster).agg(F.min_by(vector, order).alias(vector))
    return dense(first, query, k, id_col=cluster, vector=vector)


def nearby_text(images: DataFrame, texts: DataFrame, page: str, image_id: str, text_id: str, reach: float = 500.0, least: float = 0.3, n: int = 5) -> DataFrame:
    """``image, text, score``: the ``n`` nearest texts of an image on its page.

    Both sides hold the page and centres ``x, y``.  The score falls from 1 to 0 with the distance
    over ``reach``.  An equi-join on the page, of places instead of rows: whatever stands at one place has one score, so
    a place gives its first ``n`` texts, and images of one place share their nearest.
    """
    first = F.row_number().over(Window.partitionBy(page, "x", "y").orderBy(text_id))
    b = texts.select(page, text_id, "x", "y").withColumn("_rn", first).where(F.col("_rn") <= n)
    b = b.groupBy(page, "x", "y").agg(F.array_sort(F.collect_list(text_id)).alias("_texts"))
    a = images.select(page, image_id, F.col("x").alias("_x"), F.col("y").alias("_y"))
    left, place, done = a.select(page, "_x", "_y").distinct(), Window.partitionBy(page, "_x", "_y"), None
    score = F.greatest(F.lit(0.0), 1 - F.sqrt((F.col("_x") - F.col("x")) ** 2 + (F.col("_y") - F.col("y")) ** 2) / reach)
    # On crowded pages the n best lie in the cells around a place: it has them when the last scores more than anything
    # beyond those cells can.  Other places go on to larger cells, and at last to the whole page.
    for cell in (reach / 16, reach / 8, reach / 4, None):
        if cell is None:
            near = left.join(b, page)
        else:
            at = lambda c: F.floor(F.col(c) / cell)
            around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))
            near = left.withColumn("_cx", around("_x")).withColumn("_cy", around("_y")).join(b.withColumn("_cx", at("x")).withColumn("_cy", at("y")), [page, "_cx", "_cy"])
        near = near.select(page, "_x", "_y", "_texts", F.round(score, 9).alias("score")).where(F.col("score") >= least)
        # Of a place beyond the n best by score and first text no text is among the n best.
        near = near.withColumn("_rn", F.row_number().over(place.orderBy(F.desc("score"), F.col("_texts")[0]))).where(F.col("_rn") <= n)
        if cell is not None:
            near = cut(near)
            sure = near.where((F.col("_rn") == n) & (F.col("score") > round(1 - cell / reach, 9))).select(page, "_x", "_y")
            near, left = near.join(sure, [page, "_x", "_y"], "left_semi"), cut(left.join(sure, [page, "_x", "_y"], "left_anti"))
        done = near if done is None else done.unionByName(near)
    near = done
    near = near.select(page, "_x", "_y", "score", F.explode("_texts").alias(text_id))
    near = near.withColumn("_rn", F.row_number().over(place.orderBy(F.desc("score"), text_id))).where(F.col("_rn") <= n)
    rows = a.join(near, [page, "_x", "_y"]).select(image_id, text_id, "score")
    rank = F.row_number().over(Window.partitionBy(image_id).orderBy(F.desc("score"), text_id))
    return rows.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def chunks_for_sections(chunks: DataFrame, sections: list[tuple[str, list[str]]], n: int = 15, fallback: int = 10, id_col: str = "id", kind: str = "kind", title: str = "title", text: str = "text", score: str = "score") -> DataFrame:
    """``section, id, position``: a retrieved pool's chunks for each section of a template.

    Chunks of the section's types if there are any; else those that hold words of its name (1 in
    the text, 2 in the title), by that score; else the first ``fallback`` of the pool.  At most ``n``.
    """
    low, head = F.lower(text), F.lower(title)

    def row(name: str, types: list[str]) -> Column:
        words = name.lower().split()
        points = sum((F.contains(low, F.lit(w)).cast("int") + 2 * F.contains(head, F.lit(w)).cast("int") for w in words), F.lit(0))
        typed = F.col(kind).isin(types) if types else F.lit(False)
        return F.struct(F.lit(name).alias("section"), F.coalesce(typed, F.lit(False)).alias("typed"), F.coalesce(points, F.lit(0)).alias("points"))

    rows = chunks.select(id_col, score, F.explode(F.array(*[row(*s) for s in sections])).alias("s")).select(id_col, score, "s.*")
    whole = Window.partitionBy("section")
    any_typed, any_points = F.max(F.col("typed").cast("int")).over(whole) == 1, F.max("points").over(whole) > 0
    rows = rows.withColumn("_way", F.when(any_typed, 1).when(any_points, 2).otherwise(3))
    rows = rows.where((F.col("_way") == 3) | ((F.col("_way") == 1) & F.col("typed")) | ((F.col("_way") == 2) & (F.col("points") > 0)))
    rows = rows.withColumn("_p", F.when(F.col("_way") == 2, F.col("points")).otherwise(0))
    rank = F.row_number().over(whole.orderBy(F.desc("_p"), F.desc(score), id_col))
    return rows.withColumn("position", rank.cast("long")).where(F.col("position") <= F.when(F.col("_way") == 3, fallback).otherwise(n)).select("section", id_col, "position")


def safety_flag(text: Column) -> Column:
    """Whether a text holds one of the safety words as whole words."""
    return F.coalesce(F.lower(text).rlike("(^|[^a-z0-9_])(" + "|".join(SAFETY) + ")($|[^a-z0-9_])"), F.lit(False))


def preferred_image_types(section: Column) -> Column:
    low, out = F.lower(section), None
    for words, types in IMAGE_TYPES[:-1]:
        cond = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        value = F.array(*[F.lit(t) for t in types])
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.array(*[F.lit(t) for t in IMAGE_TYPES[-1][1]]))


def allowed_in(group: Column, allowed: Column) -> Column:
    """Category restriction of a section: no restriction or no group lets everything in."""
    return allowed.isNull() | group.isNull() | F.array_contains(allowed, group)


def page_bucket(page: Column, size: int = 5) -> Column:
    return F.floor(page / size).cast("long")


def keep_images(kind: Column, width: Column, height: Column, unwanted: list[str], least: int = 100) -> Column:
    """Images stay unless their type is unwanted or both sides are smaller than ``least``."""
    return ~F.coalesce(kind.isin(unwanted), F.lit(False)) & ~F.coalesce((width < least) & (height < least), F.lit(False))

"""Figures: classification from features, validity, duplicates, selection, captions, association with clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as tx
from folio_spark.functions import vector as vx

#: Order in which image types are shown.
TYPE_PRIORITY = {"surgical_step": 100, "anatomical": 80, "imaging": 60, "table": 40, "flowchart": 30, "unknown": 10}


def type_priority(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv]), kind), F.lit(0))


def image_type(text: Column, keywords: dict[str, list[str]]) -> Column:
    """``struct<kind, confidence>`` by keyword presence: ``min(1, .3 + .35 ln(n + 1))``; none found: unknown, .3."""
    low = F.lower(text)
    n = {k: tx.presence(low, v) for k, v in keywords.items()}
    top = F.greatest(*n.values(), F.lit(0))
    kind = F.when(top == 0, "unknown")
    for k, c in n.items():
        kind = kind.when(c == top, k)
    return F.struct(kind.alias("kind"), F.least(F.lit(1.0), 0.3 + 0.35 * F.log(top + 1.0)).alias("confidence"))


def pixel_features(pixels: Column) -> Column:
    """``struct<grayscale, dynamic_range, colors, edges>`` of an RGB image given as ``array<array<array<int>>>``."""

    @F.pandas_udf("struct<grayscale:double,dynamic_range:double,colors:int,edges:double>")
    def run(images: pd.Series) -> pd.DataFrame:
        out = []
        for im in images:
            if im is None or len(im) == 0:
                out.append((None, None, None, None))
                continue
            a = np.array([[list(p) for p in row] for row in im], float)
            spread, gray = a.max(2) - a.min(2), a.mean(2)
            edges = (np.abs(np.diff(gray, axis=1)) > 30).sum() + (np.abs(np.diff(gray, axis=0)) > 30).sum()
            out.append((float((spread < 10).mean()), float((np.percentile(gray, 95) - np.percentile(gray, 5)) / 255), int(len(np.unique((a // 32).reshape(-1, 3), axis=0))), float(edges / gray.size)))
        return pd.DataFrame(out, columns=["grayscale", "dynamic_range", "colors", "edges"])

    return run(pixels)


def medical_class(grayscale: Column, dynamic_range: Column, colors: Column, edges: Column) -> Column:
    """Radiology, operative photograph, diagram or other, from the features."""
    return (
        F.when((grayscale > 0.9) & (dynamic_range > 0.4), "radiology")
        .when((colors > 40) & (grayscale < 0.5), "photograph")
        .when((colors <= 16) & (edges > 0.02), "diagram")
        .otherwise("other")
    )


def graphic_type(text: Column, arrows: Column, keywords: dict[str, list[str]]) -> Column:
    """Vector graphic: a flow chart needs arrows; other kinds need a keyword."""
    low = F.lower(text)
    flow = F.when(arrows & (tx.presence(low, keywords.get("flowchart", [])) > 0), "flowchart")
    for k, v in keywords.items():
        if k != "flowchart":
            flow = flow.when(tx.presence(low, v) > 0, k)
    return flow.when(arrows, "annotated").otherwise("drawing")


def unique_images(images: DataFrame, keys: list[str], order: str = "image_id") -> DataFrame:
    """One image a key, by each key in turn (reference, then content hash, then perceptual hash); a null key never matches."""
    out = images
    for k in keys:
        rn = F.row_number().over(Window.partitionBy(k).orderBy(order))
        named = out.where(F.col(k).isNotNull()).withColumn("_rn", rn).where("_rn = 1").drop("_rn")
        out = named.unionByName(out.where(F.col(k).isNull()))  # apart, or one task would sort all rows without the key
    return out


def select_images(images: DataFrame, k: int, similar: float = 0.95, group: str = "section") -> DataFrame:
    """The best images of each section that are not alike: same source within a page, or cosine above ``similar``.

    Greedy in score order, so a function walks each section: ``group, image_id, rank``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "image_id"], ascending=[False, True], kind="stable")
        kept: list = []
        for r in pdf.itertuples():
            v = np.array(r.embedding, float) if r.embedding is not None else None
            for o, ov in kept:
                if o.source == r.source and abs(o.page - r.page) <= 1:
                    break
                if v is not None and ov is not None and v @ ov > similar * np.linalg.norm(v) * np.linalg.norm(ov):
                    break
            else:
                kept.append((r, v))
                if len(kept) == k:
                    break
        return pd.DataFrame({group: [getattr(r, group) for r, _ in kept], "image_id": [r.image_id for r, _ in kept], "rank": range(1, len(kept) + 1)})

    return images.groupBy(group).applyInPandas(run, f"{group} string, image_id string, rank int")


def section_image_score(type_fits: Column, caption: Column, section: Column, image: Column, topic: Column) -> Column:
    """.3 type + .3 caption overlap + .4 cosine; a missing vector counts 0."""
    a, b = F.array_distinct(tx.tokens(caption)), F.array_distinct(tx.tokens(section))
    overlap = F.when(F.size(b) <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))
    return F.when(type_fits, 0.3).otherwise(0.0) + 0.3 * F.coalesce(overlap, F.lit(0.0)) + 0.4 * F.coalesce(vx.cosine(image, topic), F.lit(0.0))


def caption_score(distance: Column, reach: float, align: Column, has_id: Column, italic: Column) -> Column:
    """.4 nearness + .3 alignment + .2 figure id + .1 italics."""
    near = F.greatest(F.lit(0.0), 1 - distance / reach)
    return 0.4 * near + 0.3 * align + F.when(has_id, 0.2).otherwise(0.0) + F.when(italic, 0.1).otherwise(0.0)


def inline_or_plate(images: DataFrame, cluster: str, inline: int = 3) -> DataFrame:
    """Rank images of a cluster by type, confidence and relevance; the first few stand inline, the rest on plates."""
    w = Window.partitionBy(cluster).orderBy(F.desc(type_priority(F.col("kind"))), F.desc("confidence"), F.desc("relevance"), "image_id")
    return images.withColumn("rank", F.row_number().over(w)).withColumn("placement", F.when(F.col("rank") <= inline, "inline").otherwise("plate"))


def visual_clusters(visuals: DataFrame, chunks: DataFrame, least: float = 0.3) -> DataFrame:
    """``image_id, cluster_id, score``: attached 1.0, same source and a page apart at most .9, same source .7, else token Jaccard.

    ``visuals``: image_id, source_id, page, chunk_id, text; ``chunks``: chunk_id, cluster_id, source_id, page, content.
    Pairs come from equi joins: the chunk, the source, or a shared longer word.
    """
    c = chunks.select("cluster_id", F.col("chunk_id").alias("c_chunk"), F.col("source_id").alias("c_source"), F.col("page").alias("c_page"))
    attached = visuals.join(c, F.col("chunk_id") == F.col("c_chunk")).select("image_id", "cluster_id", F.lit(1.0).alias("score"))
    same = visuals.join(c, F.col("source_id") == F.col("c_source")).select("image_id", "cluster_id", F.when(F.abs(F.col("page") - F.col("c_page")) <= 1, 0.9).otherwise(0.7).alias("score"))
    long_words = lambda t: F.filter(F.array_distinct(tx.tokens(t)), lambda w: F.length(w) > 3)
    v = visuals.select("image_id", F.size(long_words(F.col("text"))).alias("nv"), F.explode(long_words(F.col("text"))).alias("w"))
    by = chunks.groupBy("cluster_id").agg(F.array_distinct(F.flatten(F.collect_list(long_words(F.col("content"))))).alias("ws"))
    k = by.select("cluster_id", F.size("ws").alias("nc"), F.explode("ws").alias("w"))
    shared = v.join(k, "w").groupBy("image_id", "cluster_id", "nv", "nc").agg(F.count("*").alias("n"))
    words = shared.select("image_id", "cluster_id", (F.col("n") / (F.col("nv") + F.col("nc") - F.col("n"))).alias("score"))
    return attached.unionByName(same).unionByName(words).groupBy("image_id", "cluster_id").agg(F.max("score").alias("score")).where(F.col("score") >= least)


def xref_lookup(blocks: DataFrame, figures: DataFrame, refs: str = "references") -> DataFrame:
    """Text blocks that refer to each figure: ``figure_id, image_id, block_ids``."""
    r = blocks.select("block_id", F.explode(refs).alias("figure_id"))
    return figures.join(r, "figure_id").groupBy("figure_id", "image_id").agg(F.array_sort(F.collect_set("block_id")).alias("block_ids"))


def validate_sequences(seqs: DataFrame) -> DataFrame:
    """Findings for each sequence of ``seq_id, step, page``: gaps, repeats, and pages that go back."""
    w = Window.partitionBy("seq_id").orderBy("step", "page")
    rows = seqs.withColumn("ds", F.col("step") - F.lag("step").over(w)).withColumn("dp", F.col("page") - F.lag("page").over(w))
    return rows.groupBy("seq_id").agg(
        F.count_if(F.col("ds") > 1).alias("gaps"), F.count_if(F.col("ds") == 0).alias("repeats"), F.count_if(F.col("dp") < 0).alias("backwards"), F.count("*").alias("length")
    ).withColumn("valid", (F.col("gaps") == 0) & (F.col("repeats") == 0) & (F.col("backwards") == 0))

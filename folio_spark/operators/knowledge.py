"""Graph ingest, outlines, perspectives, document writers and composed retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as tx
from folio_spark.functions import vector as vx
from folio_spark.operators import retrieval as rt

#: Edge types a graph may hold; others become the last one.
EDGE_TYPES = ["CAUSES", "TREATS", "PART_OF", "PRECEDES", "RELATED_TO"]


def ingest_graph(triples: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``triples(chunk_id, subject, relation, object)``.

    Nodes are distinct by lower-cased name; an edge stays only if both its nodes are known
    (default: all named ones); unknown relations become RELATED_TO.
    """
    name = lambda c: F.lower(F.trim(c))
    t = triples.select("chunk_id", name("subject").alias("src"), F.upper("relation").alias("rel"), name("object").alias("dst"))
    nodes = t.select(F.col("src").alias("node")).union(t.select("dst")).where("node IS NOT NULL AND node <> ''").distinct()
    if known is not None:
        nodes = nodes.join(known.select(name("node").alias("node")), "node", "left_semi")
    rel = F.when(F.col("rel").isin(EDGE_TYPES), F.col("rel")).otherwise(EDGE_TYPES[-1])
    edges = t.select("src", rel.alias("rel"), "dst").distinct()
    edges = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes, edges.select("src", "rel", "dst")


def mentions(triples: DataFrame) -> DataFrame:
    name = lambda c: F.lower(F.trim(c))
    return triples.select("chunk_id", F.explode(F.array(name("subject"), name("object"))).alias("node")).where("node IS NOT NULL AND node <> ''").distinct()


def assign_sections(clusters: DataFrame, outline: DataFrame, text: str = "text", key: str = "cluster_id") -> DataFrame:
    """The section of most keywords for each cluster: a topic hint wins, none found goes to the first section.

    ``outline(ord, section, keywords array)`` is small; ties go to the earlier section; an empty outline has none to give.
    """
    rows = outline.orderBy("ord").collect()  # an outline has tens of entries
    if not rows:
        return clusters.select(key, F.lit(None).cast("string").alias("section"))
    best = F.lit(0)
    scores = [tx.presence(F.lower(F.col(text)), list(r.keywords or [])) for r in rows]
    for s in scores:
        best = F.greatest(best, s)
    pick = F.when(best == 0, rows[0].section)
    for r, s in zip(rows, scores, strict=True):
        pick = pick.when(s == best, r.section)
    hinted = F.col("topic_hint") if "topic_hint" in clusters.columns else F.lit(None).cast("string")
    known = hinted.isin([r.section for r in rows])
    return clusters.select(key, F.when(known, hinted).otherwise(pick).alias("section"))


def complete_outline(outline: DataFrame, required: DataFrame, used: DataFrame) -> DataFrame:
    """Outline with missing required sections put in and unused optional ones taken out, numbered anew."""
    have = outline.select("section", F.col("ord").cast("double").alias("ord"), F.lit(False).alias("must"))
    need = required.select("section", F.col("ord").cast("double").alias("ord"), F.lit(True).alias("must"))
    both = have.unionByName(need).groupBy("section").agg(F.min("ord").alias("ord"), F.max("must").alias("must"))
    kept = both.join(used.select("section", F.lit(True).alias("used")).distinct(), "section", "left").where("must OR used")
    return kept.select(F.row_number().over(Window.orderBy("ord", "section")).alias("ord"), "section", "must")


def match_perspectives(perspectives: DataFrame, chunks: DataFrame) -> DataFrame:
    """First chunk (by id) of a perspective's cluster whose source key contains its source, case aside."""
    j = perspectives.join(chunks, "cluster_id").where(F.contains(F.lower("source_key"), F.lower("source")))
    rn = F.row_number().over(Window.partitionBy("perspective_id").orderBy("chunk_id"))
    return j.withColumn("_rn", rn).where("_rn = 1").select("perspective_id", "chunk_id")


def conflict_summary(conflicts: DataFrame, high: list[str]) -> DataFrame:
    return conflicts.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("clusters"), F.bool_or(F.col("type").isin(high)).alias("high_priority"))


def retrieve_topic(chunks: DataFrame, images: DataFrame, query: list[float], k: int = 50, per_source: int = 10, n_images: int = 50) -> tuple[DataFrame, DataFrame]:
    """Chunks by cosine, diversified by source, and the best images of those sources."""
    scored = rt.dense(chunks, query, 2 * k, id_col="chunk_id").join(chunks.select("chunk_id", "source"), "chunk_id")
    top = rt.diversify(scored, "source", "score", "chunk_id", per_source, k)
    mine = images.join(top.select("source").distinct(), "source", "left_semi")
    return top, rt.dense(mine, query, n_images, id_col="image_id")


def hybrid_search(chunks: DataFrame, query: str, query_vector: list[float], k: int = 10, pool: int = 50, where: Column | None = None, scorer: Column | None = None) -> DataFrame:
    """Dense and BM25 candidates of ``chunks(id, text, embedding, ...)``, merged by rank, filtered and reranked.

    The filter applies to every candidate; without a scorer the dense score decides.
    """
    src = chunks if where is None else chunks.where(where)
    d = rt.dense(src, query_vector, min(5 * k, 100), 0.4, id_col="id")
    s = rt.bm25(src, query, pool, id_col="id")
    merged = rt.hybrid_merge(d, s, pool)
    rows = src.join(merged, "id")
    return rt.rerank(rows, F.lit(None).cast("double") if scorer is None else scorer, k)


def late_interaction(docs: DataFrame, query_tokens: list[list[float]], k: int = 10, tokens: str = "token_vectors") -> DataFrame:
    """MaxSim over token vectors: ``id, score, rank``."""
    top = docs.select("id", vx.maxsim(query_tokens, F.col(tokens)).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def combined_search(pages: DataFrame, captions: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """Pages and captions in one list with their kind."""
    a = rt.dense(pages, query, k, id_col="id").withColumn("kind", F.lit("page"))
    b = rt.dense(captions, query, k, id_col="id").withColumn("kind", F.lit("caption"))
    return a.unionByName(b).orderBy(F.desc("score"), "kind", "id").limit(k)


def topics(sources: DataFrame, group: str = "specialty", title: str = "title", n: int = 10) -> DataFrame:
    """First titles of every specialty, sorted."""
    ranked = rt.top_per(sources.withColumn("_k", F.lit(0)), group, "_k", n, title).drop("_k")
    return ranked.groupBy(group).agg(F.array_sort(F.collect_list(title)).alias("titles"), F.count("*").alias("shown"))


def latex_document(sections: DataFrame, title: str) -> DataFrame:
    """One LaTeX text of ``sections(ord, title, content)``; titles and contents are escaped."""
    part = F.concat(F.lit("\\section{"), tx.latex_escape(F.col("title")), F.lit("}\n"), tx.latex_escape(F.col("content")))
    rows = sections.select("ord", part.alias("part"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    return body.select(F.concat(F.lit("\\documentclass{article}\n\\title{"), tx.latex_escape(F.lit(title)), F.lit("}\n\\begin{document}\n\\maketitle\n"), "body", F.lit("\n\\end{document}\n")).alias("value"))


def recoveries(names: DataFrame, name: str = "name") -> DataFrame:
    """Recovery points ``topic_YYYYMMDD_HHMMSS``, read from the right, newest first."""
    p = r"^(.*)_([0-9]{8}_[0-9]{6})$"
    rows = names.select(name, F.regexp_extract(name, p, 1).alias("topic"), F.try_to_timestamp(F.regexp_extract(name, p, 2), F.lit("yyyyMMdd_HHmmss")).alias("at"))
    return rows.where("at IS NOT NULL").orderBy(F.desc("at"), name)

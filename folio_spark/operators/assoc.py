"""Associations: tokens, claims, contexts, figures and steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as tx


def token_jaccard(left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float) -> DataFrame:
    """Pairs with a token-set Jaccard of ``threshold`` or more; ``left(id, w)`` and ``right(id, v)``.

    Shared tokens are counted by a join on the token; sizes travel with the rows, so no set is
    fetched again and pairs without a common token never appear.
    """
    a = left.select(left_id, F.size("w").alias("na"), F.explode("w").alias("t"))
    b = right.select(right_id, F.size("v").alias("nb"), F.explode("v").alias("t"))
    both = a.join(b, "t").groupBy(left_id, right_id, "na", "nb").agg(F.count("*").alias("n"))
    score = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return both.where(score >= threshold).select(left_id, right_id, F.round(score, 6).alias("score"))


def verify_claims(claims: DataFrame, sources: DataFrame, least: float, key: str = "item_id", rounded: bool = True) -> DataFrame:
    """Share of a claim's distinct words in each cited source (null source: no support): ``key, doc_id, overlap, supported``."""
    c = claims.select(key, F.array_distinct(tx.tokens(F.col("text"))).alias("cw"))
    s = sources.select(key, "doc_id", F.array_distinct(tx.tokens(F.col("text"))).alias("sw"))
    ratio = F.when(F.size("cw") == 0, 0.0).otherwise(F.size(F.array_intersect("cw", "sw")) / F.size("cw"))
    out = s.join(c, key)
    return out.select(key, "doc_id", (F.round(ratio, 6) if rounded else ratio).alias("overlap"), (ratio > least).alias("supported"))


def verification_scores(checked: DataFrame, key: str = "item_id") -> DataFrame:
    """``1 - .3 high - .1 medium - .02 low`` issues of each claim, 0 at least, and its status."""
    o = F.col("overlap")
    agg = checked.groupBy(key).agg(F.count_if(o <= 0.1).alias("high"), F.count_if((o > 0.1) & (o <= 0.2)).alias("medium"), F.count_if((o > 0.2) & (o <= 0.3)).alias("low"))
    score = F.greatest(F.lit(0.0), 1 - 0.3 * F.col("high") - 0.1 * F.col("medium") - 0.02 * F.col("low"))
    status = F.when(F.col("high") > 0, "failed").when(score >= 0.9, "passed").otherwise("review")
    return agg.select(key, "high", "medium", "low", F.round(score, 6).alias("score"), status.alias("status"))


def details_preserved(claims: DataFrame, merged: DataFrame, key: str = "item_id", head: int = 50, more_than: int = 20) -> DataFrame:
    """How many of each claim's sentences stand in some merged text, by their first characters.

    The sentences are few (those of the claims); one pass over the texts looks for all of them at once.
    """
    s = claims.select(key, F.explode(tx.sentences(F.col("text"))).alias("s")).where(F.length(F.trim("s")) > more_than)
    heads = s.select(key, F.substring("s", 1, head).alias("head")).distinct()
    probes = sorted(r[0] for r in heads.select("head").distinct().collect())
    found = merged.select("text").mapInArrow(lambda batches: _contained(batches, probes), "head string").distinct()
    marked = heads.join(F.broadcast(found.withColumn("kept", F.lit(True))), "head", "left")
    return marked.groupBy(key).agg(F.count("*").alias("n_details"), F.count_if("kept").alias("n_kept"))


def _contained(batches: Iterator[pa.RecordBatch], probes: list[str]) -> Iterator[pa.RecordBatch]:
    """Those ``probes`` that stand in some text, each once: places where eight bytes begin one are compared in full."""
    left: dict[bytes, list[bytes]] = {}
    for p in (p.encode() for p in probes):
        left.setdefault(p[:8], []).append(p)
    short = [p for b in left for p in left[b] if len(b) < 8]
    starts = np.sort(np.array([int.from_bytes(b, "little") for b in left if len(b) == 8], "uint64"))
    # A table by the first two bytes leaves few places to look up.
    table = np.zeros(1 << 16, bool)
    table[(starts & np.uint64(0xFFFF)).astype("int64")] = True
    found: set[bytes] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            raw = text.encode()
            found.update(p for p in short if p in raw)
            if len(raw) < 8 or not len(starts):
                continue
            view = np.frombuffer(raw, "uint8")
            at = np.flatnonzero(table[view[:-7].astype("int64") | (view[1:-6].astype("int64") << 8)])
            if not len(at):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(view, 8)[at].copy().view("<u8").ravel()
            at = at[starts[np.minimum(np.searchsorted(starts, windows), len(starts) - 1)] == windows]
            for i in at.tolist():
                found.update(p for p in left[raw[i : i + 8]] if p not in found and raw.startswith(p, i))
    yield pa.RecordBatch.from_pydict({"head": pa.array([p.decode() for p in sorted(found)], pa.string())})


def first_context(df: DataFrame, term: str, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First place of a term, its number of occurrences and the digest of its context with ellipses."""
    t = F.col(text_col)
    at = F.locate(term, t)
    hits = df.where(F.contains(t, F.lit(term))).withColumn("at", at)
    start = F.greatest(F.col("at") - window, F.lit(1))
    size = F.least(F.lit(window), F.col("at") - 1) + len(term) + window
    ctx = tx.collapse(F.substring(t, start, size))
    text = F.concat(F.when(F.col("at") > window + 1, "...").otherwise(""), ctx, F.when(F.col("at") + window + len(term) - 1 < F.length(t), "...").otherwise(""))
    return hits.select(id_col, F.col("at").cast("long").alias("position"), tx.occurrences(t, term).alias("n_occurrences"), F.md5(text).alias("context_md5"))


def word_index(df: DataFrame, id_col: str, text_col: str = "text", least: int = 3) -> DataFrame:
    """Inverted index: ``word, n_items, first_item, items``."""
    rows = df.select(id_col, F.explode(F.array_distinct(tx.tokens(F.col(text_col)))).alias("word")).where(F.length("word") >= least)
    return rows.groupBy("word").agg(F.count("*").alias("n_items"), F.min(id_col).alias("first_item"), F.array_sort(F.collect_list(id_col)).alias("items"))


def consecutive_groups(df: DataFrame, by: str | list[str], order: list[str], step: str, place: str | None = None, reach: int = 2) -> DataFrame:
    """Number runs of rows whose ``step`` rises by one and whose ``place`` moves by ``reach`` at most."""
    w = Window.partitionBy(by).orderBy(*order)
    ok = F.col(step) == F.lag(step).over(w) + 1
    if place:
        ok = ok & (F.abs(F.col(place) - F.lag(place).over(w)) <= reach)
    rows = df.withColumn("_new", F.when(ok, 0).otherwise(1))
    return rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sequence_metrics(df: DataFrame, by: list[str], step: str, kind: str, score: str, place: str) -> DataFrame:
    """Length, majority kind (the smaller on ties), mean score, extent and completeness of each sequence."""
    n = df.groupBy(*by, kind).agg(F.count("*").alias("c")).groupBy(*by).agg(F.max_by(kind, F.struct(F.col("c"), (-F.ascii(F.col(kind))))).alias("kind"))
    m = df.groupBy(*by).agg(
        F.count("*").alias("length"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.min(place).alias("first_place"),
        F.max(place).alias("last_place"),
        F.round(F.count_distinct(step) / (F.max(step) - F.min(step) + 1), 6).alias("completeness"),
    )
    return m.join(n, by)


def figure_sequences(steps: DataFrame, least: int = 2) -> DataFrame:
    """Sequences of figures of a document: shared figure prefix first, then consecutive steps; later groups that
    overlap an earlier one by more than half are dropped: ``doc_id, seq_no, kind, image_ids``.

    ``steps``: ``doc_id, image_id, page, prefix, step``.  The overlap rule depends on order, so a fold walks each document.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "step", "image_id"], kind="stable")
        groups = []
        for prefix, g in pdf[pdf.prefix.notna()].groupby("prefix", sort=True):
            if len(g) >= least:
                groups.append(("prefix", list(g.image_id)))
        cur, last = [], None
        for r in pdf[pdf.step.notna()].itertuples():
            if last is not None and r.step == last.step + 1 and abs(r.page - last.page) <= 2:
                cur.append(r.image_id)
            else:
                if len(cur) >= least:
                    groups.append(("steps", cur))
                cur = [r.image_id]
            last = r
        if len(cur) >= least:
            groups.append(("steps", cur))
        kept: list[tuple[str, list]] = []
        for kind, ids in groups:
            if all(len(set(ids) & set(k)) <= 0.5 * len(ids) for _, k in kept):
                kept.append((kind, ids))
        doc = pdf.doc_id.iloc[0]
        return pd.DataFrame([(doc, i, k, ids) for i, (k, ids) in enumerate(kept)], columns=["doc_id", "seq_no", "kind", "image_ids"])

    return steps.groupBy("doc_id").applyInPandas(run, "doc_id long, seq_no int, kind string, image_ids array<string>")


def captions_for_images(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Greedy assignment on a page: images in order take the nearest caption that is still free: ``page, image_id, caption_id, distance``."""
    spot = F.struct("x", "y")
    c = captions.groupBy("page").agg(F.collect_list(F.struct("caption_id", "x", "y")).alias("free"))
    own = images.where("image_id IS NOT NULL").groupBy("page", "image_id").agg(F.min("y").alias("y"), F.collect_list(spot).alias("at"))
    # Missing places come last.
    i = own.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("y").isNull().alias("none"), "y", "image_id", "at"))).alias("images"))
    rows = i.join(c, "page")
    taken = "struct<image_id:string,caption_id:string,distance:double>"
    zero = F.struct(F.expr(f"CAST(array() AS array<{taken}>)").alias("done"), F.col("free").alias("free"))

    def near(caption: Column, at: Column) -> Column:
        far = F.transform(at, lambda p: F.sqrt(F.pow(p["x"] - caption["x"], F.lit(2)) + F.pow(p["y"] - caption["y"], F.lit(2))))
        distance = F.array_min(far)
        return F.struct(distance.isNull().alias("none"), distance.alias("distance"), caption["caption_id"].alias("caption_id"))

    def step(acc: Column, image: Column) -> Column:
        best = F.array_min(F.transform(acc["free"], lambda c: near(c, image["at"])))
        pair = F.struct(image["image_id"].alias("image_id"), best["caption_id"].alias("caption_id"), best["distance"].alias("distance")).cast(taken)
        left = F.filter(acc["free"], lambda c: ~c["caption_id"].eqNullSafe(best["caption_id"]))
        return F.when(F.size(acc["free"]) == 0, acc).otherwise(F.struct(F.concat(acc["done"], F.array(pair)).alias("done"), left.alias("free")))

    found = rows.select("page", F.explode(F.aggregate("images", zero, step)["done"]).alias("p"))
    return found.select(F.col("page").cast("long").alias("page"), "p.*")


def association_score(keyword: Column, proximity: Column, context: Column, same_page: Column, figure_ref: Column) -> Column:
    """``.5 / .3 / .2`` weighted score with boosts for a shared page and a figure reference, 1 at most; below .10 null."""
    s = 0.5 * keyword + 0.3 * proximity + 0.2 * context + F.when(same_page, 0.15).otherwise(0.0) + F.when(figure_ref, 0.20).otherwise(0.0)
    s = F.least(F.lit(1.0), s)
    return F.when(s >= 0.10, s)


def path_clusters(paths: DataFrame, cell: int = 50) -> DataFrame:
    """Flood fill of drawing paths over a grid: ``path_id, cluster`` of cells that touch, corners included."""
    from folio_spark.functions.graph import connected_components

    cells = paths.select("path_id", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    occupied = cells.groupBy("cx", "cy").agg(F.min("path_id").alias("head"))
    near = occupied.select("head", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy").select("head", "cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"))
    edges = near.withColumnRenamed("head", "src").join(occupied.withColumnRenamed("head", "dst"), ["cx", "cy"]).where("src <> dst").select("src", "dst")
    comps = connected_components(edges)
    named = cells.join(occupied, ["cx", "cy"]).join(comps, F.col("head") == F.col("id"), "left")
    return named.select("path_id", F.coalesce("component", "head").alias("cluster"))

"""Chunkers: word windows, character windows, paragraph packing, heading structure, page assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as tx


def chunk_id(*parts: Column) -> Column:
    """First sixteen hex digits of the MD5 of the parts joined by underscores."""
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 16)


def fixed_words(df: DataFrame, size: int = 1000, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of ``size`` words, ``size - overlap`` apart: ``id, chunk_no, content, word_count``; empty texts give none."""
    step = size - overlap
    w = df.select(id_col, tx.words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.expr(f"sequence(0, size(w) - 1, {step})")
    rows = w.select(id_col, "w", F.posexplode(starts).alias("chunk_no", "s"))
    part = F.slice("w", F.col("s") + 1, size)
    return rows.select(id_col, "chunk_no", F.array_join(part, " ").alias("content"), F.size(part).alias("word_count"))


def fixed_chars(df: DataFrame, size: int = 1000, overlap: int = 200, more_than: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of ``size`` characters: ``id, chunk_no, char_start, char_end, content``; stripped contents of ``more_than`` characters stay."""
    step = size - overlap
    rows = df.where(F.length(text_col) > 0).select(id_col, F.col(text_col).alias("t"), F.posexplode(F.expr(f"sequence(0, length({text_col}) - 1, {step})")).alias("chunk_no", "char_start"))
    content = F.substring(F.col("t"), F.col("char_start") + 1, F.lit(size))
    out = rows.select(id_col, "chunk_no", "char_start", (F.col("char_start") + F.length(content)).alias("char_end"), content.alias("content"))
    return out.where(F.length(tx.stripped(F.col("content"))) > more_than)


def pack_paragraphs(df: DataFrame, size: int = 1500, separator: str = r"\n[ \t]*\n", least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Greedy packing of paragraphs into chunks of ``size`` characters: ``id, chunk_no, content``.

    A text that fits is one chunk.  A chunk of more than one paragraph hands its last one on as
    overlap; a paragraph longer than ``size`` is packed by sentences.
    """
    text = tx.stripped(F.col(text_col))
    pieces = F.flatten(F.transform(tx.paragraphs(F.col(text_col), separator, least), lambda p: F.when(F.length(p) > size, tx.sentences(p)).otherwise(F.array(p))))
    rows = df.where(F.length(text) > 0).select(id_col, text.alias("t"), pieces.alias("ps"))
    kind = "struct<done:array<string>,cur:array<string>,len:int>"
    zero = F.expr(f"CAST(named_struct('done', array(), 'cur', array(), 'len', 0) AS {kind})")

    def step(acc: Column, p: Column) -> Column:
        fits = (F.size(acc["cur"]) == 0) | (acc["len"] + F.length(p) + 2 <= size)
        last = F.element_at(acc["cur"], -1)
        carried = (F.size(acc["cur"]) > 1) & (F.length(last) + 2 + F.length(p) <= size)
        cur = F.when(fits, F.concat(acc["cur"], F.array(p))).when(carried, F.array(last, p)).otherwise(F.array(p))
        length = F.when(fits, acc["len"] + F.length(p) + 2).when(carried, F.length(last) + F.length(p) + 4).otherwise(F.length(p) + 2)
        done = F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n"))))
        return F.struct(done.alias("done"), cur.alias("cur"), length.cast("int").alias("len")).cast(kind)

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["done"])

    chunks = F.when(F.length("t") <= size, F.array("t")).otherwise(F.aggregate("ps", zero, step, finish))
    return rows.select(id_col, F.posexplode(chunks).alias("chunk_no", "content"))


def by_headings(df: DataFrame, heading: str = r"(?m)^(#{1,6}) +(.+)$", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections under Markdown headings: ``id, section_no, level, title, content``; text before the first heading is dropped."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("ln", "line"))
    mark = F.col("line").rlike(r"^#{1,6} +\S")
    section = F.sum(mark.cast("int")).over(Window.partitionBy(id_col).orderBy("ln"))
    rows = lines.withColumn("section_no", section).where("section_no > 0")
    return rows.groupBy(id_col, "section_no").agg(
        F.max(F.when(mark, F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)))).alias("level"),
        F.max(F.when(mark, F.regexp_extract("line", "^#{1,6} +(.*?) *$", 1))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~mark, F.struct("ln", "line")))), lambda x: x["line"]), "\n").alias("content"),
    )


def merge_small(chunks: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """Join adjacent pairs of chunks below ``limit`` words; pairs do not cascade: position in a run of small ones decides."""
    w = Window.partitionBy(id_col).orderBy("chunk_no")
    small = (F.col("word_count") < limit).cast("int")
    rows = chunks.withColumn("small", small).withColumn("run", F.sum((1 - F.col("small")) + F.coalesce((F.lag("small").over(w) == 0).cast("int"), F.lit(0)) * F.col("small")).over(w))
    place = F.row_number().over(Window.partitionBy(id_col, "run", "small").orderBy("chunk_no")) - 1
    rows = rows.withColumn("pair", F.when(F.col("small") == 1, F.floor(place / 2)).otherwise(place))
    return rows.groupBy(id_col, "run", "small", "pair").agg(
        F.min("chunk_no").alias("chunk_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
        F.sum("word_count").alias("word_count"),
    ).drop("run", "small", "pair")


def backoff_chars(df: DataFrame, size: int = 1500, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Character windows that end at a sentence boundary in their last fifth if there is one: ``id, chunk_no, content``.

    The stride depends on the text, so a Pandas function walks each one.
    """

    def split(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            end = min(at + size, len(text))
            if end < len(text):
                floor = at + int(size * 0.8)
                stop = max(text.rfind(s, floor, end) for s in (". ", "! ", "? ", "\n"))
                if stop >= floor:
                    end = stop + 1
            piece = text[at:end].strip()
            if piece:
                out.append(piece)
            if end >= len(text):
                break
            at = max(end - overlap, at + 1)
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t) if t else [])

    return df.select(id_col, F.posexplode(run(F.col(text_col))).alias("chunk_no", "content"))


def semantic_split(df: DataFrame, drop: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deterministic stand-in for model-made chunks: a new chunk starts where neighbouring sentences share too few words."""
    sent = df.select(id_col, F.posexplode(tx.sentences(F.col(text_col))).alias("sn", "s")).withColumn("w", F.array_distinct(tx.tokens(F.col("s"))))
    w = Window.partitionBy(id_col).orderBy("sn")
    prev = F.lag("w").over(w)
    sim = F.size(F.array_intersect("w", prev)) / F.greatest(F.lit(1), F.size(F.array_union("w", prev)))
    rows = sent.withColumn("new", F.when(prev.isNull() | (sim < drop), 1).otherwise(0)).withColumn("chunk_no", F.sum("new").over(w) - 1)
    return rows.groupBy(id_col, "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sn", "s"))), lambda x: x["s"]), " ").alias("content"))


def assign_pages(chunks: DataFrame, page_chars: int, id_col: str = "doc_id") -> DataFrame:
    """Page (from 1) that holds each chunk's midpoint, for pages of fixed size."""
    return chunks.withColumn("page", F.floor(F.floor((F.col("char_start") + F.col("char_end")) / 2) / page_chars) + 1)


def assign_pages_by_range(chunks: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As-of join of chunk midpoints to ``pages(id, page, page_start)``: the last page that starts at or before the midpoint."""
    mid = chunks.withColumn("_at", F.floor((F.col("char_start") + F.col("char_end")) / 2).cast("long"))
    marks = pages.select(id_col, F.col("page_start").cast("long").alias("_at"), F.col("page").alias("_page"))
    both = mid.withColumn("_page", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(id_col).orderBy("_at", F.col("_page").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.last("_page", ignorenulls=True).over(order)).where("chunk_no IS NOT NULL").drop("_at", "_page")

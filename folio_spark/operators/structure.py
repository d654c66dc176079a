"""Document structure: tables of contents, page chunks, sections by fonts, balanced chunks, clusters within topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import graph
from folio_spark.functions.deal import dealt

#: Header lines by pattern (numbered; capitals; title case), and the font rules.
NUMBERED, CAPITALS, TITLE_CASE = r"^[0-9]+\.?[0-9]*\.?[0-9]*[ \t]+[A-Z][^.!?\n]{3,80}$", r"^[A-Z][A-Z \t]{4,60}$", r"^([A-Z][a-z]+ ?){2,8}$"
LARGE, LARGEST, BOLD_FROM, BOLD = 14.0, 16.0, 11.0, 16


def toc_entries(docs: DataFrame, id_col: str, toc: str = "toc") -> DataFrame:
    """``id, entry_no, level, title, page`` from a column ``array<struct<level,title,page>>``."""
    return docs.select(id_col, F.posexplode(toc).alias("entry_no", "e")).select(id_col, "entry_no", "e.level", F.trim("e.title").alias("title"), "e.page")


def toc_ranges(entries: DataFrame, id_col: str, order: str, page: str, last_page: str) -> DataFrame:
    """Entries with ``page_from, page_to``: to the page before the next entry, its own at least; the last one to the document's end."""
    following = F.lead(page).over(Window.partitionBy(id_col).orderBy(order))
    return entries.withColumn("page_from", F.col(page)).withColumn("page_to", F.greatest(F.col(page), F.coalesce(following - 1, F.col(last_page))))


def toc_chunks(entries: DataFrame, pages: DataFrame, id_col: str, order: str, page: str, text: str) -> DataFrame:
    """``id, order, page_from, n_pages, content``: the pages' texts under the entry that starts last before or on them.

    One sort by document and page instead of a range join; pages before the first entry belong to none.
    """
    rows = entries.select(id_col, F.col(page).alias("_p"), F.lit(0).alias("_k"), F.col(order).alias("_o"), F.lit(None).cast("string").alias("_t")).unionByName(
        pages.select(id_col, F.col(page).alias("_p"), F.lit(1).alias("_k"), F.lit(None).cast(entries.schema[order].dataType).alias("_o"), F.col(text).alias("_t"))
    )
    under = F.last("_o", ignorenulls=True).over(Window.partitionBy(id_col).orderBy("_p", "_k", "_o"))
    rows = rows.withColumn("_e", under).where("_k = 1 AND _e IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("_p", "_t")))
    out = rows.groupBy(id_col, F.col("_e").alias(order)).agg(F.min("_p").alias("page_from"), F.count("*").alias("n_pages"), parts.alias("ps"))
    return out.select(id_col, order, "page_from", "n_pages", F.array_join(F.transform("ps", lambda x: x["_t"]), "\n").alias("content"))


def page_chunks(pages: DataFrame, id_col: str, page: str, text: str, size: int = 5) -> DataFrame:
    """``id, chunk_no, page_from, page_to, content``: ``size`` pages a chunk, pages numbered from 0; a chunk is at most so many rows."""
    chunk = F.floor(F.col(page) / size).cast("long")
    rows = pages.groupBy(id_col, chunk.alias("chunk_no")).agg(F.min(page).alias("page_from"), F.max(page).alias("page_to"), F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))).alias("ps"))
    return rows.select(id_col, "chunk_no", "page_from", "page_to", F.array_join(F.transform("ps", lambda x: x["t"]), "\n").alias("content"))


def header_level(line: Column, size: Column, flags: Column) -> Column:
    """1 or 2 for header lines by font size, boldness or pattern; 0 for others and for lines of under 3 or over 100 characters."""
    by_pattern = F.when(line.rlike(r"^[0-9]+\.[0-9]+"), 2).otherwise(1)
    return (
        F.when((F.length(line) < 3) | (F.length(line) > 100) | line.isNull(), 0)
        .when(size >= LARGEST, 1)
        .when(size >= LARGE, 2)
        .when((flags.bitwiseAND(BOLD) != 0) & (size >= BOLD_FROM), 2)
        .when(line.rlike(NUMBERED) | line.rlike(CAPITALS) | line.rlike(TITLE_CASE), by_pattern)
        .otherwise(0)
    )


def sections_by_font(lines: DataFrame, id_col: str, order: str, page: str, line: str, size: str, flags: str) -> DataFrame:
    """``id, section_no, title, level, page_start, page_end, content``: headers with the lines below them.

    Headers without lines go; lines before the first header belong to no section; a document
    without any header is one section "Content".
    """
    by_doc = Window.partitionBy(id_col).orderBy(order)
    rows = lines.withColumn("_lv", header_level(F.col(line), F.col(size), F.col(flags)))
    rows = rows.withColumn("_s", F.sum((F.col("_lv") > 0).cast("int")).over(by_doc)).withColumn("_any", F.max("_s").over(Window.partitionBy(id_col)))
    rows = rows.where("_s > 0 OR _any = 0")
    body = F.when(F.col("_lv") == 0, F.struct(F.col(order).alias("o"), F.col(line).alias("l")))
    out = rows.groupBy(id_col, F.col("_s").alias("section_no")).agg(
        F.coalesce(F.max(F.when(F.col("_lv") > 0, F.col(line))), F.lit("Content")).alias("title"), F.greatest(F.max("_lv"), F.lit(1)).alias("level"),
        F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.array_sort(F.array_compact(F.collect_list(body))).alias("ls"),
    )
    return out.where(F.size("ls") > 0).select(id_col, "section_no", "title", "level", "page_start", "page_end", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("content"))


def split_large(chunks: DataFrame, target: int, over: float = 1.5, id_col: str = "doc_id", order: str = "chunk_no", text: str = "content") -> DataFrame:
    """``id, order, part, content``: chunks of more than ``over * target`` words are cut between paragraphs, about ``target`` words a part."""
    words = lambda c: F.size(F.filter(F.split(c, r"[ \t\n\r\x0b\x0c]+"), lambda w: w != ""))
    kind = "struct<done:array<string>,cur:array<string>,n:int>"
    zero = F.expr(f"CAST(named_struct('done', array(), 'cur', array(), 'n', 0) AS {kind})")

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] + words(p) > target) & (F.size(acc["cur"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(acc["cur"], F.array(p))).alias("cur"),
            F.when(full, words(p)).otherwise(acc["n"] + words(p)).alias("n"),
        ).cast(kind)

    parts = F.aggregate(F.split(text, "\n\n"), zero, step, lambda acc: F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n"))))
    return chunks.select(id_col, order, F.posexplode(F.when(words(F.col(text)) > over * target, parts).otherwise(F.array(text))).alias("part", text))


def merge_small(chunks: DataFrame, target: int, under: float = 0.3, id_col: str = "doc_id", order: list[str] | None = None, text: str = "content") -> DataFrame:
    """``id, position, n_merged, content``: of adjacent chunks of under ``under * target`` words every two become one.

    Pairs don't cascade: in a run of small chunks the first takes the second, the third the fourth.
    """
    order = order or ["chunk_no", "part"]
    words = F.size(F.filter(F.split(text, r"[ \t\n\r\x0b\x0c]+"), lambda w: w != ""))
    by_doc = Window.partitionBy(id_col).orderBy(*order)
    rows = dealt(chunks, id_col).withColumn("_i", F.row_number().over(by_doc)).withColumn("_small", (words < under * target).cast("int"))
    # Small chunks of a run share the number of larger ones before them; their place in the run tells the pair.
    rows = rows.withColumn("_run", F.sum(1 - F.col("_small")).over(by_doc))
    place = F.row_number().over(Window.partitionBy(id_col, "_run", "_small").orderBy("_i"))
    rows = rows.withColumn("_head", F.when(F.col("_small") == 1, F.col("_i") - (place - 1) % 2).otherwise(F.col("_i")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(text).alias("t"))))
    out = rows.groupBy(id_col, "_head").agg(parts.alias("ps"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("_head"))
    return out.select(id_col, rank.alias("position"), F.size("ps").alias("n_merged"), F.array_join(F.transform("ps", lambda x: x["t"]), "\n\n").alias(text))


def clusters_within(pairs: DataFrame, members: DataFrame, id_col: str, topic: str, default: str = "general") -> DataFrame:
    """``id, topic, cluster_id``: components of similar ``pairs(i, j)`` whose ends share a topic; null topics are the default one.

    Give ``pairs`` from a search by topic (``by`` of the similarity join); pairs across topics are dropped here.
    """
    named = members.select(F.col(id_col).alias("id"), F.coalesce(F.col(topic).cast("string"), F.lit(default)).alias("topic"))
    side = lambda c, t: named.select(F.col("id").alias(c), F.col("topic").alias(t))
    same = pairs.select("i", "j").join(side("i", "ti"), "i").join(side("j", "tj"), "j").where("ti = tj")
    comps = graph.connected_components(same.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    return named.join(comps.select("id", "component"), "id", "left").select(F.col("id").alias(id_col), "topic", F.coalesce("component", "id").alias("cluster_id"))

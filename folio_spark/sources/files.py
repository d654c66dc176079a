"""Document sources: binary files by suffix, text with encoding fallback, HTML, DOCX and EPUB, index files, logs, JSON.

Parsers run inside executors over ``binaryFile`` rows, so any store Spark can list will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.sources import epub, pdf

FORMATS = {"pdf": "pdf", "epub": "epub", "docx": "docx", "doc": "docx", "txt": "text", "text": "text", "md": "markdown", "html": "html", "htm": "html"}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder tree: ``path, modificationTime, length, content, format`` (null: unknown suffix)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("format", file_format(F.col("path")))


def file_format(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), suffix)


def fast_checksum(length: Column, modified: Column) -> Column:
    """Size and time of a file: cheap, and changes when either does."""
    return F.concat_ws("_", length.cast("string"), F.unix_timestamp(modified).cast("string"))


def document_id(name: Column, length: Column, modified: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", name, length.cast("string"), F.unix_timestamp(modified).cast("string"))), 1, 12)


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1, which always is."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def text_metadata(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Title, year and author line from the first ten lines."""
    head = F.slice(F.split(text_col, "\n"), 1, 10)
    title = F.get(F.filter(head, lambda x: F.length(F.trim(x)) > 0), 0)
    top = F.array_join(head, "\n")
    year = F.regexp_extract(top, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    author = F.regexp_extract(top, r"(?im)^(?:by|authors?:?) +(.+)$", 1)
    return df.withColumn("title", F.trim(title)).withColumn("year", F.when(year != "", year.cast("int"))).withColumn("authors", split_authors(author))


def split_authors(text: Column) -> Column:
    """By the first of semicolon, `` and ``, ampersand, comma that occurs."""
    parts = (
        F.when(F.contains(text, F.lit(";")), F.split(text, ";"))
        .when(F.contains(text, F.lit(" and ")), F.split(text, " and "))
        .when(F.contains(text, F.lit("&")), F.split(text, "&"))
        .otherwise(F.split(text, ","))
    )
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def infer_headings(df: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Headings of a text: Markdown ones, else numbered ones, else lines in capitals; ``id, line_no, level, title``."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    line = F.trim("line")
    marks = F.when(line.rlike(r"^#{1,6} +\S"), 1).when(line.rlike(r"^[0-9]+(\.[0-9]+)*\.? +[A-Z]"), 2).when(line.rlike(r"^[A-Z][A-Z0-9 ,:&-]{3,79}$"), 3)
    rows = lines.withColumn("kind", marks).where("kind IS NOT NULL")
    best = F.min("kind").over(Window.partitionBy(id_col))
    level = F.when(F.col("kind") == 1, F.length(F.regexp_extract(line, "^(#+)", 1))).when(F.col("kind") == 2, F.size(F.split(F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\."))).otherwise(1)
    title = F.regexp_replace(line, r"^#+ +|^[0-9]+(\.[0-9]+)*\.? +", "")
    return rows.withColumn("best", best).where("kind = best").select(id_col, "line_no", level.alias("level"), title.alias("title"))


def _docx(raw: bytes) -> str:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))[0]
    out = []
    for node in body:
        if node.tag == ns + "p":
            style = node.find(f"{ns}pPr/{ns}pStyle")
            text = "".join(t.text or "" for t in node.iter(ns + "t"))
            level = re.match(r"Heading ?([1-6])$", style.get(ns + "val", "")) if style is not None else None
            if text.strip():
                out.append("#" * int(level[1]) + " " + text if level else text)
        elif node.tag == ns + "tbl":
            for row in node.iter(ns + "tr"):
                out.append(" | ".join("".join(t.text or "" for t in cell.iter(ns + "t")) for cell in row.iter(ns + "tc")))
    return "\n\n".join(out)


def _epub(raw: bytes) -> str:
    """Chapters in reading order, each under its first heading."""
    parts = epub.read(raw)["chapters"]
    return "\n\n".join((f"## {title}\n\n" if title else "") + text for _, _, title, text in parts)


_PARSERS = {"docx": _docx, "epub": _epub, "pdf": pdf.plain}


def parse_files(files: DataFrame) -> DataFrame:
    """``path, format, text, error``: text formats are decoded by Spark, the others by their parsers; a failure is a column, not a stop."""
    plain = files.where(F.col("format").isin("text", "markdown", "html")).select("path", "format", decode_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, raw in zip(batch.path, batch.format, batch.content, strict=True):
                try:
                    out.append((path, kind, _PARSERS[kind](raw), None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, kind, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "format", "text", "error"])

    other = files.where(F.col("format").isin(*_PARSERS)).select("path", "format", "content").mapInPandas(run, "path string, format string, text string, error string")
    return plain.unionByName(other)


def path_metadata(path: Column) -> Column:
    """``struct<collection, subspecialty, title, chapter>`` from a path of at least two folders."""
    parts = F.split(path, "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    chapter = F.regexp_extract(name, r"(?i)^(?:ch(?:apter)?[ ._-]*)?([0-9]{1,4})[ ._-]", 1)
    return F.struct(
        F.get(parts, F.size(parts) - 3).alias("collection"),
        F.get(parts, F.size(parts) - 2).alias("subspecialty"),
        F.trim(F.regexp_replace(name, r"(?i)^(?:ch(?:apter)?[ ._-]*)?[0-9]{1,4}[ ._-]+", "")).alias("title"),
        F.when(chapter != "", chapter.cast("int")).alias("chapter"),
    )


#: Collections by folder with their authority, and words that tell a folder is no subspecialty.
COLLECTIONS = [("01_COMPLETE_TEXTBOOKS", "Textbooks", 95), ("04_EVIDENCE_BASE_STUDIES", "Evidence", 90), ("02_MULTI_CHAPTER_BOOKS", "Books", 80), ("06_CLINICAL_GUIDELINES", "Guidelines", 100)]
NO_SUBSPECIALTY = "TEXTBOOKS|GUIDELINES|CHAPTER|EVIDENCE"


def folder_metadata(path: Column) -> Column:
    """``struct<collection, subspecialty, condition, authority>`` from a library's numbered folders.

    The last folder ``NN_Name`` that names no collection is the subspecialty; the file's own folder
    is the condition unless it is numbered or the subspecialty itself.
    """
    parts = F.split(path, "/")
    collection, authority = None, None
    for folder, name, score in COLLECTIONS:
        has = F.array_contains(parts, folder)
        collection = F.when(has, name) if collection is None else collection.when(has, name)
        authority = F.when(has, score) if authority is None else authority.when(has, score)
    named = F.transform(parts, lambda p: F.replace(F.regexp_extract(p, "^[0-9]+_([A-Za-z_-]+)", 1), F.lit("_"), F.lit(" ")))
    special = F.coalesce(F.try_element_at(F.filter(named, lambda n: (n != "") & ~n.rlike(NO_SUBSPECIALTY)), F.lit(-1)), F.lit("General"))
    parent = F.get(parts, F.size(parts) - 2)
    return F.struct(
        collection.otherwise("Unknown").alias("collection"),
        special.alias("subspecialty"),
        F.when(~F.startswith(parent, F.lit("0")) & (parent != special) & (parent != ""), parent).alias("condition"),
        authority.otherwise(80).alias("authority"),
    )


def series_of(folder: Column, known: dict[str, str]) -> Column:
    """Display name of the first known series whose key a folder's name holds, else the folder."""
    out = None
    for key, name in known.items():
        has = F.contains(F.lower(folder), F.lit(key.lower()))
        out = F.when(has, name) if out is None else out.when(has, name)
    return folder if out is None else out.otherwise(folder)


def chapter_order(chapter: Column, title: Column) -> list[Column]:
    """Sort order of a series: chapter number, those without one last, then title."""
    return [F.coalesce(chapter, F.lit(9999)).asc(), title.asc()]


def pdf_date(text: Column) -> Column:
    """Date of a PDF date string ``D:YYYYMMDD...``; missing parts count as the first, what is no date is null."""
    part = lambda n: F.regexp_extract(text, r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?", n)
    digits = lambda n: F.coalesce(F.nullif(part(n), F.lit("")), F.lit("01"))
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", part(1), digits(2), digits(3)), "yyyy-MM-dd"))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Index file of ``term <tab or dash> references`` lines: ``term, references, primary_sources, see``.

    Section lines and blanks are skipped; of a term given twice the later line wins.
    """
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "value"))
    clean = F.trim(F.regexp_replace("value", r"[ \t]*(\t| — |—)[ \t]*", "\t"))
    rows = raw.select("ord", F.split(clean, "\t").alias("p")).where(F.size("p") >= 2)
    term, rest = F.trim(F.get("p", 0)), F.trim(F.get("p", 1))
    see = F.regexp_extract(rest, r"(?i)^see(?: also)? +(.+)$", 1)
    refs = F.filter(F.transform(F.split(rest, ","), F.trim), lambda x: x != "")
    primary = F.filter(F.transform(F.slice(refs, 1, 3), lambda r: F.regexp_extract(r, r"^([A-Z][A-Z0-9-]+)", 1)), lambda x: x != "")
    out = rows.select("ord", F.lower(term).alias("term"), F.when(see == "", refs).alias("references"), F.when(see == "", primary).alias("primary_sources"), F.when(see != "", see).alias("see"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("ord")))
    return out.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "ord")


def latex_log(spark: SparkSession, path: str) -> DataFrame:
    """Errors, missing files and packages and the page count of a LaTeX log, a row a log."""
    lines = spark.read.text(path).select(F.input_file_name().alias("log"), "value")
    return lines.groupBy("log").agg(
        F.array_compact(F.collect_list(F.when(F.startswith("value", F.lit("!")), F.trim(F.expr("substring(value, 2)"))))).alias("errors"),
        F.array_compact(F.collect_set(F.nullif(F.regexp_extract("value", r"File `([^']+)' not found", 1), F.lit("")))).alias("missing"),
        F.max(F.nullif(F.regexp_extract("value", r"Output written on .*\(([0-9]+) pages?", 1), F.lit("")).cast("int")).alias("pages"),
    )


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents under a declared schema; what does not parse stays in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """``n`` rows by hash order: the same ones in every run."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def clean_output(line: Column, length: int = 80) -> Column:
    """Progress line of a child process: ANSI codes and spinner frames cut."""
    out = F.regexp_replace(line, "\u001b\\[[0-9;]*[A-Za-z]", "")
    out = F.regexp_replace(out, "^[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏|/\\\\-]+ *", "")
    return F.substring(F.trim(F.regexp_replace(out, r"^\[PROGRESS\] *", "")), 1, length)

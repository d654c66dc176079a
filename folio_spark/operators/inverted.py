"""A stored inverted index for keyword search, read by query terms only.

An index is a folder with two tables.  ``postings``: a row a term and document block (up to ``block`` documents of one
input partition), its postings as arrays ordered by document, and what bounds their scores: the largest term frequency and
the smallest document length.  The table is partitioned by a hash of the term and sorted by term, so a query opens the
files of its terms and skips row groups by their statistics.  A posting is a place in its block and a frequency; ids and
lengths stand once a block, in rows without a term in a folder of their own.  ``segments``: documents and summed length of
each append, written last: what has no segment row does not exist.

A search reads the bounds first.  It scores the blocks of the highest bounds, takes the k-th score, and then only those
further blocks whose bound still reaches it (block-max pruning); the result is that of scoring everything.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio_spark.functions import text as tx
from folio_spark.functions.graph import cut, shared_folder

#: Documents of a block, and folders that terms are hashed to.
BLOCK = 512
BUCKETS = 32
#: Bytes of the stored table that one file of the postings stands for.
FILE_BYTES = 8 << 20


def query_terms(query: str) -> Counter:
    """Tokens of a query and how often each stands in it."""
    import regex

    return Counter(regex.findall(r"[\p{L}\p{N}_]{2,}", query.lower()))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def append(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, files: int = 1) -> None:
    """Index the rows of ``docs`` as a new segment, in ``files`` files a bucket.

    Every row is a document of its own; a null text is an empty one (it counts for the average length).  A failed append
    leaves postings without a segment row, which no search reads.  Texts never move, nor do frequencies a document: a block
    is a run of one input partition, so its task turns it into postings, which are shuffled once, to the files.
    """
    spark, segment = docs.sparkSession, uuid.uuid4().hex
    if block & (block - 1):
        raise ValueError("the documents of a block are a power of two")
    row = F.monotonically_increasing_id()  # the input partition, then the place in it
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.sort_array(tx.tokens(F.col(text_col))).alias("t")).withColumn("dl", F.size("t"))
    # Runs of equal tokens in sorted order: a document's frequencies without a shuffle.
    heads = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.where("dl > 0").withColumn("h", heads)
    terms, tfs = F.transform("h", lambda i: F.get("t", i)), F.transform("h", lambda i, k: F.coalesce(F.get("h", k + 1), F.col("dl")) - i)
    schema = T.StructType.fromDDL("term string, block long, n long, max_tf int, min_dl int, places array<int>, tfs array<int>, dls array<int>")
    schema.add("ids", T.ArrayType(docs.select(id_col).schema[0].dataType))
    blocks = rows.select("row", "id", "dl", terms.alias("terms"), tfs.alias("tfs")).mapInArrow(lambda batches: _blocks(batches, block), schema)
    bucket = F.when(F.col("term").isNull(), BUCKETS).otherwise(_bucket(F.col("term")))
    table = blocks.withColumns({"segment": F.lit(segment), "bucket": bucket})
    dealt = table.repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64("block"), F.lit(files))).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    mine = spark.read.schema(table.schema).parquet(f"{path}/postings").where((F.col("bucket") == BUCKETS) & (F.col("segment") == segment))
    length = mine.select(F.explode("dls").alias("dl")).agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
    stats = docs.agg(F.lit(segment).alias("segment"), F.count("*").alias("docs")).crossJoin(length)  # a row each
    stats.coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Postings of each block of rows that follow each other, ordered by term, and the block's documents."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column("row").to_numpy() // block
        starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for start, stop in zip(starts, starts[1:], strict=False):
            if start == stop:
                continue
            if held and held[0].column("row")[0].as_py() // block != number[start]:
                yield from _postings(held, block)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield from _postings(held, block)


def _postings(held: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    docs = pa.Table.from_batches(held).combine_chunks()
    column = lambda name: docs.column(name).combine_chunks()
    dl, lists = column("dl").to_numpy(), column("terms")
    number = column("row")[0].as_py() // block
    words = lists.flatten().dictionary_encode()
    rank = np.empty(len(words.dictionary), "int64")
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank[order] = np.arange(len(order))
    term = rank[words.indices.to_numpy()]
    by = np.argsort(term, kind="stable")  # documents stay in order within a term
    place = np.repeat(np.arange(len(docs), dtype="int32"), pc.list_value_length(lists).to_numpy())[by]
    tf = column("tfs").flatten().to_numpy()[by]
    n = np.bincount(term, minlength=len(order))
    ends = np.concatenate([[0], np.cumsum(n)])
    offsets, none = pa.array(ends, pa.int32()), lambda kind, size: pa.nulls(size, kind)
    ids = column("id")
    names = ["term", "block", "n", "max_tf", "min_dl", "places", "tfs", "dls", "ids"]
    postings = [
        words.dictionary.take(pa.array(order)), pa.array(np.full(len(n), number)), pa.array(n), pa.array(np.maximum.reduceat(tf, ends[:-1])), pa.array(np.minimum.reduceat(dl[place], ends[:-1]), pa.int32()),
        pa.ListArray.from_arrays(offsets, pa.array(place)), pa.ListArray.from_arrays(offsets, pa.array(tf)), none(pa.list_(pa.int32()), len(n)), none(pa.list_(ids.type), len(n)),
    ]
    yield pa.RecordBatch.from_arrays(postings, names)
    whole, many = pa.array([0, len(docs)], pa.int32()), none(pa.list_(pa.int32()), 1)
    documents = [none(pa.string(), 1), pa.array([number], pa.int64()), pa.array([len(docs)], pa.int64()), none(pa.int32(), 1), none(pa.int32(), 1), many, many, pa.ListArray.from_arrays(whole, pa.array(dl)), pa.ListArray.from_arrays(whole, ids)]
    yield pa.RecordBatch.from_arrays(documents, names)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return len(spark.read.parquet(f"{path}/segments").columns) > 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def files_for(size: int) -> int:
    """Files of a bucket for a table of ``size`` bytes: what one task writes does not grow with the table."""
    return max(1, -(-size // (BUCKETS * FILE_BYTES)))


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """The index of a table of files in the shared folder; built where there is none for these files as they are now.

    Names, sizes and times of the files make its name, so a changed table gets a new index.
    """
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")), F.sum("file_size")).first()
    path = f"{shared_folder(spark)}/keyword-blocks-{mark[0]}-{str(mark[1]).replace('-', 'm')}-{id_col}-{text_col}"
    if not exists(spark, path):
        append(docs, path, id_col, text_col, files=files_for(mark[2] or 0))
    return path


@dataclass
class Search:
    """Hits ``id, score`` and what was read: blocks and postings of the query's terms, and how many were scored."""

    hits: DataFrame
    blocks: int
    scored_blocks: int
    postings: int
    scored_postings: int


def search(spark: SparkSession, path: str, query: str, k: int | None = 10, k1: float = 1.5, b: float = 0.75, first: int = 8) -> Search:
    """BM25 over a stored index: the best ``k`` documents with a score above 0, ties by id (None: all of them).

    ``first`` blocks of the highest bounds are scored to get a threshold.  The driver sees one number a query term and
    the threshold.  Query tokens count as often as they stand in the query; terms that the index lacks score nothing.
    """
    wanted = query_terms(query)
    terms = sorted(wanted)
    segments = spark.read.parquet(f"{path}/segments")
    names = [r["segment"] for r in segments.select("segment").collect()]  # one an append
    n, length = segments.agg(F.sum("docs"), F.sum("length")).first()
    average = (length / n if n else 0) or 1.0
    if not length:
        return Search(spark.createDataFrame([], "id long, score double"), 0, 0, 0, 0)
    postings = spark.read.parquet(f"{path}/postings")
    probe = spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select("term", _bucket(F.col("term")).alias("bucket"))
    buckets = sorted({r["bucket"] for r in probe.collect()})
    mine = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms) & F.col("segment").isin(names))
    documents = postings.where((F.col("bucket") == BUCKETS) & F.col("segment").isin(names)).select("segment", "block", "ids", "dls")
    mine = mine.drop("ids", "dls")
    heads = mine.select("term", "segment", "block", "n", "max_tf", "min_dl")
    found = {r["term"]: (r["df"], r["blocks"]) for r in heads.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks")).collect()}
    weight = {t: wanted[t] * _idf(n, found[t][0]) for t in terms if t in found}
    if not weight:
        none = postings.select(F.explode("ids").alias("id"), F.lit(0.0).alias("score")).limit(0)
        return Search(none, 0, 0, 0, 0)
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]), F.col("term"))

    def part(tf, dl):
        return w * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / average))

    def scored(rows: DataFrame) -> DataFrame:
        one = rows.join(documents, ["segment", "block"]).select("term", "segment", "block", "ids", "dls", F.explode(F.arrays_zip("places", "tfs")).alias("x"))
        at = F.col("x.places")
        score = F.sum(part(F.col("x.tfs"), F.get("dls", at))).alias("score")
        return one.groupBy("segment", "block", at.alias("place"), F.get("ids", at).alias("id")).agg(score).select("id", "score").where("score > 0")

    total_blocks, total_postings = sum(x[1] for x in found.values()), sum(x[0] for x in found.values())
    if k is None:
        return Search(scored(mine), total_blocks, total_blocks, total_postings, total_postings)
    # Rounding must not put a bound below a score that it bounds.
    bounds = cut(heads.groupBy("segment", "block").agg((F.sum(part(F.col("max_tf"), F.col("min_dl"))) * (1 + 1e-9)).alias("bound"), F.sum("n").alias("n"), F.count("*").alias("terms")))
    order = [F.desc("bound"), F.asc("segment"), F.asc("block")]
    start = bounds.orderBy(*order).limit(first).select("segment", "block")
    best = scored(mine.join(F.broadcast(start), ["segment", "block"], "left_semi")).orderBy(F.desc("score"), "id").limit(k).agg(F.count("*"), F.min("score")).first()
    keep = bounds if best[0] < k else bounds.where(F.col("bound") >= best[1])
    read = keep.agg(F.sum("terms"), F.sum("n")).first()
    hits = scored(mine.join(keep.select("segment", "block"), ["segment", "block"], "left_semi")).orderBy(F.desc("score"), "id").limit(k)
    return Search(hits, total_blocks, read[0] or 0, total_postings, read[1] or 0)


def _idf(n: int, df: int) -> float:
    from math import log

    return log(1 + (n - df + 0.5) / (df + 0.5))

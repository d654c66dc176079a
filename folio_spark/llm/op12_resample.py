"""Resampling documents towards a target corpus, by a dictionary of distinct n-gram strings.

1. Texts are cut into blocks.  A block lists its distinct n-grams once each, with the documents they stand in and how often.
2. The n-grams of all blocks meet by a hash of their words.  There each string of the whole corpus stands once: its counts
   are added up and it is hashed once, to its bucket.  Buckets and per-document counts are stored without the strings.
3. Bucket counts give the gains, one number a bucket.  They are joined to the stored per-document counts, added up where
   these lie, and the sums meet by block.
4. Documents are drawn by Gumbel noise on the weights: the largest scores, ranked exactly over ranges of the order.

A string enters step 2 once a block however common it is, and its hash spreads it, so no word makes a hot task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import cut, lean, table
from folio_spark.llm.bytesops import Words, chunks, mix
from folio_spark.llm.ranks import range_ranks

#: Bytes of text of a block (one longer text is a block of its own) and of text whose strings meet in one group.
BLOCK_BYTES = 4 << 20
PART_BYTES = 16 << 20
#: Bytes between words: ASCII but for digits and (lower-cased) letters.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
#: Level 6 packs the sorted strings a tenth smaller than level 1 and still at some 20 MB a second.
_CODEC = pa.Codec("zstd", compression_level=6)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A row holds either the documents of a block (``ids``, ``n_words``, ``n_features``) or those of its strings that hash to
#: ``part``: their bytes and lengths, in how many documents of the block each stands, which ones, and how often.
BLOCK_SCHEMA = "side int, block long, part int, ids array<long>, n_words array<long>, n_features array<long>, strings binary, sizes binary, spread binary, docs binary, times binary"
GRAMS = pa.schema(
    [("side", pa.int32()), ("block", pa.int64()), ("part", pa.int32())]
    + [(c, pa.list_(pa.int64())) for c in ("ids", "n_words", "n_features")]
    + [(c, pa.binary()) for c in ("strings", "sizes", "spread", "docs", "times")]
)


def _pack(a: np.ndarray) -> bytes:
    """Compressed bytes, or 32-bit numbers plane by plane: equal high bytes then stand side by side."""
    if a.dtype != np.uint8:
        if len(a) and int(a.max()) >= 1 << 32:
            raise ValueError("a block counts over 4,294,967,295 of one feature")
        a = a.astype("<u4").view(np.uint8).reshape(-1, 4).T
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _raw(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    return np.frombuffer(_CODEC.decompress(b[8:], size, asbytes=True) if size else b"", np.uint8)


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_raw(b).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _strings(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array that starts at its buffers' start."""
    off = np.frombuffer(a.buffers()[1], np.int64)[: len(a) + 1]
    raw = a.buffers()[2]
    return off, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def block_features(data: np.ndarray, offsets: np.ndarray, max_n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram strings of a block, their hashes, every occurrence as ``(feature, document)``, and words a document."""
    w = Words(data, offsets, BREAKS)
    docs = len(offsets) - 1
    n_words = np.diff(np.append(w.first[:docs], len(w.start)))
    doc = np.repeat(np.arange(docs), n_words)
    sizes = w.end - w.start
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    words = _strings(sizes, w.data[np.cumsum(inside[:-1]).astype(bool)]).dictionary_encode()
    # In the order of the words: n-grams then ascend, too, and neighbours share their beginnings.
    order = np.asarray(pc.sort_indices(words.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    vocab, code = words.dictionary.take(pa.array(order)), rank[np.asarray(words.indices)]
    hashes = np.zeros(len(vocab), np.uint64)
    hashes[code] = w.hash
    strings, marks, owners, hashed = [vocab], [code], [doc], [hashes]
    grams, at, prev, gram_hash, total = vocab, np.arange(len(code)), code, hashes, len(vocab)
    for n in range(2, max_n + 1):
        ok = at + n - 1 < len(code)
        ok[ok] = doc[at[ok]] == doc[at[ok] + n - 1]
        at, prev = at[ok], prev[ok]
        keys, prev = np.unique(prev * np.int64(max(len(vocab), 1)) + code[at + n - 1], return_inverse=True)
        head, tail = keys // max(len(vocab), 1), keys % max(len(vocab), 1)
        grams = pc.binary_join_element_wise(grams.take(pa.array(head)), vocab.take(pa.array(tail)), pa.scalar(" ", pa.large_string()))
        gram_hash = mix(gram_hash[head] * _ODD + hashes[tail])
        strings.append(grams)
        hashed.append(gram_hash)
        marks.append(prev + total)
        owners.append(doc[at])
        total += len(keys)
    return pa.concat_arrays(strings), np.concatenate(hashed), np.concatenate(marks), np.concatenate(owners), n_words


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _blocks(texts: DataFrame, side: int, parts: int, max_n: int) -> DataFrame:
    """``texts(id, text)`` as packed blocks (``BLOCK_SCHEMA``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), BLOCK_BYTES):
                block = seq * 2 + side
                seq += 1
                strings, hashes, marks, owners, n_words = block_features(data, offsets, max_n)
                if side == 0:
                    ids = batch.column(0).slice(i, j - i).cast(pa.int64()).to_pylist()
                    yield _rows([(side, block, block % parts, ids, n_words.tolist(), np.bincount(owners, minlength=j - i).tolist(), *[None] * 5)], GRAMS)
                part = (hashes % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                off, raw = _bytes_of(pa.concat_arrays([strings.take(pa.array(order))]))
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                del strings, hashes, part, order
                # A cell is a string in a document; cells ascend by string.
                cells, times = np.unique(place[marks] * np.int64(j - i) + owners, return_counts=True)
                del place, marks, owners
                feature, docs = np.divmod(cells, np.int64(j - i))
                spread = np.bincount(feature, minlength=len(off) - 1)
                cell_edges = np.searchsorted(feature, edges)
                rows = []
                for p in np.flatnonzero(np.diff(edges)):
                    (a, b), (c, d) = edges[p : p + 2], cell_edges[p : p + 2]
                    packed = [_pack(x) for x in (raw[off[a] : off[b]], np.diff(off[a : b + 1]), spread[a:b], docs[c:d], times[c:d])]
                    rows.append((side, block, int(p), None, None, None, *packed))
                    if len(rows) == 256:
                        yield _rows(rows, GRAMS)
                        rows = []
                if rows:
                    yield _rows(rows, GRAMS)

    return texts.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), BLOCK_SCHEMA)


#: Rows of three sorts: a block's documents, what they hold of one part's strings as counts of buckets, and a part's bucket counts.
FOUND_SCHEMA = "block long, ids array<long>, n_words array<long>, n_features array<long>, found binary, spread binary, docs binary, times binary, sums array<struct<bucket:long,s:long,t:long>>"
FOUND = pa.schema(
    [("block", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("ids", "n_words", "n_features")]
    + [(c, pa.binary()) for c in ("found", "spread", "docs", "times")]
    + [("sums", pa.list_(pa.struct([("bucket", pa.int64()), ("s", pa.int64()), ("t", pa.int64())])))]
)


def _by_document(bucket: np.ndarray, docs: np.ndarray, times: np.ndarray, buckets: int) -> list[bytes]:
    """Cells by document and bucket, packed: gaps of buckets within a document, cells a document, gaps of documents, counts."""
    keys, at = np.unique(docs * np.int64(buckets) + bucket, return_inverse=True)
    doc, bucket = np.divmod(keys, np.int64(buckets))
    found, first, cells = np.unique(doc, return_index=True, return_counts=True)
    gaps = np.diff(bucket, prepend=0)
    gaps[first] = bucket[first]
    return [_pack(gaps), _pack(cells), _pack(np.diff(found, prepend=0)), _pack(np.bincount(at, times).astype(np.int64))]


def _dictionary(grams: DataFrame, buckets: int) -> DataFrame:
    """One group a part: every distinct string stands once, is hashed once, and gives its bucket to the blocks that hold it."""

    def run(group: pa.Table) -> pa.Table:
        given = group.to_pylist()
        rows = [(r["block"], r["ids"], r["n_words"], r["n_features"], *[None] * 5) for r in given if r["ids"] is not None]
        given = [r for r in given if r["ids"] is None]
        if given:
            sizes, spread = [_numbers(r["sizes"]) for r in given], [_numbers(r["spread"]) for r in given]
            # How often each string of each block stands there: its cells' counts.
            counts = np.concatenate([np.add.reduceat(_numbers(r["times"]), np.cumsum(n) - n) for r, n in zip(given, spread)])
            words = _strings(np.concatenate(sizes), np.concatenate([_raw(r["strings"]) for r in given])).dictionary_encode()
            code, off, raw = np.asarray(words.indices), *_bytes_of(words.dictionary)
            view = memoryview(raw)
            bucket = np.fromiter((zlib.crc32(view[a:b]) % buckets for a, b in zip(off[:-1].tolist(), off[1:].tolist())), np.int64, len(words.dictionary))
            side = np.repeat([r["side"] for r in given], [len(x) for x in sizes])
            sums = np.zeros((2, buckets), np.int64)
            np.add.at(sums, (side, bucket[code]), counts)
            rows.append((*[None] * 8, [{"bucket": int(k), "s": int(sums[0][k]), "t": int(sums[1][k])} for k in np.flatnonzero(sums.any(0))]))
            at = 0
            for r, n, wide in zip(given, sizes, spread):
                if r["side"] == 0:
                    rows.append((r["block"], None, None, None, *_by_document(np.repeat(bucket[code[at : at + len(n)]], wide), _numbers(r["docs"]), _numbers(r["times"]), buckets), None))
                at += len(n)
        return pa.Table.from_batches([_rows(rows, FOUND)]) if rows else FOUND.empty_table()

    return grams.groupBy("part").applyInArrow(run, FOUND_SCHEMA)


def _join_gains(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """Gains joined to the cells -> ``block, docs, gained``: what the strings of a row give each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, gained = [], []
            for r in batch.select(["found", "spread", "docs", "times"]).to_pylist():
                gaps, cells = _numbers(r["found"]), _numbers(r["spread"])
                first = np.cumsum(cells) - cells
                ends = np.cumsum(gaps)
                bucket = ends - np.repeat(ends[first] - gaps[first], cells)
                docs = np.cumsum(_numbers(r["docs"]))
                total = np.add.reduceat(gains[bucket] * _numbers(r["times"]), first)
                docs_of.append(docs)
                gained.append(total)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(docs_of, kind), pa.array(gained, kind)], ["block", "docs", "gained"])

    return found.select("block", "found", "spread", "docs", "times").mapInArrow(lean(run), "block long, docs array<long>, gained array<long>")


def _weigh(documents: DataFrame, gained: DataFrame) -> DataFrame:
    """One group a block: its documents with the means of what their features gained."""
    schema = pa.schema([(c, pa.int64()) for c in ("id", "n_words", "n_features", "weight")])

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        doc = next(r for r in rows if r["ids"] is not None)
        n = np.array(doc["n_features"], np.int64)
        total = np.zeros(len(n), np.int64)
        for r in rows:
            if r["docs"] is not None:
                total[r["docs"]] += np.array(r["gained"], np.int64)
        return pa.Table.from_arrays([pa.array(doc["ids"], pa.int64()), pa.array(doc["n_words"], pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))], schema=schema)

    rows = documents.select("block", "ids", "n_words", "n_features").unionByName(gained, allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(run, "id long, n_words long, n_features long, weight long")


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = 2, buckets: int = 10_000) -> DataFrame:
    """Mean gain of each document's n-grams towards ``target`` -> ``id, n_words, n_features, weight``.

    Words are runs of bytes outside ASCII punctuation, blanks and controls, with A-Z lower-cased; features all runs of 1
    to ``max_n`` words, repeats counted, bucketed by the crc32 of their UTF-8 bytes.  A bucket with ``s`` of the documents'
    ``S`` features and ``t`` of the target's ``T`` gains ``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))``.

    The driver sees the table of gains, ``buckets`` numbers.  Edge cases: a null or empty text has no features and weight
    0; null and repeated ids are rows like others; an empty target or documents table is one without features; further
    columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    aims = target.select(F.lit(None).cast("long").alias("id"), F.col(target_col).alias("text"))
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-size // PART_BYTES))
    grams = _blocks(texts, 0, parts, max_n).unionByName(_blocks(aims, 1, parts, max_n))
    stored = cut(_dictionary(grams, buckets))
    sums = stored.where("sums IS NOT NULL").select(F.explode("sums").alias("x")).groupBy("x.bucket").agg(F.sum("x.s").cast("double").alias("s"), F.sum("x.t").cast("double").alias("t"))
    sums = cut(sums)
    all_s, all_t = (float(x or 0) for x in sums.agg(F.sum("s"), F.sum("t")).first())
    gain = F.floor(1000 * F.log((F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))))
    gains = np.zeros(buckets, np.int64)
    for bucket, g in sums.select("bucket", gain.cast("long")).collect():
        gains[bucket] = g
    return _weigh(stored.where("ids IS NOT NULL"), _join_gains(stored.where("found IS NOT NULL"), gains))


def gumbel_score(weight: Column, id: Column, seed: int) -> Column:
    """``weight`` plus Gumbel noise in thousandths that depends on the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weights: DataFrame, share: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Rank the ``share`` per cent of the documents of at least ``min_words`` words whose scores are highest.

    Adds ``score`` and ``rank`` (from 1; null if not drawn) to ``id, n_words, n_features, weight``.  Ties go to the smaller
    id, a null id before all; equal rows take ranks of their own.  Rows are ranked within ranges of the order after equal
    ones were counted together, so ties don't gather in a task.
    """
    scored = cut(weights.withColumn("score", gumbel_score(F.col("weight"), F.col("id"), seed)))
    able = scored.where(F.col("n_words") >= min_words)
    k = share * able.count() // 100
    alike = able.groupBy("id", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("_n"))
    ranked = range_ranks(alike, [F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("n_words")], "_n")
    each = ranked.withColumn("_r", F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + F.col("_n"))))
    each = each.select(*scored.columns, F.when(F.col("_r") <= k, F.col("_r")).alias("rank"))
    return each.unionByName(scored.where(~(F.col("n_words") >= min_words)).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, all columns kept (rows of one id are drawn together, a null id never)."""
    drawn = draw(importance_weights(docs, target, id_col, text_col), share, min_words, seed).where("rank IS NOT NULL")
    return docs.join(drawn.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards ``benchmark``, score and rank of the draw."""
    weights = importance_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(weights).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY k) AS v FROM (
    SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS k))),
words AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 1, 0, NULL, text FROM benchmark)),
grams AS (
  SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
dictionary AS (
  SELECT f, s, d.t, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(b) // 2 + 1), lambda i: ('0x' || substr(b, 2 * i - 1, 2))::BIGINT)),
    lambda c, x: xor(crc.v[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS b, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM grams GROUP BY f) d, crc),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM dictionary GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM buckets),
means AS (
  SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM grams JOIN dictionary USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN means USING (row) WHERE side = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS r, count(*) FILTER (WHERE able) OVER () AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * total // 100 THEN r END AS rank FROM ranked
"""

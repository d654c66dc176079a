"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only where a word position is the minimiser of its window of seed hashes, so
any passage of ``min_words`` words keeps the same suffixes wherever it stands.  Suffixes whose
seed occurs once are dropped.  Those of equal words all around are one class, which its first
place stands for.  Where a seed has several classes, each passage of ``min_words`` words that a
suffix is the minimiser of, cut into the words before and after the seed, meets the same passage
of the other classes; the earliest place of it marks the later ones, so the first copy of every
passage stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import cut, free_shuffles, id_filter, map_texts, may_hold, table, unused
from folio_spark.llm.bytesops import _ODD, Words, chunks, mix

MIN_WORDS = 50
#: Suffixes that a task cuts into passages at a time.
SLAB = 40_000
#: Bytes of a word's hash that surroundings are compared by; a false match takes 25 equal words at its seed and 48 equal bits beside it.
WIDTH = 6
#: Bits of the seed filter at most (16 MB).
SEED_BITS = 1 << 27


def _slide(a: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over each run of ``n``: result[i] covers a[i : i + n]."""
    out, width = a, 1
    while width * 2 <= n:
        out = op(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indices and seed hashes of the kept suffixes of a chunk, and the least seed hash of the passage from each word (0 if it leaves the row).

    Seeds are ``min_words // 2`` words; a window holds as many seeds as fit in ``min_words`` words.
    All positions that tie for the minimum are kept, which depends on the words alone.
    """
    k = min_words // 2
    width = min_words - k + 1
    total = len(words.hash)
    if total < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = words.grams(k)
    low = _slide(g, width, np.minimum)  # low[q]: minimum of the window from q, a passage of min_words words
    row_end = np.repeat(words.first[1:], np.diff(words.first))[: len(low)]
    inside = np.arange(len(low)) + min_words <= row_end
    low = np.where(inside, low, 0)
    # Position p is the minimiser of some window iff the largest minimum among its windows is its own hash.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high = _slide(padded, width, np.maximum)[: len(g)]
    at = np.flatnonzero((high == g) & (high > 0))
    return at, g[at], low


def _splits(at: np.ndarray, seeds: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest and most words before each suffix in the passages that it is the minimiser of; what lies between are such passages, too."""
    fewest, most = np.full(len(at), width, np.int32), np.full(len(at), -1, np.int32)
    for n in range(width):
        q = at - n
        ok = (q >= 0) & (q < len(low))
        ok[ok] = low[q[ok]] == seeds[ok]
        most[ok] = n
        fewest[ok] = np.minimum(fewest[ok], n)
    return fewest, most


def _anchor_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in chunks(batch.column(1)):
                _, seeds, _ = anchors(Words(data, off), min_words)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64))], ["seed"])

    return run


def _context_rows(min_words: int, packed):
    """Suffixes whose seed may repeat, with the words before them (nearest first) and after their seed, six bytes a word."""
    k = min_words // 2
    reach = min_words - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = packed.value
        for batch in batches:
            ids = batch.column(0)
            for first_row, _, data, off in chunks(batch.column(1)):
                w = Words(data, off)
                at, seeds, low = anchors(w, min_words)
                hold = may_hold(bits, seeds.view(np.int64))
                at, seeds = at[hold], seeds[hold]
                fewest, most = _splits(at, seeds, low, reach + 1)
                row = np.searchsorted(w.first, at, "right") - 1
                lo, hi = w.first[row], w.first[row + 1]
                short = w.hash.view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                n_left = np.minimum(at - lo, reach)
                n_right = np.minimum(hi - at - k, reach)
                take = pa.array(first_row + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        pa.array((at - lo).astype(np.int32)),
                        pa.array(seeds.view(np.int64)),
                        _runs(short, at - 1, n_left, -1),
                        _runs(short, at + k, n_right, 1),
                        pa.array(fewest),
                        pa.array(most),
                    ],
                    ["id", "pos", "seed", "before", "after", "fewest", "most"],
                )

    return run


def _runs(values: np.ndarray, start: np.ndarray, length: np.ndarray, step: int) -> pa.Array:
    """Binary column of ``length`` values from each ``start``, forwards or backwards."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(start, length) + step * (np.arange(total) - np.repeat(ends - length, length))
    off = np.concatenate([[0], ends * values.shape[1]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values[at]).tobytes())])


def _prefixes(column: list[bytes], width: int) -> np.ndarray:
    """Hashes of the first 0 to ``width`` words of the rows."""
    m = np.zeros((len(column), width, 8), np.uint8)
    m[:, :, :WIDTH] = np.frombuffer(b"".join(x.ljust(width * WIDTH, b"\0") for x in column), np.uint8).reshape(len(column), width, WIDTH)
    m = m.view(np.uint64)[:, :, 0]
    out = np.zeros((len(column), width + 1), np.uint64)
    for i in range(width):
        out[:, i + 1] = (out[:, i] + m[:, i] + np.uint64(1)) * _ODD
    return mix(out)


def _passage_rows(min_words: int):
    """A row for each passage that a suffix is the minimiser of: its hash, the suffix and the words before it."""
    reach = min_words - min_words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLAB):
                part = batch.slice(i, SLAB)
                seed = np.asarray(part.column(3)).view(np.uint64)
                fewest, most = np.asarray(part.column(6)), np.asarray(part.column(7))
                before, after = _prefixes(part.column(4).to_pylist(), reach), _prefixes(part.column(5).to_pylist(), reach)
                for n in range(reach + 1):
                    at = np.flatnonzero((fewest <= n) & (n <= most))
                    if len(at):
                        key = mix(mix(mix(seed[at] + np.uint64(n)) + before[at, n]) + after[at, reach - n])
                        take = pa.array(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), *(part.column(c).take(take) for c in range(3)), pa.array(np.full(len(at), n, np.int32))],
                            ["passage", "words", "id", "pos", "n"],
                        )

    return run


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of each row, sorted by start, as disjoint spans; one pass over them, however many a document has."""
    for batch in batches:
        for i in range(batch.num_rows):
            start, stop, source, at = (np.asarray(batch.column(c)[i].values) for c in range(1, 5))
            reach = np.maximum.accumulate(stop)
            first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))
            longest = np.lexsort((np.arange(len(start)), start - stop, group))[first]  # of equally long ones the first
            columns = [pa.array(x) for x in (start[first], np.maximum.reduceat(stop, first), source[longest], at[longest])]
            spans = pa.StructArray.from_arrays(columns, ["start", "stop", "source_id", "source_start"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), batch.column(0)[i].as_py())), spans], ["id", "s"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start_word, end_word, n_words, source_id, source_word``: merged spans of words that an earlier document holds too.

    Words are case-folded over A-Z; "earlier" is by id, and with ``within`` also by position in one document.  Every removed word stays
    somewhere: a span is only marked against an earlier copy.  Rows without an integral id or
    text, and texts of fewer than ``min_words`` words, have none; rows of one id count as one
    document; an empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    seeds = map_texts(src, _anchor_rows(min_words), "seed long")
    repeated = cut(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select(F.col("seed").alias("id")))
    bits = 1 << 16
    while bits < SEED_BITS and bits < 16 * repeated.count():
        bits <<= 1
    packed = docs.sparkSession.sparkContext.broadcast(id_filter(repeated, bits))
    suffixes = map_texts(src, _context_rows(min_words, packed), "id long, pos int, seed long, before binary, after binary, fewest int, most int")
    # Suffixes of equal words all around are one class: its first stands for it, the others are copies of the first.
    # Classes are aggregated before they are shuffled, so a passage in a third of all documents costs a row a task.
    k = min_words // 2
    before, after = F.length("before") / WIDTH, F.length("after") / WIDTH
    suffixes = suffixes.where(before + after + k >= min_words).withColumn("words", F.xxhash64("seed", "before", "after"))
    first = F.min(F.struct("id", "pos")).alias("f")
    classes = cut(suffixes.groupBy("words").agg(first, *(F.first(c).alias(c) for c in ("seed", "before", "after", "fewest", "most"))))
    free_shuffles(docs.sparkSession)
    narrow = suffixes.select("words", "id", F.col("pos").cast("long").alias("pos"), before.cast("long").alias("nb"), after.cast("long").alias("na"))
    f_id, f_pos = F.col("f.id"), F.col("f.pos").cast("long")
    later = (F.struct("id", "pos") > F.struct(f_id, f_pos)) if within else (F.col("id") > f_id)
    # Further places of a class in its head's own document are no copies of an earlier one, but what the head repeats they repeat.
    own = (F.col("id") == f_id) & (F.col("pos") != f_pos) & F.lit(not within)
    places = cut(narrow.join(classes.select("words", "f"), "words").where(later | own))
    free_shuffles(docs.sparkSession)
    copies = places.where(later).select("id", (F.col("pos") - F.col("nb")).alias("start"), (F.col("pos") + k + F.col("na")).alias("stop"), f_id.alias("source_id"), (f_pos - F.col("nb")).alias("source_start"))
    # Classes of one seed meet in the passages they share; the earliest place of each passage marks the others.
    several = classes.groupBy("seed").agg(F.count("*").alias("n"), F.min("f.id").alias("a"), F.max("f.id").alias("b")).where(F.col("n") > 1 if within else F.col("a") < F.col("b"))
    heads = classes.join(several.select("seed"), "seed", "left_semi").select("words", f_id.alias("id"), F.col("f.pos").alias("pos"), "seed", "before", "after", "fewest", "most")
    passages = map_texts(heads, _passage_rows(min_words), "passage long, words long, id long, pos int, n int")
    firsts = passages.groupBy("passage").agg(first, F.max(F.struct("id", "pos")).alias("l")).where("l > f" if within else "l.id > f.id").select("passage", "f")
    met = passages.join(firsts, "passage").where(F.struct("id", "pos") > F.col("f") if within else F.col("id") > f_id)
    # Passages of a suffix that one place marks lie side by side: all between the first and the last are found there, too.
    runs = met.groupBy("words", "id", "pos", "f").agg(F.min("n").alias("fewest"), F.max("n").alias("most"))
    start, stop = (F.col("pos") - F.col("most")).cast("long"), (F.col("pos") - F.col("fewest") + min_words).cast("long")
    found = cut(runs.select("id", start.alias("start"), stop.alias("stop"), f_id.alias("source_id"), (f_pos - F.col("most")).alias("source_start"), "words"))
    free_shuffles(docs.sparkSession)
    shifted = found.join(places.where(own).select("words", (F.col("pos") - f_pos).alias("shift")), "words")
    shifted = shifted.select("id", (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"), "source_id", "source_start")
    marks = found.drop("words").unionByName(shifted).unionByName(copies)
    # Overlapping marks of a document become one span; the source is that of its longest mark.
    merged = marks.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "source_id", "source_start"))).alias("m"))
    merged = merged.select("id", *[F.col(f"m.{c}").alias(c) for c in ("start", "stop", "source_id", "source_start")])
    spans = map_texts(merged, _merge_marks, "id long, s struct<start:long,stop:long,source_id:long,source_start:long>")
    return spans.select(
        F.col("id").alias(id_col),
        F.col("s.start").alias("start_word"),
        F.col("s.stop").alias("end_word"),
        (F.col("s.stop") - F.col("s.start")).alias("n_words"),
        F.col("s.source_id").alias("source_id"),
        F.col("s.source_start").alias("source_word"),
    )


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans (ascending, disjoint) and the white space after them."""
    if text is None or not spans:
        return text
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        if a < len(w.start):
            keep[w.start[a] : w.start[b] if b < len(w.start) else len(raw)] = False
    return raw[keep].tobytes().decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated passages, ``n_chars`` made anew; rows left without any word go, rows not touched stay as they are.

    Rows of a null id or text stay; repeated rows of an id lose the same passages; an empty table
    stays empty; further columns are carried along, whatever their names.
    """
    key, held = unused("span_id", docs.columns), unused("spans", docs.columns)
    spans = repeated_spans(docs, min_words).groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias(held))
    names = docs.columns
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col(key), "left").select(*[F.col(f"`{c}`") for c in names], held)
    t, c = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                cols = list(part.columns)
                spans_of = cols.pop().to_pylist()
                touched = [k for k, s in enumerate(spans_of) if s]
                if touched:
                    texts = cols[t].to_pylist()
                    for k in touched:
                        texts[k] = cut_spans(texts[k], [(s["start_word"], s["end_word"]) for s in spans_of[k]])
                    cols[t] = pa.array(texts, pa.string())
                    if c is not None:
                        sizes = cols[c].to_pylist()
                        for k in touched:
                            sizes[k] = len(texts[k])
                        cols[c] = pa.array(sizes, cols[c].type)
                    gone = {k for k in touched if not texts[k].strip()}
                    if gone:
                        stay = pa.array([k not in gone for k in range(part.num_rows)])
                        cols = [x.filter(stay) for x in cols]
                yield pa.RecordBatch.from_arrays(cols, names)

    return map_texts(joined, run, docs.schema)


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))

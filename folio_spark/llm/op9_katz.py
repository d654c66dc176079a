"""Language-model scoring by Katz backoff.

Counts of words and word pairs are Good-Turing discounted where they are small; the mass that
the seen pairs of a history give up goes to the other words in proportion to their own
probability, with exactly normalised backoff weights.  The model is a set of tables partitioned
by word hash: words (count, probability), histories (count, backoff weight), pairs (probability).
A token is scored recursively: the pair's own probability if seen, else the history's weight
times the word's, a history never seen weighing one; unknown words share one probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import cut, lean, table
from folio_spark.llm.bytesops import Words, chunks

#: Hashes of the end of a text, which is a token, and of the start, which is only a history.
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Counts above this are not discounted.
RELIABLE = 5


def good_turing(counts: dict[int, int], k: int = RELIABLE) -> list[float]:
    """Discount factors of counts 1 to ``k`` from the numbers of types seen r times.

    Where the counts of counts do not support Good-Turing (a gap, or a factor outside 0 to 1),
    the factor falls back to absolute discounting by half of a count.
    """
    n = [counts.get(r, 0) for r in range(k + 2)]
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, k + 1):
        d = math.nan
        if n[r] and n[r + 1] and tail < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discount(c: Column, d: list[float]) -> Column:
    out = F.lit(1.0)
    for r, x in enumerate(d, 1):
        out = F.when(c == r, F.lit(x)).otherwise(out)
    return out


def pair_rows(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """``id, train, h1, h2, n``: every row's distinct word pairs with their counts; the first word follows START, END comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, off in chunks(batch.column(2)):
                w = Words(data, off)
                rows = last - first
                n = np.diff(w.first)
                # END goes behind each row's words; START before them.
                h2 = np.insert(w.hash, w.first[1:], END)
                row = np.repeat(np.arange(rows), n + 1)
                h1 = np.empty_like(h2)
                h1[1:] = h2[:-1]
                h1[np.concatenate([[0], np.cumsum(n + 1)[:-1]])] = START
                order = np.lexsort((h2, h1, row))
                row, h1, h2 = row[order], h1[order], h2[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(row)))
                take = pa.array(first + row[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(count.astype(np.int32))],
                    ["id", "train", "h1", "h2", "n"],
                )

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("t"))
    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, train boolean, h1 long, h2 long, n int")


@dataclass
class Katz:
    """Model tables and the few numbers they share."""

    words: DataFrame  # h, c, p
    histories: DataFrame  # h, weight
    pairs: DataFrame  # h1, h2, p
    tokens: int
    types: int
    unknown: float


def train_katz(pairs: DataFrame) -> Katz:
    """Build the tables from ``pair_rows``; only training rows count.  Without training tokens all words are unknown, with probability 1."""
    seen = pairs.where("train")
    bi = cut(seen.groupBy("h1", "h2").agg(F.sum("n").alias("c")).repartition("h1"))
    uni = cut(bi.groupBy(F.col("h2").alias("h")).agg(F.sum("c").alias("c")))
    total, types = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    small = lambda df: {r.c: r.n for r in df.where(F.col("c") <= RELIABLE + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    d1, d2 = good_turing(small(uni)), good_turing(small(bi))
    n = max(total, 1)
    words = uni.withColumn("p", _discount(F.col("c"), d1) * F.col("c") / n)
    mass = words.agg(F.sum("p")).first()[0] or 0.0
    unknown = 1.0 - mass
    if unknown < 0.5 / n:  # no count was small: room for unknown words is made by one more token
        words = words.withColumn("p", F.col("p") * (n / (n + 1.0) / mass)) if mass else words
        unknown = 1.0 / (n + 1.0) if mass else 1.0
    words = cut(words)
    # A history whose pairs give up nothing makes room for others by one more count.
    disc = _discount(F.col("c"), d2) * F.col("c")
    hist = bi.groupBy("h1").agg(F.sum("c").alias("ch"), F.sum(disc).alias("kept"))
    hist = hist.select("h1", F.when(F.col("kept") > F.col("ch") - 1e-6, F.col("ch") + 1).otherwise(F.col("ch")).alias("ch"))
    probs = bi.join(hist, "h1").select("h1", "h2", (disc / F.col("ch")).alias("p"))
    probs = cut(probs)
    given = probs.join(words.select(F.col("h").alias("h2"), F.col("p").alias("pw")), "h2").groupBy("h1").agg(F.sum("p").alias("kept"), F.sum("pw").alias("covered"))
    weights = cut(given.select(F.col("h1").alias("h"), ((1.0 - F.col("kept")) / F.greatest(1.0 - F.col("covered"), F.lit(unknown))).alias("weight")))
    return Katz(words, weights, probs, total, types, unknown)


def score_texts(pairs: DataFrame, model: Katz) -> DataFrame:
    """``id, train, n_tokens, n_known, base_score, score`` of every id of ``pair_rows``."""
    lift = model.tokens + 0.5 * (model.types + 1)
    rows = (
        pairs.join(model.pairs.withColumnRenamed("p", "pp"), ["h1", "h2"], "left")
        .join(model.words.select(F.col("h").alias("h2"), "c", F.col("p").alias("pw")), "h2", "left")
        .join(model.histories.select(F.col("h").alias("h1"), "weight"), "h1", "left")
    )
    backed = F.coalesce("weight", F.lit(1.0)) * F.coalesce("pw", F.lit(model.unknown))
    p = F.coalesce("pp", backed)
    return rows.groupBy("id", "train").agg(
        F.sum("n").cast("long").alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)).cast("long").alias("n_known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(lift))).alias("base_score"),
        F.sum(F.col("n") * F.log10(p)).alias("score"),
    )


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, scored by blocks: the model of ``train_katz``, moved as packed arrays."""
    from folio_spark.llm.katz_blocks import score_corpus

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    scored, shared = score_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", ~held)
    return scored.select(
        F.col("id").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(shared.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )

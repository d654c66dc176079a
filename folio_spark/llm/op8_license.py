"""License scans by a positional rare-token index, in Spark expressions only.

The index keeps, of every licence text, the words rarest in the corpus (highest inverse document
frequency) with all their positions: word -> postings (text, position).  A file is looked up by
the index words it holds, rarest first; each occurrence and posting propose a placement of a text
(file position less text position).  Placements are intersected: one counts once two postings
agree on it and the text's mandatory phrases stand where the text has them.  Its score is the
IDF-weighted share of the text's words found in place.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import table
from folio_spark.llm.license_texts import TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases every scan counts, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Index words of a licence text.
RARE_WORDS = 4
#: Postings that must agree on a placement.
VOTES = 2


def split_words(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, BREAK, -1), "")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def corpus_idf(docs: DataFrame, texts=TEXTS, text_col: str = "text") -> dict[str, float]:
    """IDF of every word of the licence texts over all of ``docs``: ln((rows + 1) / (rows with the word + 1)) + 1.

    One pass; the driver receives a count for each of the texts' own words.
    """
    vocabulary = sorted({w for _, _, t in texts for w in split_words(t)})
    held = docs.select(F.array_intersect(F.lit(vocabulary), words_of(lowered(F.col(f"`{text_col}`")))).alias("w"))
    held = held.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w"))  # the empty word counts the rows
    count = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    rows = count.get("", 0)
    return {w: math.log((rows + 1) / (count.get(w, 0) + 1)) + 1 for w in vocabulary}


@dataclass(frozen=True)
class Index:
    labels: tuple[str, ...]  # by text
    words: tuple[tuple[str, ...], ...]  # by text
    weights: tuple[tuple[float, ...], ...]
    required: tuple[tuple[tuple[int, str], ...], ...]  # positions and words of the mandatory phrases
    votes: tuple[int, ...]
    postings: dict[str, tuple[tuple[int, int], ...]]  # rarest word first


def build_index(idf: dict[str, float], texts=TEXTS, rare_words: int = RARE_WORDS) -> Index:
    split = [split_words(t) for _, _, t in texts]
    required, postings, votes = [], {}, []
    for t, ((_, phrases, _), words) in enumerate(zip(texts, split, strict=True)):
        places: dict[int, str] = {}
        for phrase in phrases:
            p = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            places |= {at + k: w for k, w in enumerate(p)}
        required.append(tuple(sorted(places.items())))
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:rare_words]
        mine = [(w, (t, q)) for q, w in enumerate(words) if w in rare]
        votes.append(min(VOTES, len(mine)))
        for w, posting in mine:
            postings.setdefault(w, []).append(posting)
    order = sorted(postings, key=lambda w: (-idf[w], w))
    return Index(
        tuple(label for label, _, _ in texts), tuple(map(tuple, split)), tuple(tuple(idf[w] for w in words) for words in split), tuple(required), tuple(votes),
        {w: tuple(postings[w]) for w in order},
    )


def word_at(words: Column, i: Column | int, word: str) -> Column:
    """Whether the word at ``i`` is ``word``; false outside the file."""
    return F.coalesce(F.get(words, i) == word, F.lit(False))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Ascending starts of a phrase's consecutive words."""
    p = phrase.split()

    def here(i: Column) -> Column:
        cond = word_at(words, i, p[0])
        for k, w in enumerate(p[1:], 1):
            cond = cond & word_at(words, i + k, w)
        return cond

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


class _Constants:
    """The index as flat arrays, each a constant that the optimizer folds into one literal."""

    def __init__(self, index: Index):
        def flat(rows):
            out, ends = [], [0]
            for r in rows:
                out += r
                ends.append(len(out))
            return out, ends

        posts, self.posts_of = flat(index.postings.values())
        words, self.words_of = flat(index.words)
        must, self.must_of = flat(index.required)
        self.rare = self._of(index.postings, "string")
        self.post_text, self.post_at = (self._of([p[k] for p in posts], "int") for k in (0, 1))
        self.word, self.weight = self._of(words, "string"), self._of(flat(index.weights)[0], "double")
        self.must_at, self.must_word = (self._of([m[k] for m in must], kind) for k, kind in ((0, "int"), (1, "string")))
        self.label, self.votes = self._of(index.labels, "string"), self._of(index.votes, "int")
        self.total = self._of([sum(x) for x in index.weights], "double")
        self.posts_of, self.words_of, self.must_of = (self._of(x, "int") for x in (self.posts_of, self.words_of, self.must_of))
        self.n_rare = len(index.postings)

    @staticmethod
    def _of(values, kind: str) -> Column:
        return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def _span(ends: Column, i: Column) -> Column:
    return F.sequence(F.get(ends, i), F.get(ends, i + 1) - 1)


def verified_placements(split: DataFrame, index: Index, words: str, out: str) -> DataFrame:
    """``split`` with ``out``, the verified placements of the texts in the array column ``words``: ``array<struct<label,score>>``."""
    c = _Constants(index)
    w = F.col(words)
    keep = [F.col(f"`{k}`") for k in split.columns]
    # Index words of the file, rarest first: the order of the first array.  Each step is a column, as a lambda would compute an expression anew for each element.
    held = split.select(*keep, F.array_intersect(c.rare, w).alias("_held"))
    place = F.sequence(F.lit(0), F.size(w) - 1)

    def proposed(k: Column) -> Column:
        at = F.filter(place, lambda i: F.get(w, i) == F.get(c.rare, k))
        return F.flatten(F.transform(at, lambda i: F.transform(_span(c.posts_of, k), lambda j: F.struct(F.get(c.post_text, j).alias("t"), (i - F.get(c.post_at, j)).alias("o"), j.alias("j")))))

    numbers = F.transform("_held", lambda x: (F.array_position(c.rare, x) - 1).cast("int"))
    none = F.array().cast("array<struct<t:int,o:int,j:int>>")
    starts = held.select(*keep, F.when(F.size("_held") > 0, F.array_sort(F.flatten(F.transform(numbers, proposed)))).otherwise(none).alias("_starts"))

    def same(x: Column, i: Column) -> Column:
        other = F.get("_starts", i)
        return F.coalesce((other["t"] == x["t"]) & (other["o"] == x["o"]), F.lit(False))

    # One row for each placement that enough postings agree on: the last of them in order.
    agreed = F.filter("_starts", lambda x, i: ~same(x, i + 1) & (same(x, i - 1) | (F.get(c.votes, x["t"]) < VOTES)))

    def stands(x: Column) -> Column:
        return F.forall(_span(c.must_of, x["t"]), lambda j: F.coalesce(F.get(w, x["o"] + F.get(c.must_at, j)) == F.get(c.must_word, j), F.lit(False)))

    def scored(x: Column) -> Column:
        first = F.get(c.words_of, x["t"])
        met = F.aggregate(
            _span(c.words_of, x["t"]), F.lit(0.0), lambda acc, j: acc + F.when(F.coalesce(F.get(w, x["o"] + j - first) == F.get(c.word, j), F.lit(False)), F.get(c.weight, j)).otherwise(F.lit(0.0))
        )
        return F.struct(F.get(c.label, x["t"]).alias("label"), (met / F.get(c.total, x["t"])).alias("score"))

    return starts.select(*keep, F.transform(F.filter(agreed, stands), scored).alias(out))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """Licence findings of every row.

    Returns ``id, n_words, base array<struct<label,starts>>, found array<struct<label,score>>``:
    all places of the base phrases, and the best placement's score for each licence that is
    verified.  Without an ``index`` one is built by the IDF of ``docs`` themselves.  Nulls and
    empty texts have no words and no findings; texts of any length are read whole; repeated rows
    and rows of a null id each get a row; an empty table gives none; other columns are ignored,
    whatever their names.
    """
    index = build_index(corpus_idf(docs, text_col=text_col)) if index is None else index
    low = docs.select(F.col(f"`{id_col}`").alias("_id"), lowered(F.col(f"`{text_col}`")).alias("_low"))
    split = low.select("_id", "_low", words_of(F.col("_low")).alias("_w"))
    words, text = F.col("_w"), F.col("_low")
    none_i = F.array().cast("array<int>")
    base = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                # Substring tests are cheap; positions are only sought where every word occurs at all.
                F.when(all_in(text, phrase.split()), phrase_starts(words, phrase)).otherwise(none_i).alias("starts"),
            )
            for phrase, label in BASE_PHRASES.items()
        ]
    )
    labels = F.lit(sorted(set(index.labels)))
    split = verified_placements(split, index, "_w", "_all")
    found = split.select("_id", F.size(words).cast("long").alias("_n"), F.filter(base, lambda b: F.size(b["starts"]) > 0).alias("_base"), "_all")
    best = F.transform(
        F.filter(labels, lambda x: F.exists("_all", lambda f: f["label"] == x)),
        lambda x: F.struct(x.alias("label"), F.array_max(F.transform(F.filter("_all", lambda f: f["label"] == x), lambda f: f["score"])).alias("score")),
    )
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.col("_base").alias("base"), F.when(F.size("_all") > 0, best).otherwise(F.col("_all")).alias("found"))


def all_in(text: Column, words: list[str]) -> Column:
    cond = F.lit(True)
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        cond = cond & F.contains(text, F.lit(w))
    return cond


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    base_labels = F.array_sort(F.transform("base", lambda b: b["label"]))
    own = F.transform("found", lambda f: f["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        # A base phrase alone is weak evidence; a verified template speaks for itself.
        F.round(
            F.greatest(
                F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)),
                F.when(F.size(starts) > 0, F.lit(0.5)).otherwise(F.lit(0.0)),
            ),
            9,
        ).alias("score"),
    )

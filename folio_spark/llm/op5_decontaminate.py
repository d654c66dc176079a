"""Benchmark decontamination by SimHash windows, in DataFrame expressions only.

Item-sized windows of the documents are fingerprinted (128-bit SimHash over five-word shingles)
and matched with the items' fingerprints through a multi-index: the fingerprint is cut into
``BLOCKS`` blocks of nine or ten bits; two fingerprints within the radius differ by ``PROBE``
bits at most in one of them, so the items' blocks are entered with all such neighbours and the
windows' looked up as they are.  Candidates are then verified by the exact weighted Jaccard
similarity of their shingle sets, shingles weighing by their rarity among the items.

Windows lie where they can matter, in whatever order the shared shingles stand there: similarity
``t`` takes ``t`` of an item's weight, so windows are set at every start whose window shares that
much with an item, and nowhere else.
An item shorter than a shingle is one shingle of its own length, and texts give shingles of those
lengths, too.  The SimHash join decides between those windows and all items of the size.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio_spark.llm.base import cut, join_keys, table, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: 128 bits; sets of similarity 0.8 differ in 19 on average (deviation 4).
WORDS, BITS, BLOCKS, PROBE = 2, 128, 13, 2
#: Radius that the multi-index covers: with more than ``PROBE`` differences in every block there would be one more.
RADIUS = BLOCKS * (PROBE + 1) - 1
#: Words of an item up to which the lanes of its fingerprint cannot overflow.
LANE = 65_535
#: Item shingles up to which the item index is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, -1), "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of the ``k``-word shingles in order; fewer words make one shingle, none no shingle."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), lambda i: F.xxhash64(F.slice(words, i, k)))
    )


def _lane_sums(h: Column, word: int) -> list[Column]:
    """Sixteen sums, each counting four bits of the hashes in lanes of sixteen bits (sets stay below 65,536 shingles a fold)."""
    out = []
    for g in range(16):
        x = F.shiftrightunsigned(h, 4 * g).bitwiseAND(15)
        spread = sum((F.shiftleft(x.bitwiseAND(1 << k), 15 * k) for k in range(1, 4)), x.bitwiseAND(1))
        out.append(F.sum(spread).alias(f"g{word}_{g}"))
    return out


def _fingerprint(word: int) -> Column:
    """The majority bit of every lane of a word's sums over ``size`` hashes."""
    lanes = ", ".join(f"g{word}_{g}" for g in range(16))
    return F.expr(
        "aggregate(sequence(0, 63), 0L, (acc, i) -> acc | "
        f"if(2 * (shiftrightunsigned(array({lanes})[i div 4], CAST(16 * (i % 4) AS INT)) & 65535L) > size, shiftleft(1L, i), 0L))"
    )


def block_edges() -> list[tuple[int, int]]:
    """First and last bit (exclusive) of the blocks; together they hold every bit of the 128 once."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _bits(words: list[Column], a: int, b: int) -> Column:
    """Bits ``a`` to ``b`` of the fingerprint as a number."""
    parts = []
    for w, word in enumerate(words):
        lo, hi = max(a, 64 * w), min(b, 64 * w + 64)
        if lo < hi:
            parts.append(F.shiftleft(F.shiftrightunsigned(word, lo - 64 * w).bitwiseAND((1 << (hi - lo)) - 1), lo - a))
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def block_keys(words: list[Column], probe: int = 0) -> Column:
    """(block, bits) keys of a fingerprint, with all values up to ``probe`` bits away."""
    keys = []
    for i, (a, b) in enumerate(block_edges()):
        masks = [sum(1 << k for k in c) for n in range(probe + 1) for c in combinations(range(b - a), n)]
        bits = _bits(words, a, b)
        near = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: bits.bitwiseXOR(m)) if probe else F.array(bits)
        keys.append(F.transform(near, lambda x: F.struct(F.lit(i).alias("block"), x.alias("bits"))))
    return F.flatten(F.array(*keys))


def _held(rows: DataFrame) -> DataFrame:
    """Adds ``held``: the weight of the shingles at ``p`` and the ``m - 1`` places behind it that the document shares with the item."""
    # In units of m the frame has one length for all items; places are whole numbers, so 1 / m lies between the last in and the first out.
    frame = "sum(weight) OVER (PARTITION BY c, item ORDER BY p / CAST(m AS DOUBLE) RANGE BETWEEN CURRENT ROW AND 0.9999999D FOLLOWING)"
    return rows.withColumn("held", F.expr(frame))


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id, item_id, similarity, n_windows, first_word, n_words``: a row per document and item it leaks.

    ``similarity`` is the best among the document's windows of the item's size, ``n_windows`` how
    many of them reach the threshold, ``first_word`` the start of the first.  Words are runs of ASCII letters, digits and other scripts, case-folded over
    A-Z.  A document shorter than an item is one window; an item of fewer words than a shingle
    leaks where its words stand side by side.  Null or word-free texts and items match nothing.
    Repeated rows of an id, and all rows of a null id, count as one document each with the windows
    of all; a null item id is an item like others.  Texts of any length are read whole; empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    # Equal texts (by two hashes) are one content: windows are looked for once, and null ids need no join.
    src = src.where("t IS NOT NULL").select("id", "t", F.struct(F.xxhash64("t"), F.xxhash64(F.lit(7), "t")).alias("c"))
    named = items.select(F.col(f"`{item_col}`").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    # Items of equal words are one; their ids come back at the end.
    named = cut(named.select("item_id", F.xxhash64("w").alias("item"), F.size("w").alias("n"), shingles_of(F.col("w"), shingle).alias("s")))
    bench = cut(named.groupBy("item", "n").agg(F.first("s").alias("s"), F.count("*").alias("same")))
    total, small = bench.agg(F.coalesce(F.sum("same"), F.lit(0)), F.coalesce(F.sum(F.size("s")), F.lit(0))).first()
    short = sorted(r.n for r in bench.where(F.col("n") < shingle).select("n").distinct().collect())  # shingle - 1 values at most
    hint = F.broadcast if small <= BROADCAST_ROWS else (lambda d: d)
    top = F.lit(total)
    weights = bench.select("same", F.explode(F.array_distinct("s")).alias("h")).groupBy("h").agg(F.log1p(top / F.sum("same")).alias("weight"))
    rarest = F.log1p(top.cast("double"))
    weights = cut(weights)
    of_item = bench.select("item", "n", F.explode(F.array_distinct("s")).alias("h")).join(hint(weights), "h")
    mass = of_item.groupBy("item").agg((F.sum("weight") * (similarity - 1e-9)).alias("need"))
    places = cut(of_item.join(hint(mass), "item").withColumn("m", F.col("n") - F.least("n", F.lit(shingle)) + 1))

    split = src.select("c", words_of(F.col("t")).alias("w"))
    shingled = split.select("c", "w", F.size("w").alias("len"), shingles_of(F.col("w"), shingle).alias("s"))
    # The outer form: the plain one adds a filter that would split the text again for every shingle.
    if short:
        empty = F.array().cast("array<struct<p:int,h:bigint>>")
        fewer = [F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct((i - 1).alias("p"), F.xxhash64(F.slice("w", i, n)).alias("h")))) for n in short]
        placed = F.transform("s", lambda h, p: F.struct(p.alias("p"), h.alias("h")))
        rows = shingled.select("c", "len", F.explode_outer(F.array_distinct(F.concat(placed, *[F.coalesce(f, empty) for f in fewer]))).alias("g")).select("c", "len", "g.p", "g.h")
    else:
        rows = shingled.select("c", "len", F.posexplode_outer("s").alias("p", "h"))
    # A window of similarity t shares t of the item's weight at least: starts are kept where their window holds so much.
    hits = rows.join(hint(places), "h").select("c", "len", "p", "item", "m", "n", "need", "weight")
    hits = _held(hits.withColumn("before", F.lag("p").over(W.partitionBy("c", "item").orderBy("p"))))
    most = F.max("held").over(W.partitionBy("c", "item"))
    hits = cut(hits.withColumn("most", most).where("most >= need").drop("most"))
    # Every start of a window whose first shared shingle lies at p.
    earliest = F.greatest(F.lit(0), F.coalesce(F.col("before") + 1, F.lit(0)), F.col("p") - F.col("m") + 1)
    starts = hits.where("held >= need AND (before IS NULL OR before < p)").withColumn("p", F.explode(F.sequence(earliest, F.col("p")))).withColumn("weight", F.lit(0.0)).withColumn("place", F.lit(True))
    columns = ["c", "len", "p", "item", "m", "n", "need", "weight", "place"]
    tried = _held(starts.select(*columns).unionByName(hits.withColumn("place", F.lit(False)).select(*columns))).where("place AND held >= need")
    start = F.greatest(F.lit(0), F.least(F.col("p"), F.col("len") - F.col("n")))
    spots = cut(tried.select("c", "n", start.alias("start")).distinct().groupBy("c").agg(F.collect_list(F.struct("start", "n")).alias("spots")))

    holders = cut(join_keys(src, spots.select("c"), "c", "left_semi"))
    texts = holders.groupBy("c").agg(F.first("t").alias("t")).join(spots, "c").select("c", "spots", words_of(F.col("t")).alias("w"))
    windows = texts.select("c", "w", F.explode("spots").alias("v")).select(
        "c", F.col("v.start").alias("start"), F.col("v.n").alias("n"), F.array_sort(F.array_distinct(shingles_of(F.slice("w", F.col("v.start") + 1, F.col("v.n")), shingle))).alias("s")
    )
    windows = cut(windows.withColumn("content", F.xxhash64("s")))

    # Equal windows are fingerprinted once.
    contents = cut(windows.groupBy("n", "content").agg(F.first("s").alias("s")))

    def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = df.select(*keys, F.explode("s").alias("h")).join(hint(weights), "h", "left").withColumn("h2", F.xxhash64("h"))
        agg = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.sum(F.coalesce("weight", rarest)).alias("mass"), *_lane_sums(F.col("h"), 0), *_lane_sums(F.col("h2"), 1))
        return cut(agg.select(*keys, "mass", _fingerprint(0).alias("f0"), _fingerprint(1).alias("f1")))  # else the expressions would be repeated for every block

    of_items = fingerprints(bench.select("item", "n", F.array_distinct("s").alias("s")), ["item", "n"])
    of_windows = fingerprints(contents, ["n", "content"])
    fp = [F.col("f0"), F.col("f1")]
    x = of_windows.select("n", "content", "f0", "f1", F.col("mass").alias("mw"), F.explode(block_keys(fp)).alias("k"))
    y = of_items.select(F.col("n").alias("n2"), "item", F.col("f0").alias("e0"), F.col("f1").alias("e1"), F.col("mass").alias("mi"), F.explode(block_keys(fp, PROBE)).alias("k2"))
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("e0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("e1")))
    near = x.join(y, (F.col("n") == F.col("n2")) & (F.col("k") == F.col("k2"))).where(apart <= RADIUS).select("n", "content", "item", "mw", "mi").distinct()
    # The lanes of a fingerprint hold 65,535 shingles: longer contents meet the items of their size as they are.
    long_item = of_items.where(F.col("n") > LANE).select(F.col("n").alias("n2"), "item", F.col("mass").alias("mi"))
    whole = of_windows.where(F.col("n") > LANE).select("n", "content", F.col("mass").alias("mw")).join(long_item, F.col("n") == F.col("n2")).select("n", "content", "item", "mw", "mi")
    near = near.where(F.col("n") <= LANE).unionByName(whole)
    # Exact weighted similarity of the candidates, over whole shingle sets.
    item_sets = bench.select("item", "n", F.array_distinct("s").alias("si"))
    common = near.join(contents, ["n", "content"]).join(item_sets, ["item", "n"])
    common = common.select("n", "content", "item", "mw", "mi", F.explode(F.array_intersect("s", "si")).alias("h")).join(hint(weights), "h")
    exact = common.groupBy("n", "content", "item").agg(F.sum("weight").alias("both"), F.first("mw").alias("mw"), F.first("mi").alias("mi"))
    exact = exact.withColumn("similarity", F.col("both") / (F.col("mw") + F.col("mi") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    found = windows.select("c", "start", "n", "content").join(exact.select("n", "content", "item", "similarity"), ["n", "content"])
    found = found.join(holders.select("id", "c"), "c").join(named.select("item", "n", "item_id").distinct(), ["item", "n"])
    out = found.groupBy("id", "item_id").agg(
        F.round(F.max("similarity"), 9).alias("similarity"),
        F.count_distinct("start").alias("n_windows"),
        F.min("start").cast("long").alias("first_word"),
        F.first("n").cast("long").alias("n_words"),
    )
    return out.withColumnRenamed("id", id_col)


def drop_leaking(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item; all columns stay, and so do rows without words.

    A text is judged by itself, told by two 64-bit hashes: ids may repeat, be null or be missing,
    and columns may have any names.
    """
    key = unused("text_key", docs.columns)
    keyed = docs.withColumn(key, F.struct(F.xxhash64(text_col), F.xxhash64(F.lit(7), F.col(text_col))))
    leaks = cut(find_leaks(keyed, items, id_col=key, text_col=text_col, **options).select(key).distinct())
    return join_keys(keyed, leaks, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

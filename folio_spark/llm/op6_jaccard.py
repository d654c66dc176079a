"""N-gram Jaccard self-join by grouped prefixes.

Every document becomes the set of its word shingles (64-bit hashes).  Under one global order,
common shingles last, two sets of similarity t or more share a shingle within their prefixes.
Documents of equal sets form a class; classes of equal size and prefix form a group; groups
meet through the prefix shingles.  In each posting list all groups are first verified against
the list's smallest one, which connects large groups of copies with as many pairs as members.
Only what then still lies in different components is paired within its list, members of one
group too, filtered by size and position and verified: links inside a component change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.llm.base import connected_components, cut, free_shuffles, id_filter, map_texts, may_hold, table
from folio_spark.llm.bytesops import Words, chunks, gram_hashes, mix

#: A shingle in more than this share of the documents counts as common in the order.
COMMON = 3e-4
_BLOCK = 1 << 22
#: Lists just before an entry that it remembers, so as not to meet again whom it has met there.
SEEN = 8


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``n`` words make one shingle, none an empty set."""
    for _, _, data, off in chunks(texts):
        w = Words(data, off)
        grams = w.grams(n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            else:
                yield gram_hashes(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def common_shingles(texts: DataFrame, n: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than about ``share`` of all documents, sorted, and their ranks by frequency.

    Each block of documents names those above the share within it; summed counts again above the
    share are kept.  Every shingle above twice the share is among them, and there can be no more
    than (mean set size) / share of them however large the corpus is, so they may be broadcast.
    The order they serve is free to choose: results do not depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def flush():
            nonlocal held, size, docs
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held = []  # one copy of the block is sorted in place
            h.sort()
            first = np.flatnonzero(np.append(h[:1] == h[:1], h[1:] != h[:-1]))
            h, c = h[first], np.diff(np.append(first, len(h)))
            big = c > max(4, share * docs)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.append(h[big].view(np.int64), 0)), pa.array(np.append(c[big], 0)), pa.array(np.append(np.zeros(big.sum(), np.int64), docs))], ["h", "c", "docs"]
            )
            held, size, docs = [], 0, 0
            return out

        for batch in batches:
            for s in shingle_sets(batch.column(0), n):
                held.append(s)
                size += len(s)
                docs += 1
                if size >= _BLOCK:
                    yield flush()
        yield flush()

    found = cut(map_texts(texts, run, "h long, c long, docs long"))
    total = found.agg(F.sum("docs")).first()[0] or 0
    sums = found.groupBy("h").agg(F.sum("c").alias("c"))
    rows = sums.where((F.col("c") > 4) & (F.col("c") > share * total)).toArrow()
    h, c = np.asarray(rows.column("h")).astype(np.int64).view(np.uint64), np.asarray(rows.column("c"))
    order = np.argsort(h)
    h, c = h[order], c[order]
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(len(h))
    return h, rank


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _profiles(docs: DataFrame, n: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id, n, s1, s2, p, w, prefix``: set size, two set digests, the ordered prefix, its digest and how many common shingles it has, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                rows, prefixes = [], []
                for s in shingle_sets(part.column(1), n):
                    k = len(s)
                    digests = int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))
                    m = k - (percent * k + 99) // 100 + 1 if k else 0
                    if k and len(last):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        is_common = last[at] == s
                        s = np.concatenate([s[~is_common], s[is_common][np.argsort(rank[at[is_common]])]])
                    shared = max(0, m - int((~is_common).sum())) if k and len(last) else 0
                    s = s[:m]
                    rows.append((k, *digests, int(gram_hashes(s, m)[0].view(np.int64)) if m else 0, shared))
                    prefixes.append(s)
                cols = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(cols[:, j]) for j in range(5)), _list_array(prefixes)], ["id", "n", "s1", "s2", "p", "w", "prefix"])

    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n long, s1 long, s2 long, p long, w long, prefix array<long>")


def _of_wanted(docs: DataFrame, n: int, wanted: DataFrame, column: str, kind: str, value) -> DataFrame:
    """``id, column`` of the ``wanted`` ids, a row each, and of few others that the filter lets pass; joins on the ids are exact.

    Rows of one id are copies: were they all kept, a pair would be joined once for every two of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                part = part.filter(part.column(0).is_valid())
                part = part.filter(pa.array(may_hold(sent.value, np.asarray(part.column(0)).astype(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column(0), _list_array([value(s) for s in shingle_sets(part.column(1), n)])], ["id", column])

    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, {column} {kind}").dropDuplicates(["id"])


def parity_bits(s: np.ndarray) -> np.ndarray:
    """For each of at least eight times as many places (a power of two) as the set has members, whether an odd number of them falls there.

    Places where two sets differ are no more than members that only one of them has.  Halves
    folded together by exclusive or give the bits of half as many places.
    """
    size = 1 << max(10, (8 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _pair(a: str, b: str, percent: int):
    """Size and position filters for list entries ``a`` and ``b``: every shared shingle of a link passes them."""
    na, nb, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    bound = F.least(i, j) + 1 + F.least(na - i - 1, nb - j - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * bound >= percent * (na + nb))


def _rest(n, percent: int):
    """Shingles of a set outside its prefix."""
    return F.floor((percent * n + 99) / 100) - 1


def _enough(percent: int, common=None, na=None, nb=None):
    """Whether ``common`` shared prefix shingles of sets of sizes ``na`` and ``nb`` leave a link possible.

    Of the two prefixes the one that ends first in the order lies wholly before the other's end, so
    what it does not share is not in the other set; only what follows it can still be common.
    """
    common, na, nb = (F.col(k) if c is None else c for k, c in (("common", common), ("na", na), ("nb", nb)))
    bound = common + F.greatest(_rest(na, percent), _rest(nb, percent))
    return (100 + percent) * bound >= percent * (na + nb)


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets reach the similarity, as ``src, dst``."""
    ids_of = lambda p: p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # First by the parity bits, an eighth of the sets' size: they bound the difference from below.
    bits = _of_wanted(docs, n, ids_of(pairs), "row", "array<long>", lambda s: np.concatenate([np.array([len(s)], np.uint64), parity_bits(s)]))

    def row(side: str) -> list[Column]:
        return [F.expr(f"{side}[0]").alias(f"n{side}"), F.expr(f"slice({side}, 2, size({side}) - 1)").alias(f"p{side}")]

    seen = pairs.join(bits.select(F.col("id").alias("b"), F.col("row").alias("y")), "b").join(bits.select(F.col("id").alias("a"), F.col("row").alias("x")), "a")
    fold = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (u, v) -> u ^ v)"
    seen = seen.select("a", "b", *row("x"), *row("y"))
    seen = seen.withColumn("qx", F.expr(f"if(size(px) > size(py), {fold.format('px')}, px)")).withColumn("qy", F.expr(f"if(size(py) > size(px), {fold.format('py')}, py)"))
    apart = F.expr("aggregate(zip_with(qx, qy, (u, v) -> bit_count(u ^ v)), 0, (acc, c) -> acc + c)")
    close = (F.size("qx") != F.size("qy")) | ((100 + percent) * apart <= (100 - percent) * (F.col("nx") + F.col("ny")))
    pairs = cut(seen.where(close).select("a", "b").distinct())
    sets = _of_wanted(docs, n, ids_of(pairs), "set", "array<long>", lambda s: s)
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + percent) * inter >= percent * (F.size("sa") + F.size("sb"))).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", common_share: float = COMMON) -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their shingle sets;
    ``component_id`` is the smallest id reachable.  Null, empty and word-free texts have an empty
    set and their own id.  Rows of one id are taken as copies of one document and should be equal; a null
    id keeps a null component unless it has linked partners.  An empty table gives no rows; other
    columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    common = common_shingles(src.select("t"), n, common_share)
    profiles = cut(_profiles(src, n, percent, common))
    # Classes of equal sets, then groups of equal size and prefix.
    classes = cut(profiles.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2", "p").agg(F.min("id").alias("rep")))
    groups = classes.groupBy("n", "p").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    members = cut(classes.join(groups.where("members > 1"), ["n", "p"]).select("gid", "rep"))

    # A row a group, whatever copies its head has: lists count groups.
    heads = profiles.select("id", "n", "p", "w", "prefix").join(groups.select(F.col("gid").alias("id"), "n", "p", "members"), ["id", "n", "p"]).dropDuplicates(["id", "n", "p"])
    postings = heads.select(F.col("id").alias("gid"), "n", "w", "members", F.posexplode("prefix").alias("pos", "token"))
    list_of = Window.partitionBy("token")
    # A list's head is the group with most common shingles: of copies of one text the least altered.
    # A list of one group stays if that has members: they may be linked with each other and not with its head.
    multi = cut(
        postings.select("token", "gid", (F.col("n") * (1 << 31) + F.col("pos")).alias("np"), "w", "members")
        .withColumn("length", F.sum("members").over(list_of))
        .withColumn("head", F.max(F.struct("w", (-F.col("gid")).alias("no"), "np")).over(list_of))
        .where("length > 1")
        .select("token", "gid", "np", (-F.col("head.no")).alias("hgid"), F.col("head.np").alias("hnp"))
    )
    free_shuffles(docs.sparkSession)
    size_of, place_of = (lambda c: F.expr(f"{c} div 2147483648")), (lambda c: F.expr(f"{c} % 2147483648"))
    x = F.struct(F.col("hgid").alias("gid"), size_of("hnp").alias("n"), place_of("hnp").alias("pos"))
    y = F.struct("gid", size_of("np").alias("n"), place_of("np").alias("pos"))
    tried = multi.select(x.alias("x"), y.alias("y")).where("x.gid <> y.gid").where(_pair("x", "y", percent))
    tried = tried.groupBy(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).agg(F.count("*").alias("common"), F.max("x.n").alias("na"), F.max("y.n").alias("nb"))
    group_pairs = cut(tried.where(_enough(percent)).select("ga", "gb"))
    star = cut(
        group_pairs.select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        .union(group_pairs.join(members, group_pairs.gb == members.gid).select(F.col("ga").alias("a"), F.col("rep").alias("b")))
        .union(members.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b")))
        .distinct()
    )
    links = cut(_verify(star, src, n, percent))
    free_shuffles(docs.sparkSession)
    comps = cut(connected_components(links))

    # What is left: entries of one list in different components.  First the components of each group.
    comp_of = comps.select(F.col("id").alias("rep"), "component")
    within = members.join(comp_of, "rep", "left").groupBy("gid").agg(F.min(F.coalesce("component", "rep")).alias("lo"), F.max(F.coalesce("component", "rep")).alias("hi"))
    alone = comps.select(F.col("id").alias("gid"), F.col("component").alias("lo"), F.col("component").alias("hi")).join(members.select("gid").distinct(), "gid", "left_anti")
    entries = multi.join(cut(within.union(alone)), "gid", "left").select("token", "gid", "np", F.coalesce("lo", "gid").alias("lo"), F.coalesce("hi", "gid").alias("hi"))
    # Shingles whose lists have the same groups say the same: they become one list that counts so many shingles.
    groups_of = F.xxhash64(F.bit_xor(F.xxhash64("gid")), F.bit_xor(F.xxhash64("gid", F.lit(1))), F.count("*"))
    mixed = entries.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), groups_of.alias("list")).where("lo <> hi").select("token", "list")
    entries = entries.join(mixed, "token").groupBy("list", "gid").agg(F.count("*").alias("times"), F.min(place_of("np")).alias("pos"), F.max(size_of("np")).alias("n"))
    entries = entries.join(members, "gid", "left").select("list", F.coalesce("rep", "gid").alias("rep"), "times", "pos", "n")
    entries = entries.join(comp_of, "rep", "left").select("list", "rep", "times", "pos", "n", F.coalesce("component", "rep").alias("comp"))
    # Sets of different components share shingles in such lists only.  A pair needs so many of them that its first
    # common list must have enough shingles of both sets in it and behind it: only such rows are joined.
    onward = Window.partitionBy("rep").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy("rep").orderBy("pos").rowsBetween(-SEEN, -1)
    entries = cut(entries.withColumn("left", F.sum("times").over(onward)).withColumn("seen", F.collect_list("list").over(before)))
    one, two = entries.alias("x"), entries.alias("y")
    na, nb = F.col("x.n"), F.col("y.n")
    met = one.join(
        two,
        (F.col("x.list") == F.col("y.list"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.comp") != F.col("y.comp"))
        & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        & _enough(percent, F.least(F.col("x.left"), F.col("y.left")), na, nb)
        & ~F.arrays_overlap("x.seen", "y.seen"),  # then they have met before
    )
    met = met.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.max(na).alias("na"), F.max(nb).alias("nb"))
    # What a pair shares in all its lists.
    lists = entries.groupBy("rep").agg(F.collect_list(F.struct("list", "times")).alias("lists"))
    met = met.join(lists.select(F.col("rep").alias("a"), F.col("lists").alias("la")), "a").join(lists.select(F.col("rep").alias("b"), F.col("lists").alias("lb")), "b")
    met = met.withColumn("common", F.aggregate(F.array_intersect("la", "lb"), F.lit(0).cast("long"), lambda acc, x: acc + x["times"]))
    # Heads have been tried against their lists already.
    rest = cut(met.where(_enough(percent)).select("a", "b").join(star, ["a", "b"], "left_anti"))
    more = _verify(rest, src, n, percent)
    all_comps = connected_components(links.union(more))

    named = profiles.select("id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
    named = named.join(all_comps.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reach(id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.a, r.other FROM reach r JOIN links l ON l.b = r.id),
least_of AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least_of ON id = doc_id
"""

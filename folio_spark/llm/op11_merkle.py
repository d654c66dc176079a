"""Merkle manifest of a dataset as a radix-ranked trie.

Every row is a leaf.  Counts by digits of the id give each leaf its exact rank in its group without a global sort
(:mod:`ranks`); the digits of the rank in base two key the nodes of a trie.  Nodes are reduced longest prefix first, ten
digits at a time: one group of a shuffle holds the 1,024 nodes below one prefix and nothing else, however large the table.
The way down hands every leaf the siblings on its path, so a row can be proved against the root alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import cut, table
from folio_spark.llm.ranks import BITS, radix_ranks, range_ranks

SPAN = 1 << BITS


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts; digests enter as hex text."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value, so that no two rows read alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return digest(*[field(c) for c in columns])


def _parents(a: Column) -> Column:
    """Each two neighbours of an array of digests as one; a last lone one is hashed alone."""
    return F.transform(
        F.sequence(F.lit(0), ((F.size(a) - 1) / 2).cast("int")),
        lambda k: F.sha2(F.concat(F.get(a, k * 2), F.coalesce(F.get(a, k * 2 + 1), F.lit(""))), 256),
    )


def _climb(chunks: DataFrame) -> DataFrame:
    """Reduce the nodes ``l0`` of each chunk up to ten levels: adds ``steps``, ``l1``..``l10`` and ``top``, then stores the frame."""
    out = chunks.withColumn("steps", F.when(F.col("n") > 1, F.least(F.lit(BITS), F.length(F.bin(F.col("n") - 1)))).otherwise(0))
    for k in range(1, BITS + 1):
        out = out.withColumn(f"l{k}", F.when(F.col("steps") >= k, _parents(F.col(f"l{k - 1}"))).otherwise(F.array().cast("array<string>")))
    return cut(out.withColumn("top", F.get(F.array(*[F.get(F.col(f"l{k}"), F.lit(0)) for k in range(BITS + 1)]), F.col("steps"))))


def _path(i: Column) -> Column:
    """Siblings of the ``i``-th node of a chunk, one entry a level: ``L`` or ``R`` and the digest beside it, ``-`` where it is alone."""
    entries = []
    for k in range(BITS):
        j, nodes = F.shiftright(i, k), F.col(f"l{k}")
        beside = F.when(j % 2 == 1, F.concat(F.lit("L"), F.get(nodes, j - 1))).otherwise(
            F.coalesce(F.concat(F.lit("R"), F.get(nodes, j + 1)), F.lit("-"))
        )
        entries.append(F.when(F.col("steps") > k, beside))
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def _rise(chunks: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """From leaf chunks to one node a group: the stored chunks of every round and ``(g, top)``."""
    rounds = [_climb(chunks)]
    while most > SPAN:
        most = -(-most // SPAN)
        nodes = rounds[-1].select("g", F.col("c").alias("i"), ((F.col("n") + (SPAN - 1)) / SPAN).cast("long").alias("n"), "top")
        grouped = nodes.groupBy("g", F.shiftright("i", BITS).alias("c")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "top"))).alias("_s"))
        rounds.append(_climb(grouped.select("g", "c", "n", F.transform("_s", lambda x: x["top"]).alias("l0"))))
    return rounds, rounds[-1].select("g", "top")


def _descend(rounds: list[DataFrame], up: DataFrame) -> DataFrame:
    """``up(g, up)``: the path above each group's top -> the leaf chunks with the path above each chunk as ``up``."""
    above = up.select("g", F.lit(0).cast("long").alias("c"), "up")
    for chunk in reversed(rounds[1:]):
        paths = F.transform("l0", lambda _, i: F.struct((F.col("c") * SPAN + i).alias("i"), F.concat(_path(i), F.col("up")).alias("up")))
        above = chunk.join(above, ["g", "c"]).select("g", F.explode(paths).alias("_x")).select("g", F.col("_x.i").alias("c"), F.col("_x.up").alias("up"))
    return rounds[0].join(above, ["g", "c"])


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings on its path give."""

    def step(acc: Column, x: Column) -> Column:
        side, other = F.substring(x, 1, 1), F.substring(x, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(other, acc)).when(side == "R", F.concat(acc, other)).otherwise(acc), 256)

    return F.aggregate(path, leaf, step)


def manifest(rows: DataFrame) -> tuple[DataFrame, str]:
    """Merkle tree over ``rows(grp string, id long, leaf string, extra string)``.

    Per ``grp`` the leaves ascend by ``id`` and meet in pairs, level by level, until a subroot is left; the subroots, in
    UTF-8 order of ``grp``, meet likewise in the root.  Returns a row a leaf, ``grp, id, leaf, extra, subroot, path`` (the
    siblings from the leaf to the root, see :func:`fold`), and the root.  ``extra`` is carried along.

    Edge cases: a null group is a group of its own and comes first; null ids come first in their group; rows of one id
    are ordered by digest, and equal rows are leaves of their own; an empty table has no rows and the root ``""``;
    further columns are ignored.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit(""))
    distinct = cut(rows.select(g.alias("g"), F.col("id").cast("long").alias("id"), F.col("leaf").alias("digest"), "extra").groupBy("g", "id", "digest").agg(F.first("extra").alias("extra"), F.count("*").alias("n")))
    sizes = cut(distinct.groupBy("g").agg(F.sum("n").alias("total")))
    most = sizes.agg(F.max("total")).first()[0] or 0
    ranked = radix_ranks(distinct)
    # A row that stands n times fills the ranks from its own on: it enters each chunk once, with its count there.
    last = F.col("rank") + F.col("n") - 1
    spread = ranked.withColumn("c", F.explode(F.sequence(F.shiftright("rank", BITS), F.shiftright(last, BITS))))
    start = F.greatest(F.col("rank"), F.col("c") * SPAN)
    times = F.least(last, F.col("c") * SPAN + (SPAN - 1)) - start + 1
    item = F.struct(start.alias("r"), "id", F.col("digest").alias("leaf"), "extra", times.cast("int").alias("times"))
    chunks = spread.groupBy("g", "c").agg(F.sort_array(F.collect_list(item)).alias("_s")).join(sizes, "g")
    each = F.flatten(F.transform("_s", lambda x: F.array_repeat(F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), x["extra"].alias("extra")), x["times"])))
    chunks = chunks.select("g", "c", F.col("total").alias("n"), each.alias("items")).withColumn("l0", F.transform("items", lambda x: x["leaf"]))
    rounds, tops = _rise(chunks, most)

    groups = cut(range_ranks(tops, ["g"]))
    count = groups.count()
    forest = groups.groupBy(F.shiftright("rank", BITS).alias("c")).agg(F.sort_array(F.collect_list(F.struct("rank", "top"))).alias("_s"))
    forest = forest.select(F.lit("").alias("g"), "c", F.lit(count).cast("long").alias("n"), F.transform("_s", lambda x: x["top"]).alias("l0"))
    forest_rounds, root_row = _rise(forest, count)
    root = root_row.first()
    root = root["top"] if root else ""
    none = rows.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast("array<string>").alias("up"))
    paths = _descend(forest_rounds, none).select("c", F.explode(F.transform("l0", lambda _, i: F.struct(i.alias("i"), F.concat(_path(i), F.col("up")).alias("up")))).alias("_x"))
    paths = paths.select((F.col("c") * SPAN + F.col("_x.i")).alias("rank"), F.col("_x.up").alias("up"))
    up = groups.join(paths, "rank").select("g", "up", F.col("top").alias("subroot"))

    leaves = _descend(rounds, up)
    full = F.transform("items", lambda x, i: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), x["extra"].alias("extra"), F.concat(_path(i), F.col("up")).alias("path")))
    out = leaves.join(up.select("g", "subroot"), "g").select("g", "subroot", F.explode(full).alias("_x"))
    grp = F.when(F.col("g") != "", F.expr("substring(g, 2)"))
    return out.select(grp.alias("grp"), "_x.id", "_x.leaf", "_x.extra", "subroot", "_x.path"), root


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its leaf, proof and the root that a row tampered with folds to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    leaf = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(more))
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), leaf(F.col("n_chars")).alias("leaf"), tampered.alias("extra"))
    tree, root = manifest(rows)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.substring(x, 2, 64)), ""), 256)
    folded = fold(F.coalesce("extra", "leaf"), F.col("path"))
    out = tree.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
  FROM fields),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS h, r AS i, n, leaf AS d FROM placed
  UNION ALL SELECT g, h + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, h, i // 2),
subroots AS (SELECT g, d AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
forest AS (
  SELECT 0 AS h, g AS i, n, subroot AS d FROM subroots
  UNION ALL SELECT h + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM forest WHERE n > 1 GROUP BY h, i // 2),
low AS (
  SELECT a.g, a.r, list(CASE WHEN b.i IS NULL THEN '-' WHEN b.i % 2 = 0 THEN 'L' || b.d ELSE 'R' || b.d END ORDER BY a.h) AS path
  FROM (SELECT g, r, n, unnest(range(CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END)) AS h FROM placed) a
  LEFT JOIN nodes b ON b.g = a.g AND b.h = a.h AND b.i = xor(a.r >> a.h::INT, 1) GROUP BY a.g, a.r),
high AS (
  SELECT a.g, list(CASE WHEN b.i IS NULL THEN '-' WHEN b.i % 2 = 0 THEN 'L' || b.d ELSE 'R' || b.d END ORDER BY a.h) AS path
  FROM (SELECT g, unnest(range(CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END)) AS h FROM subroots) a
  LEFT JOIN forest b ON b.h = a.h AND b.i = xor(a.g >> a.h::INT, 1) GROUP BY a.g),
proofs AS (
  SELECT p.doc_id, p.leaf, p.other, s.subroot, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM placed p JOIN subroots s ON s.g = p.g LEFT JOIN low ON low.g = p.g AND low.r = p.r LEFT JOIN high ON high.g = p.g),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(other, leaf), path),
    lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root,
    (SELECT d FROM forest WHERE n = 1) AS root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x[2:]), 'string_agg', ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded
"""

"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are normalised, signed and rotated by fast Hadamard transforms; the largest coordinate
and its sign name the cell of a cross-polytope.  Several tables of concatenated cells are probed,
the second-best cells of each hash included.  A pair is looked at in the first table and bucket,
in a fixed order, where its two vectors meet, so that each is verified exactly once.  Buckets are
cut into blocks and compared block by block with one matrix product each: a bucket of any size
becomes many bounded tasks, and only counts and a spanning forest of links leave them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import connected_components, cut, lean, table

TABLES, HASHES, PROBES = 4, 3, 2
#: Vectors of a block: two blocks and their products stay near 30 MB.
BLOCK = 512


@lru_cache(maxsize=8)
def _signs(width: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, unnormalised; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket ids of unit vectors: [rows, tables, probes ** hashes], the table among the id's digits."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    signs = _signs(width, tables, hashes, seed)
    out = np.empty((n, tables, probes**hashes), np.int64)
    for t in range(tables):
        ids = np.full((n, 1), t, np.int64)
        for h in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, h, r]) / np.sqrt(width)
            size = np.abs(y)
            top = np.argpartition(-size, range(probes), axis=1)[:, :probes]
            cell = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            ids = (ids[:, :, None] * (2 * width) + cell[:, None, :]).reshape(n, -1)
        out[:, t] = ids
    return out


def usable(v) -> bool:
    return v is not None and len(v) > 0 and np.isfinite(v).all() and bool(np.any(v))


_HASHED = "key binary, dim int, x binary, b binary"


def hash_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label`` of every row with ``key`` (digest of the vector), ``dim``, ``x`` (float64, normalised) and ``b`` (int64 bucket ids), null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                cols: list[list] = [[None] * part.num_rows for _ in range(4)]
                rows: dict[int, tuple[list, list]] = {}
                for k, v in enumerate(part.column(2).to_pylist()):
                    if v is None or any(e is None for e in v):
                        continue
                    a = np.array(v, np.float64)
                    if usable(a):
                        cols[0][k] = hashlib.blake2b((a + 0.0).tobytes(), digest_size=16).digest()  # adding zero makes -0.0 and 0.0 one
                        a = a / np.abs(a).max()  # guards the norm against overflow
                        rows.setdefault(len(a), ([], []))
                        rows[len(a)][0].append(k)
                        rows[len(a)][1].append(a / np.linalg.norm(a))
                for dim, (keys, xs) in rows.items():
                    x = np.array(xs)
                    b = buckets(x).reshape(len(x), -1)
                    for k, rx, rb in zip(keys, x, b, strict=True):
                        cols[1][k], cols[2][k], cols[3][k] = dim, rx.tobytes(), rb.tobytes()
                kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["vec_id", "label", "key", "dim", "x", "b"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, {_HASHED}")


#: Links a task holds before it sums them up and sends them on.
_HELD = 200_000


def _links(rows: list[tuple], bucket: int, i: int, j: int, cosine: float) -> np.ndarray:
    """Index pairs [links, 2] into ``rows`` of a block pair (or of one block) that link and meet in no smaller bucket; rows: cid, rep, copies, block, x, b."""
    sides = [[k for k, r in enumerate(rows) if r[3] == block] for block in ([i] if i == j else [i, j])]
    none = np.zeros((0, 2), np.int64)
    if not all(sides):
        return none
    mats = [(np.frombuffer(b"".join(rows[k][4] for k in s)).reshape(len(s), -1), np.array(s)) for s in sides]
    (xa, ia), (xb, ib) = mats[0], mats[-1]
    p, q = np.nonzero(xa @ xb.T >= cosine - 1e-9)
    if i == j:
        p, q = p[ia[p] < ib[q]], q[ia[p] < ib[q]]
    if not len(p):
        return none
    # Bucket ids up to this one, by vector; what is larger cannot be a smaller common one.
    width = max(len(r[5]) for r in rows) // 8
    none_left = np.iinfo(np.int64).max

    def lists(side: np.ndarray, pad: int) -> np.ndarray:
        out = np.full((len(side), width), pad, np.int64)
        for k, r in enumerate(side):
            v = np.frombuffer(rows[r][5], np.int64)
            out[k, : len(v)] = v
        return np.where(out > bucket, pad, out)

    la, lb = lists(ia, none_left), lists(ib, none_left - 1)
    first = []
    for k in range(0, len(p), 20_000):
        u, v = p[k : k + 20_000], q[k : k + 20_000]
        exact = (xa[u] * xb[v]).sum(1) >= cosine
        smaller = np.where((la[u][:, :, None] == lb[v][:, None, :]).any(2), la[u], none_left).min(1)
        first.append(exact & (smaller == bucket))
    here = np.concatenate(first)
    return np.stack([ia[p[here]], ib[q[here]]], 1)


def _summed(links: list[np.ndarray]) -> pa.RecordBatch:
    """Links (cid, rep, copies of either side) as counts by class and a spanning forest of the representatives."""
    rows = np.concatenate(links)
    u, inv = np.unique(np.concatenate([rows[:, 0], rows[:, 3]]), return_inverse=True)
    n = np.bincount(inv, weights=np.concatenate([rows[:, 5], rows[:, 2]])).astype(np.int64)
    tree = _forest(rows[:, 1], rows[:, 4])
    none = lambda k: pa.nulls(k, pa.int64())
    columns = [(pa.array(u), none(len(tree))), (pa.array(n), none(len(tree))), (none(len(u)), pa.array(tree[:, 0])), (none(len(u)), pa.array(tree[:, 1]))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["cid", "n_links", "src", "dst"])


def _compare(cosine: float):
    """Block pairs of a partition sorted by (label, dim, bucket, i, j), one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key: tuple | None = None
        found: list[np.ndarray] = []
        size = 0

        def done() -> None:
            nonlocal size
            if len(held) > 1:
                links = _links(held, key[2], key[3], key[4], cosine)
                if len(links):
                    names = np.array([r[:3] for r in held], np.int64)
                    found.append(np.concatenate([names[links[:, 0]], names[links[:, 1]]], 1))
                    size += len(links)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != key:
                    done()
                    held, key = [], row[:5]
                    if size >= _HELD:
                        yield _summed(found)
                        found.clear()
                        size = 0
                held.append(row[5:])
        done()
        if found:
            yield _summed(found)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(vertex, root) rows that connect what the pairs connect."""
    u, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(u))
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    hang = np.flatnonzero(root != np.arange(len(u)))
    return np.stack([u[hang], u[root[hang]]], 1)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors link when their labels are equal and not null, their widths are equal and their
    cosine, in double precision, is ``cosine`` or more; a pair is found if it meets in any probed
    bucket (recall is measured in the tests).  Equal vectors of a label are one class from the
    start, so copies cost no comparison.  Null, empty, zero and partly null or non-finite vectors
    link with nothing and form their own component; so does a null label; a row without an id
    has no links and a null component.  Repeated rows of an id are one vector, counted once, and
    each gets its row; of an id with several different vectors each counts its own links, while
    the component is the id's.  An empty table gives no rows; other columns are ignored.
    """
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    hashed = cut(hash_vectors(src))  # every row
    able = hashed.where("key IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL")
    named = able.select("label", "key", "vec_id").distinct()
    heads = named.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = able.groupBy("label", "key").agg(*[F.first(c).alias(c) for c in ("dim", "x", "b")]).join(heads, ["label", "key"])
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))  # written, so the numbers stay

    bucket = ["label", "dim", "bucket"]
    spread = classes.select("cid", "label", "dim", "b").mapInArrow(lean(_spread), f"cid long, label {src.schema['label'].dataType.simpleString()}, dim int, bucket long")
    sizes = spread.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    member = cut(spread.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    # Class i of a bucket goes to every block pair that its block is part of.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = member.select("cid", *bucket, "block", other.alias("o")).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    keys = [*bucket, "i", "j"]
    full = pairs.join(classes.select("cid", "rep", "copies", "x", "b"), "cid").select(*keys, "cid", "rep", "copies", "block", "x", "b")
    parts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = full.repartition(parts, *keys).sortWithinPartitions(*keys)
    found = cut(dealt.mapInArrow(lean(_compare(cosine)), "cid long, n_links long, src long, dst long"))

    counts = found.where("cid IS NOT NULL").groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    # Different vectors of one id hang together by the id.
    several = named.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id")
    by_id = named.join(several, "vec_id").join(heads, ["label", "key"]).select(F.col("rep").alias("src"), F.col("vec_id").alias("dst"))
    comps = connected_components(found.where("src IS NOT NULL").select("src", "dst").unionByName(by_id))
    of_class = (
        classes.select("label", "key", "cid", "rep", "copies")
        .join(counts, "cid", "left")
        .join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("label", "key", "copies", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    of_class = cut(of_class)
    rows = hashed.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"))
    # Classes of more than a thousandth of all rows: a thousand at most, so they may be broadcast; the others' rows shuffle evenly.
    large = of_class.where(F.col("copies") * 1000 > hashed.count()).drop("copies")
    rest = rows.join(F.broadcast(large.select("label", "key")), ["label", "key"], "left_anti")
    out = rows.join(F.broadcast(large), ["label", "key"]).unionByName(rest.join(of_class.drop("copies"), ["label", "key"], "left"))
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and distinct bucket."""
    for batch in batches:
        b = [np.unique(np.frombuffer(v, np.int64)) for v in batch.column(3).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(b)), [len(x) for x in b]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(at) for k in range(3)), pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))], ["cid", "label", "dim", "bucket"]
        )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
able AS (SELECT * FROM e WHERE label IS NOT NULL AND len([v FOR v IN x IF v IS NULL OR NOT isfinite(v)]) = 0 AND list_dot_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.a, r.other FROM reach r JOIN links l ON l.b = r.id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id, min(other) = id AS kept
FROM reach LEFT JOIN degree ON a = id GROUP BY id
"""

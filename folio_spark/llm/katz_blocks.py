"""Katz scoring of a whole corpus by blocks: the same model as ``op9_katz``'s tables, moved as packed arrays.

A block is some documents of one input partition, as word hashes.  Words, then word pairs, are
aggregated within the block before anything is shuffled, and travel as compressed arrays, one for
each block and bucket, so a token costs bytes, not rows.

1. Words: buckets sum the counts of all blocks and answer each block's request.
2. Counts of counts of the pairs, for the Good-Turing discounts.
3. Blocks with their answers: base scores; pairs go to their history's bucket with the documents
   they stand in; the bucket knows all followers of its histories, hence the exactly normalised
   backoff weights, and returns each document's share of the score.
4. Shares are summed by document.

Blocks are built in steps 1 and 3 from the same scan; should the second one differ, a block finds
no answer and the job fails instead of giving wrong scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.base import cut, free_shuffles, lean
from folio_spark.llm.bytesops import Words, chunks, mix
from folio_spark.llm.op9_katz import END, RELIABLE, START, good_turing

#: Tokens after which a block is closed.
BLOCK_TOKENS = 2_000_000
#: Rounds in which the histories' buckets are dealt with: disk holds one round's pairs at a time.
PASSES = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KINDS = {"u8": np.uint64, "i8": np.int64, "u4": np.uint32, "u2": np.uint16, "f8": np.float64, "u1": np.uint8}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; integers take the narrowest type that holds them."""
    out = []
    for a in arrays:
        if a.dtype == np.int64 and len(a) and a.min() >= 0:
            top = a.max()
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        raw = a.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        out.append(np.array([len(raw), len(small)], np.int64).tobytes() + a.dtype.str[1:].encode() + small)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, small = np.frombuffer(data, np.int64, 2, at)
        kind = data[at + 16 : at + 18].decode()
        raw = pa.decompress(data[at + 18 : at + 18 + int(small)], decompressed_size=int(size), codec="zstd", asbytes=True)
        a = np.frombuffer(raw, _KINDS[kind])
        out.append(a.astype(np.int64) if kind in ("u1", "u2", "u4") else a)
        at += 18 + int(small)
    return out


class Block:
    """Documents of a block: ids, whether they have one, training flags, tokens of each (END included) and all tokens' hashes."""

    __slots__ = ("ids", "named", "train", "lens", "h", "key")

    def __init__(self, ids, named, train, lens, h, place: int):
        self.ids, self.named, self.train, self.lens, self.h = ids, named, train, lens, h
        digest = hashlib.blake2b(ids.tobytes() + named.tobytes() + train.tobytes() + lens.tobytes() + place.to_bytes(8, "little"), digest_size=8).digest()
        self.key = int.from_bytes(digest, "little", signed=True)


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """Blocks of a partition of (id, train, text)."""
    context = TaskContext.get()
    place = (context.partitionId() if context else 0) << 24
    held: list[tuple] = []
    size = 0

    def close() -> Block:
        nonlocal held, size, place
        place += 1
        out = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), place)
        held, size = [], 0
        return out

    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
        named = np.asarray(batch.column(0).is_valid())
        train = np.asarray(batch.column(1)).astype(bool)
        for first, last, data, off in chunks(batch.column(2)):
            w = Words(data, off)
            h = np.insert(w.hash, w.first[1:], END)
            held.append((ids[first:last], named[first:last], train[first:last], np.diff(w.first) + 1, h))
            size += len(h)
            if size >= limit:
                yield close()
    if held:
        yield close()


def by_bucket(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups by bucket and is stable within, and the ``k + 1`` bounds."""
    bucket = (keys % np.uint64(k)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=k))])


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _grouped(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[tuple]]:
    """Rows of equal first column, of a partition sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _counts(c: np.ndarray) -> np.ndarray:
    """Numbers of types seen 1 to RELIABLE + 1 times."""
    return np.bincount(c[(c > 0) & (c <= RELIABLE + 1)], minlength=RELIABLE + 2)[1:]


def _stats(df: DataFrame) -> np.ndarray:
    rows = df.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r.x for r in rows], np.int64) if rows else np.zeros(RELIABLE + 3, np.int64)


def _word_requests(k: int, limit: int):
    def run(batches):
        for b in blocks(batches, limit):
            u, inv = np.unique(b.h, return_inverse=True)
            seen = np.bincount(inv, weights=np.repeat(b.train, b.lens), minlength=len(u)).astype(np.int64)
            order, cuts = by_bucket(u, k)
            u, seen = u[order], seen[order]
            data = [pack(u[i:j], seen[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield _table(bucket=pa.array(np.arange(k)), block=pa.array(np.full(k, b.key)), data=pa.array(data, pa.binary()))

    return run


def _word_answers(batches):
    """Sums of a bucket: an answer for every block, the words' table, statistics."""
    for rows in _grouped(batches):
        parts = [unpack(r[2]) for r in rows]
        u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)
        answers, at = [], 0
        for p in parts:
            answers.append(pack(total[inv[at : at + len(p[0])]]))
            at += len(p[0])
        n = len(rows)
        stats = np.concatenate([_counts(total), [total.sum(), (total > 0).sum()]]).astype(np.int64)
        yield _table(
            bucket=pa.array(np.full(n + 1, rows[0][0])),
            block=pa.array([r[1] for r in rows] + [None], pa.int64()),
            data=pa.array([*answers, pack(u[total > 0], total[total > 0])], pa.binary()),
            stats=pa.array([None] * n + [stats.tolist()], pa.list_(pa.int64())),
        )


def _histories(b: Block) -> np.ndarray:
    h1 = np.empty_like(b.h)
    h1[1:] = b.h[:-1]
    h1[np.concatenate([[0], np.cumsum(b.lens)[:-1]])] = START
    return h1


def _pair_requests(k: int, limit: int):
    def run(batches):
        for b in blocks(batches, limit):
            seen = np.repeat(b.train, b.lens)
            key, n = np.unique(mix(_histories(b)[seen] * _ODD + b.h[seen]), return_counts=True)
            order, cuts = by_bucket(key, k)
            key, n = key[order], n[order]
            data = [pack(key[i:j], n[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield _table(bucket=pa.array(np.arange(k)), data=pa.array(data, pa.binary()))

    return run


def _pair_stats(batches):
    for rows in _grouped(batches):
        parts = [unpack(r[1]) for r in rows]
        _, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        yield _table(stats=pa.array([[*_counts(total).tolist(), int(total.sum()), len(total)]], pa.list_(pa.int64())))


def _block_rows(limit: int):
    def run(batches):
        for b in blocks(batches, limit):
            u, inv = np.unique(b.h, return_inverse=True)
            yield _table(block=pa.array([b.key]), docs=pa.array([pack(b.ids.view(np.uint64), b.named.astype(np.int64), b.train.astype(np.int64), b.lens)]), words=pa.array([pack(u)]), tokens=pa.array([pack(inv.astype(np.int64))]))

    return run


def _discounts(c: np.ndarray, d: list[float]) -> np.ndarray:
    out = np.ones(len(c))
    for r, x in enumerate(d, 1):
        out[c == r] = x
    return out


class Shared:
    """The few numbers all tasks need."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, starts: int):
        tally = lambda s: {r: int(n) for r, n in enumerate(s[: RELIABLE + 1], 1)}
        self.tokens, self.types, self.starts = int(words[-2]), int(words[-1]), starts
        self.d1, self.d2 = good_turing(tally(words)), good_turing(tally(pairs))
        n = max(self.tokens, 1)
        small = sum((1 - d) * r * int(words[r - 1]) for r, d in enumerate(self.d1, 1))
        self.scale, self.unknown = 1.0 / n, small / n
        if self.tokens == 0:
            self.unknown = 1.0
        elif self.unknown < 0.5 / n:  # no count was small: one more token makes room for unknown words
            self.scale, self.unknown = 1.0 / (n + 1.0), 1.0 / (n + 1.0)

    def word(self, c: np.ndarray) -> np.ndarray:
        d = self.d1 if self.scale == 1.0 / max(self.tokens, 1) else []
        return np.where(c > 0, _discounts(c, d) * c * self.scale, self.unknown)


def _score_words(k: int, shared: Shared, part: int, parts: int):
    """Base scores of a block's documents (in the first part), and its pairs for the part's history buckets."""
    lift = shared.tokens + 0.5 * (shared.types + 1)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                key, docs, words, tokens, answers = (batch.column(i)[r].as_py() for i in range(5))
                ids, named, train, lens = unpack(docs)
                (u,), (inv,) = unpack(words), unpack(tokens)
                order, _ = by_bucket(u, k)
                if not answers:
                    raise RuntimeError("a block changed between two scans of the input; store the input first")
                got = np.concatenate([unpack(a["data"])[0] for a in sorted(answers, key=lambda a: a["bucket"])])
                if len(got) != len(u):
                    raise RuntimeError("a block changed between two scans of the input; store the input first")
                c = np.empty(len(u), np.int64)
                c[order] = got
                heads = np.concatenate([[0], np.cumsum(lens)[:-1]])
                base = np.add.reduceat(np.log10((c + 0.5) / lift)[inv], heads)
                known = np.add.reduceat((c > 0)[inv].astype(np.int64), heads)
                if part == 0:
                    none = pa.array([None], pa.binary())
                    yield _table(bucket=pa.array([abs(key) % k]), block=pa.array([key]), docs=pa.array([pack(ids, named, train, lens, known, base)]), names=none, pairs=none, places=none)
                yield _pairs_of(key, k, shared, train, lens, heads, u, inv, c, part, parts)

    return run


def _pairs_of(key, k, shared, train, lens, heads, u, inv, c, part, parts) -> pa.RecordBatch:
    n = len(u)
    left = np.empty_like(inv)
    left[1:] = inv[:-1]
    left[heads] = n  # START
    names, sizes = np.append(u, START), np.append(c, shared.starts)
    bucket_of = (names % np.uint64(k)).astype(np.int64)
    # Pairs in order of their history's bucket, history and word.
    rank = np.empty(n + 1, np.int64)
    rank[np.argsort(bucket_of, kind="stable")] = np.arange(n + 1)
    back = np.argsort(rank)
    mine = np.flatnonzero(bucket_of[left] % parts == part)
    doc = np.repeat(np.arange(len(lens)), lens)[mine]
    pair, at = np.unique(rank[left[mine]] * n + inv[mine], return_inverse=True)
    h1, h2 = back[pair // n], pair % n
    seen = np.bincount(at, weights=train[doc], minlength=len(pair)).astype(np.int64)
    place, times = np.unique(at * len(lens) + doc, return_counts=True)
    where, which = place // len(lens), place % len(lens)
    bounds = np.searchsorted(bucket_of[h1], np.arange(k + 1))
    spots = np.searchsorted(where, bounds)
    out = {"names": [], "pairs": [], "places": []}
    for a, b, s, t in zip(bounds[:-1], bounds[1:], spots[:-1], spots[1:], strict=True):
        hs, first = np.unique(rank[h1[a:b]], return_index=True)
        hist = h1[a:b][first]
        out["names"].append(pack(names[hist], np.diff(np.append(first, b - a)), sizes[hist]) if b > a else None)
        low = u[h2[a:b]] & np.uint64((1 << 48) - 1)
        out["pairs"].append(pack((low >> np.uint64(16)).astype(np.uint32), (low & np.uint64(0xFFFF)).astype(np.uint16), seen[a:b], c[h2[a:b]]) if b > a else None)
        out["places"].append(pack(np.bincount(where[s:t] - a, minlength=b - a), which[s:t], times[s:t]) if b > a else None)
    full = np.flatnonzero(np.diff(bounds))
    pick = lambda x: pa.array([x[i] for i in full], pa.binary())
    return _table(
        bucket=pa.array(full), block=pa.array(np.full(len(full), key)), docs=pa.array([None] * len(full), pa.binary()),
        names=pick(out["names"]), pairs=pick(out["pairs"]), places=pick(out["places"]),
    )


def _score_pairs(shared: Shared):
    """Pair probabilities of a bucket's histories, and each document's share of the score."""

    def run(batches):
        for rows in _grouped(batches):
            for r in rows:
                if r[2] is not None:
                    yield _table(block=pa.array([r[1]]), docs=pa.array([r[2]], pa.binary()), share=pa.array([None], pa.binary()))
            rows = [r for r in rows if r[2] is None]
            if not rows:
                continue
            h1, ch, low, seen, c2, cuts = [], [], [], [], [], [0]
            for r in rows:
                name, n, size = unpack(r[3])
                hi, lo, s, c = unpack(r[4])
                h1.append(np.repeat(name, n))
                ch.append(np.repeat(size, n))
                low.append((hi.astype(np.uint64) << np.uint64(16)) | lo.astype(np.uint64))
                seen.append(s)
                c2.append(c)
                cuts.append(cuts[-1] + len(s))
            h1, ch, low, seen, c2 = map(np.concatenate, (h1, ch, low, seen, c2))
            _, first, inv = np.unique(mix(h1 * _ODD + low), return_index=True, return_inverse=True)
            c12 = np.bincount(inv, weights=seen, minlength=len(first)).astype(np.int64)
            mass = _discounts(c12, shared.d2) * c12
            pw = shared.word(c2)
            hist, of = np.unique(h1, return_inverse=True)
            own = of[first]
            kept = np.bincount(own, weights=mass, minlength=len(hist))
            covered = np.bincount(own, weights=np.where(c12 > 0, pw[first], 0.0), minlength=len(hist))
            size = np.zeros(len(hist))
            size[of] = ch
            size = np.where(kept > size - 1e-6, size + 1, size)  # a history that gives nothing up makes room by one more count
            some = kept > 0
            weight = np.where(some, (1 - kept / size) / np.maximum(1 - covered, shared.unknown), 1.0)
            with np.errstate(divide="ignore"):
                p = np.where((c12 > 0)[inv], (mass[inv] / size[of]), weight[of] * pw)
            logs = np.log10(p)
            for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
                n, which, times = unpack(r[5])
                value = np.bincount(which, weights=np.repeat(logs[a:b], n) * times)
                docs = np.unique(which)
                yield _table(block=pa.array([r[1]]), docs=pa.array([None], pa.binary()), share=pa.array([pack(docs, value[docs])], pa.binary()))

    return run


def _sum_shares(batches):
    for rows in _grouped(batches):
        (docs,) = [unpack(r[1]) for r in rows if r[1] is not None]
        ids, named, train, lens, known, base = docs
        score = np.zeros(len(ids))
        for r in rows:
            if r[2] is not None:
                which, value = unpack(r[2])
                score[which] += value
        yield _table(id=pa.array(ids.view(np.int64), mask=named == 0), train=pa.array(train.astype(bool)), n_tokens=pa.array(lens), n_known=pa.array(known), base_score=pa.array(base), score=pa.array(score))


def score_corpus(docs: DataFrame, id_col: str, text_col: str, train: Column, block_tokens: int = BLOCK_TOKENS, passes: int = PASSES) -> tuple[DataFrame, Shared]:
    """``id, train, n_tokens, n_known, base_score, score`` of every row, and the model's shared numbers.

    ``docs`` must give the same partitions each time it is scanned, as a stored table does, and
    have integral ids; null texts are empty, rows of a null id keep it, repeated rows are scored
    each; a text of any length is read whole; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("t"))
    k = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(k, key).sortWithinPartitions(key)

    def answers_of() -> DataFrame:
        requests = src.mapInArrow(lean(_word_requests(k, block_tokens)), "bucket long, block long, data binary")
        return cut(dealt(requests, "bucket").mapInArrow(lean(_word_answers), "bucket long, block long, data binary, stats array<long>"))

    def pair_stats_of() -> np.ndarray:
        pairs = src.mapInArrow(lean(_pair_requests(k, block_tokens)), "bucket long, data binary")
        return _stats(dealt(pairs, "bucket").mapInArrow(lean(_pair_stats), "stats array<long>"))

    def shares_of(part: int) -> DataFrame:
        replies = answers.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
        rows = src.mapInArrow(lean(_block_rows(block_tokens)), "block long, docs binary, words binary, tokens binary")
        met = rows.join(replies.hint("shuffle_hash"), "block", "left")
        kinds = "bucket long, block long, docs binary, names binary, pairs binary, places binary"
        pairs = dealt(met.mapInArrow(lean(_score_words(k, shared, part, passes)), kinds), "bucket")
        return cut(pairs.mapInArrow(lean(_score_pairs(shared)), "block long, docs binary, share binary"))

    # Each phase in a function of its own: when it returns, nothing holds its shuffles.
    answers = answers_of()
    free_shuffles(spark)
    pair_stats = pair_stats_of()
    free_shuffles(spark)
    shared = Shared(_stats(answers.where("stats IS NOT NULL")), pair_stats, src.where("train").count())
    shares = None
    for part in range(passes):
        more = shares_of(part)
        shares = more if shares is None else shares.unionByName(more)
        free_shuffles(spark)
    return dealt(shares, "block").mapInArrow(lean(_sum_shares), "id long, train boolean, n_tokens long, n_known long, base_score double, score double"), shared

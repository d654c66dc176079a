"""Pruned similarity joins, leader and average-linkage deduplication against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio_spark.functions import neighbours as nb
from folio_spark.operators import dedup


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string").repartition(3)


def bunches(seed, n=240, groups=12, dim=8, noise=0.08):
    rng = np.random.RandomState(seed)
    base = rng.standard_normal((groups, dim))
    return base[rng.randint(0, groups, n)] + noise * rng.standard_normal((n, dim))


def brute_pairs(x, t, by=None):
    s = unit(x) @ unit(x).T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= t and (by is None or by[i] == by[j])}


@pytest.mark.parametrize("t,block,per", [(0.999, 16, 10), (0.97, 64, 30), (0.8, 100, 60), (0.3, 2048, 2048), (-0.2, 64, 60)])
def test_similarity_join(spark, t, block, per):
    x = np.concatenate([bunches(1), bunches(1)[:5], np.zeros((3, 8)), -bunches(1)[:4]])
    df = frame(spark, x, [(900, None, "null")])
    got = nb.similarity_report(df, t, block=block, per_pivot=per)
    rows = got.pairs.collect()
    assert len(rows) == len({(r["i"], r["j"]) for r in rows})
    assert {(r["i"], r["j"]) for r in rows} == brute_pairs(x, t)
    assert got.compared <= got.possible


def test_search_skips_what_cannot_match(spark):
    got = nb.similarity_report(frame(spark, bunches(4, 1500, 40, 16, 0.03)), 0.98, block=64, per_pivot=40)
    assert got.pairs.count() > 5000 and got.skipped > 0.9
    assert nb.knn_report(frame(spark, bunches(4, 1500, 40, 16, 0.03)), 3, block=64, per_pivot=40).skipped > 0.9


def test_pairs_within_groups(spark):
    x, by = bunches(2, 80), [None if i % 9 == 0 else "ab"[i % 2] for i in range(80)]
    df = frame(spark, x).withColumn("topic", F.element_at(F.array(*[F.lit(b) for b in by]), (F.col("vec_id") + 1).cast("int")))
    got = {(r["i"], r["j"]) for r in nb.similarity_join(df, 0.95, by="topic").collect()}
    assert got == {p for p in brute_pairs(x, 0.95, by) if by[p[0]] is not None}


@pytest.mark.parametrize("block,per", [(32, 12), (2048, 2048)])
def test_knn_join(spark, block, per):
    x = np.concatenate([bunches(3, 90), bunches(3, 90)[:6], np.zeros((2, 8))])
    got = nb.knn_report(frame(spark, x, [(900, None, "null")]), 4, block=block, per_pivot=per).pairs.collect()
    s = np.round(unit(x) @ unit(x).T, 12)
    np.fill_diagonal(s, -np.inf)
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:4]
        assert [r["neighbour"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] == want
    assert len(got) == 4 * len(x)


def test_nothing_to_join(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nb.similarity_join(none, 0.5).count() == 0 and nb.knn_join(none, 2).count() == 0
    two = frame(spark, np.zeros((2, 3)))
    assert nb.similarity_join(two, 0.5).count() == 0
    assert {(r["id"], r["neighbour"], r["sim"]) for r in nb.knn_join(two, 5).collect()} == {(0, 1, 0.0), (1, 0, 0.0)}


def brute_leader(x, t, order):
    u = unit(x)
    heads, out = [], {}
    for i in sorted(range(len(x)), key=lambda i: (order[i], i)):
        hit = [h for h in heads if u[h] @ u[i] >= t]
        out[i] = hit[0] if hit else i
        if not hit:
            heads.append(i)
    return out


@pytest.mark.parametrize("rest", [300, 50_000])
def test_leader(spark, rest):
    rng = np.random.RandomState(6)
    turn = np.array([[np.cos(a), np.sin(a)] for a in np.arange(0, 0.6, 0.04)])  # a chain that no component splits
    x = np.concatenate([np.pad(turn, ((0, 0), (0, 6))), bunches(5, 60)])
    order = rng.randint(0, 20, len(x))
    df = frame(spark, x).withColumn("o", F.element_at(F.array(*[F.lit(int(v)) for v in order]), (F.col("vec_id") + 1).cast("int")))
    for by, want in (("o", brute_leader(x, 0.99, order)),) if rest == 300 else (("o", brute_leader(x, 0.99, order)), (None, brute_leader(x, 0.99, np.zeros(len(x))))):
        got = dedup.leader(df, 0.99, order=by, rest=rest).collect()
        assert {r["vec_id"]: r["leader"] for r in got} == want
        assert all(r["is_leader"] == (r["leader"] == r["vec_id"]) for r in got)


def brute_linkage(x, t):
    u = unit(x)
    total = u @ u.T
    groups, size = [[i] for i in range(len(x))], np.ones(len(x))
    np.fill_diagonal(total, -np.inf)
    while len(groups) > 1:
        mean = total / np.outer(size, size)
        a, b = divmod(int(mean.argmax()), len(groups))
        if mean[a, b] < t:
            break
        a, b = min(a, b), max(a, b)
        groups[a] += groups[b]
        size[a] += size[b]
        total[a] += total[b]
        total[:, a] = total[a]
        total[a, a] = -np.inf
        keep = np.arange(len(groups)) != b
        total, size = total[keep][:, keep], size[keep]
        del groups[b]
    return {i: min(g) for g in groups for i in g}


@pytest.mark.parametrize("t", [0.97])
def test_average_linkage(spark, t):
    x = np.concatenate([bunches(7, 50, 6, 5, 0.25), np.zeros((2, 5))])
    got = {r["vec_id"]: r["cluster"] for r in dedup.average_linkage(frame(spark, x, [(900, None, "null")]), t).collect()}
    assert got.pop(900) == 900
    assert got == brute_linkage(x, t)
    assert len(set(got.values())) < len(got)


@pytest.mark.parametrize("rest", [0, 60])
def test_average_linkage_in_rounds_and_in_one_task(spark, rest):
    x = np.concatenate([bunches(8, 70, 8, 5, 0.3), bunches(8, 70, 8, 5, 0.3)[:6]])  # more than 60 edges, and equal vectors
    assert len(brute_pairs(x, 0.95)) > 60
    got = {r["vec_id"]: r["cluster"] for r in dedup.average_linkage(frame(spark, x), 0.95, rest=rest).collect()}
    assert got == brute_linkage(x, 0.95)


def spread(seed, n, dim=24):
    return unit(np.random.RandomState(seed).standard_normal((n, dim)))


def test_cells_are_used_only_where_they_pay():
    x, y = spread(9, 400), unit(bunches(9, 400, 40, 24, 0.02))
    assert not nb._join_pays(x, x[:100], 1.2, 1.2, 10) and not nb._knn_pays(x, x[:100], 5, 10)
    assert nb._join_pays(y, y[:40], 0.1, 0.1, 10) and nb._knn_pays(y, y[:40], 3, 10)


def test_blocks_grow_with_the_table():
    assert [nb._block_rows(n, 2048) for n in (10, 20_000, 300_000, 10**9)] == [2048, 2048, 25_000, 32_768]


def test_spread_vectors_equal_brute_force(spark):
    x = spread(10, 900)
    got = nb.similarity_report(frame(spark, x), 0.5, block=128, per_pivot=10)
    assert {(r["i"], r["j"]) for r in got.pairs.collect()} == brute_pairs(x, 0.5) and got.compared == got.possible
    near = nb.knn_report(frame(spark, x), 3, block=128, per_pivot=10).pairs.collect()
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    want = {(i, j) for i in range(900) for j in sorted(range(900), key=lambda j: (-s[i, j], j))[:3]}
    assert {(r["id"], r["neighbour"]) for r in near} == want


def test_products_in_single_precision_decide_nothing():
    x = spread(12, 300)
    x[7], y = x[3], np.concatenate([x, x[:40]])
    exact = x @ y.T
    for t in (0.5, float(exact[3, 9]), 1 - 1e-9):
        got = {(i, j) for a, b, _ in nb.reaching(x, y, t) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        clear = np.abs(exact - t) > 1e-12
        assert {p for p in got if clear[p]} == {p for p in zip(*map(np.ndarray.tolist, np.nonzero((exact >= t) & clear)), strict=True)}


def test_nearest_rows_over_many_tiles(monkeypatch):
    monkeypatch.setattr(nb, "TILE_ROWS", 16)
    monkeypatch.setattr(nb, "TILE", 32)
    monkeypatch.setattr(nb, "PAIRS_AT_ONCE", 50)
    x = np.concatenate([spread(13, 150), np.repeat(spread(14, 2), 30, axis=0)])
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    ids = np.arange(len(x)) * 3
    got = [(i, j) for a, b, _ in nb.nearest(x, ids, x, ids, 4) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert got == [(3 * i, 3 * j) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:4]]


def test_blocks_are_not_joined_into_few_tasks(spark):
    """The bytes of blocks are few, but their pairs are much work."""
    pairs = nb.similarity_report(frame(spark, spread(10, 900)), 0.5, block=128, per_pivot=10).pairs
    assert pairs.rdd.getNumPartitions() >= 36


@pytest.mark.parametrize("t", [0.25, 0.6])
def test_forest_links_what_pairs_link(spark, t):
    x = np.concatenate([spread(15, 500), spread(16, 60)[:5], spread(15, 500)[:3], np.zeros((2, 24))])
    df = frame(spark, x)
    edges = [(r["i"], r["j"]) for r in nb.similarity_forest(df, t, block=64, per_pivot=10).collect()]
    pairs = brute_pairs(x, t)
    assert len(edges) < len(pairs) or t > 0.3

    def groups(edges):
        label = nb.merged_labels(np.arange(len(x)), *np.array(sorted(edges)).T)
        return label.tolist()

    assert groups(edges) == groups(pairs)


def test_leaders_are_met_in_batches(spark, monkeypatch):
    x = np.concatenate([spread(17, 300, 6), np.zeros((2, 6)), spread(17, 300, 6)[:9]])
    seen = []
    by_first = dedup._by_first
    monkeypatch.setattr(dedup, "_by_first", lambda *a: seen.append(by_first(*a)) or seen[-1])
    got = dedup.leader(frame(spark, x, [(900, None, "null")]), 0.6, batch=40).collect()
    assert sum(held is not None for held, _ in seen) >= 2
    got = {r["vec_id"]: r["leader"] for r in got}
    assert got.pop(900) == 900 and got == brute_leader(x, 0.6, np.zeros(len(x)))


def test_average_linkage_keeps_no_edges(spark, monkeypatch):
    """The edges of 120 spread vectors outnumber their rows many times; the clusters come without them."""
    monkeypatch.setattr(nb, "similarity_join", None)
    x = spread(18, 120, 5)
    assert len(brute_pairs(x, 0.3)) > 10 * len(x)
    for rest in (30, 32_768):
        got = {r["vec_id"]: r["cluster"] for r in dedup.average_linkage(frame(spark, x), 0.3, rest=rest).collect()}
        assert got == brute_linkage(x, 0.3)

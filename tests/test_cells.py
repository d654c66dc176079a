"""KMeans within cells: every vector is clustered, cells stay within their size, equal vectors stay together."""

import numpy as np
import pytest

from folio_spark.operators import cells, dedup


def vectors(spark, n, copies, width=6):
    rng = np.random.RandomState(5)
    x = [[float(v) for v in row] for row in rng.randn(n, width)]
    return spark.createDataFrame(list(enumerate(x + [x[0]] * copies)), "node long, v array<double>")


@pytest.mark.parametrize("rounds", [8, 0])
def test_cells_stay_within_their_size(spark, rounds):
    from pyspark.sql import functions as F

    points = vectors(spark, 700, 0).select("v", F.lit(1).cast("long").alias("w"), F.xxhash64("v").alias("h"))
    got, sizes = cells.split(points, 60, fan=8, rounds=rounds)
    assert sum(sizes.values()) == 700 and max(sizes.values()) <= 60
    assert {r["cell"]: r["n"] for r in got.groupBy("cell").agg(F.count_distinct("v").alias("n")).collect()} == sizes


def test_kmeans_in_cells_gives_k_clusters_and_their_means(spark):
    nodes = vectors(spark, 700, 300)
    members, means = cells.kmeans(nodes, 70, size=60)
    v, parent = {r.node: r.v for r in nodes.collect()}, {r.node: r.parent for r in members.collect()}
    assert parent.keys() == v.keys() and set(parent.values()) == set(range(70))
    assert len({parent[0], *(parent[n] for n in range(700, 1000))}) == 1
    for r in means.collect():
        assert np.allclose(r.v, np.mean([v[n] for n, p in parent.items() if p == r.node], axis=0))


def test_kmeans_tree_of_many_vectors_keeps_its_levels(spark):
    x = vectors(spark, 1000, 0).selectExpr("node AS vec_id", "v AS embedding")
    got = dedup.kmeans_tree(x, size=150).collect()
    per = {level: [r for r in got if r.level == level] for level in range(4)}
    assert [len(per[i]) for i in range(4)] == [1000, 100, 10, 1] and len(got) == 1111
    assert all({r.parent for r in per[i]} == {r.node for r in per[i + 1]} for i in range(3))

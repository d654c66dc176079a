"""Exact, leader, transitive and average-linkage deduplication and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import neighbours as nb
from folio_spark.functions import text as tx
from folio_spark.functions import vector as vx
from folio_spark.functions.graph import connected_components, cut
from folio_spark.operators import cells


def exact(df: DataFrame, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """First row of every content hash, with ``content_hash`` and ``group_size``."""
    h = df.withColumn("content_hash", tx.content_hash(F.col(text_col)))
    keys = h.groupBy("content_hash").agg(F.min(order).alias(order), F.count("*").alias("group_size"))
    return h.drop("content_hash").join(keys, order)


def exact_groups(df: DataFrame, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    h = df.select(order, tx.content_hash(F.col(text_col)).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min(order).alias("first_id"), F.max(order).alias("last_id"), F.count("*").alias("group_size")).where("group_size > 1")


def transitive(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Connected components of the graph of pairs at ``threshold``: ``id, cluster``."""
    pairs = cut(nb.similarity_forest(vectors, threshold, id_col, vector))
    comps = connected_components(pairs.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    return vectors.select(id_col).join(comps.withColumnRenamed("id", id_col), id_col, "left").select(id_col, F.coalesce("component", id_col).alias("cluster"))


#: Edges that one task may finish by itself once the rounds have left so few; the rounds do not depend on it for the result.
REST = 50_000
#: Rows that one task takes to find the leaders among.
BATCH = 8_192


def leader(vectors: DataFrame, threshold: float = 0.85, id_col: str = "vec_id", vector: str = "embedding", order: str | None = None, rest: int = REST, batch: int = BATCH) -> DataFrame:
    """Greedy leader dedup in ``order``: a row joins the first leader it reaches, else leads: ``id, leader, is_leader``.

    Order dependent and not transitive.  The leaders are the first maximal independent set of the similarity graph in that
    order, so they need no walk row by row: in each round the undecided rows without an undecided neighbour before them
    lead, and the neighbours behind a leader follow.  A row's leader is then its first neighbour that leads.  When at most
    ``rest`` edges are undecided one task walks them, which ends long chains.  Null and zero vectors lead themselves.

    Before that, while over ``batch`` rows are undecided and leaders decide many of them, the leaders among the first
    ``batch`` are found in one task and met by all others: the first that a row reaches is its leader, since all later
    ones stand behind.  So rows meet leaders instead of one another.
    """
    order = order or id_col
    everything, decided = vectors, None
    while True:
        held, vectors = _by_first(vectors, threshold, id_col, vector, order, batch)
        if held is None:
            break
        decided = held if decided is None else decided.unionByName(held)
    pairs = cut(nb.similarity_join(vectors, threshold, id_col, vector))
    place = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(order).alias("o"))
    key = lambda c: place.select(F.col("id").alias(c), F.struct(F.col("o").alias("o"), F.col("id").alias("id")).alias(f"{c}k"))
    both = pairs.select("i", "j").join(key("i"), "i").join(key("j"), "j")
    # Every edge from the row that comes first.
    edges = cut(both.select(F.least("ik", "jk").alias("a"), F.greatest("ik", "jk").alias("b")).distinct())
    every, heads = edges, None
    while True:
        left = edges.count()
        if left <= rest:
            found = _walk(edges)
            heads = found if heads is None else heads.unionByName(found)
            break
        behind = edges.select(F.col("b").alias("x")).distinct()
        first = edges.select(F.col("a").alias("x")).distinct().join(behind, "x", "left_anti")
        heads = cut(first if heads is None else heads.unionByName(first))
        gone = edges.join(first, edges.a == first.x, "left_semi").select(F.col("b").alias("x")).unionByName(first).distinct()
        gone = cut(gone)
        rest_edges = edges.join(gone, edges.a == gone.x, "left_anti").join(gone, edges.b == gone.x, "left_anti")
        # A row whose neighbours before it all follow has no edge left as a follower: it must not be lost as a leader.
        alone = edges.select(F.col("a").alias("x")).union(edges.select(F.col("b").alias("x"))).distinct().join(gone, "x", "left_anti")
        touched = rest_edges.select(F.col("a").alias("x")).union(rest_edges.select(F.col("b").alias("x"))).distinct()
        heads = cut(heads.unionByName(alone.join(touched, "x", "left_anti")))
        edges = cut(rest_edges)
    heads = cut(heads.distinct())
    follows = every.join(heads, every.a == heads.x, "left_semi").groupBy(F.col("b.id").alias("id")).agg(F.min("a").alias("l"))
    follows = follows.join(heads.select(F.col("x.id").alias("id")), "id", "left_anti").select("id", F.col("l.id").alias("leader"))
    if decided is not None:
        follows = follows.unionByName(decided.where("id <> leader").groupBy("id").agg(F.min("leader").alias("leader")))
    out = everything.select(F.col(id_col).cast("long").alias("id")).join(follows, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("leader", "id").alias("leader"), F.col("leader").isNull().alias("is_leader"))


def _by_first(vectors: DataFrame, threshold: float, id_col: str, vector: str, order: str, batch: int) -> tuple[DataFrame | None, DataFrame]:
    """Rows that the leaders among the first ``batch`` rows decide as ``id, leader``, and the other vectors; None where that doesn't pay."""
    rows = vectors.where(F.col(vector).isNotNull())
    n = rows.count()
    if n <= batch or threshold <= 0:
        return None, vectors
    first = cut(rows.orderBy(order, F.col(id_col).cast("long")).limit(batch).select(F.struct(F.col(order).alias("o"), F.col(id_col).cast("long").alias("id")).alias("k"), vx.as_double(F.col(vector)).alias("v")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [(k["o"], k["id"]) for k in pdf.k]
        turn = sorted(range(len(keys)), key=keys.__getitem__)
        x, ids, at = nb.unit(pdf.v)[turn], [keys[i][1] for i in turn], []
        free = np.ones(len(x), bool)
        for i in range(len(x)):
            if free[i]:
                at.append(i)
                free[i + 1 :] &= ~(x[i + 1 :] @ x[i] >= threshold)
        return pd.DataFrame({"n": range(len(at)), "id": [ids[i] for i in at], "v": [x[i].tolist() for i in at]})

    heads = first.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "n long, id long, v array<double>").orderBy("n").toPandas()  # a batch at most
    x, ids = np.stack(heads.v.to_numpy()), heads.id.to_numpy()

    def follow(batches):
        for pdf in batches:
            found = np.full(len(pdf), len(ids))
            for a, b, _ in nb.reaching(nb.unit(pdf.v), x, threshold):
                np.minimum.at(found, a, b)
            mine = dict(zip(ids.tolist(), range(len(ids)), strict=True))
            found = np.array([mine.get(i, f) for i, f in zip(pdf.id.tolist(), found.tolist(), strict=True)], dtype=int)
            hit = found < len(ids)
            yield pd.DataFrame({"id": pdf.id[hit], "leader": ids[found[hit]]})

    spread = max(2 * rows.sparkSession.sparkContext.defaultParallelism, n // 20_000)
    held = cut(rows.select(F.col(id_col).cast("long").alias("id"), vx.as_double(F.col(vector)).alias("v")).repartition(spread).mapInPandas(follow, "id long, leader long"))
    if 3 * held.count() < n:
        return None, vectors
    return held, cut(rows.join(held.select(F.col("id").alias(id_col)), id_col, "left_anti"))


def _walk(edges: DataFrame) -> DataFrame:
    """Leaders among the rows of a bounded edge set, in one pass in order."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict = {}
        for a, b in zip(pdf.a, pdf.b, strict=True):
            a, b = (a["o"], a["id"]), (b["o"], b["id"])
            before.setdefault(a, [])
            before.setdefault(b, []).append(a)
        heads: set = set()
        for x in sorted(before):
            if not any(a in heads for a in before[x]):
                heads.add(x)
        return pd.DataFrame({"x": [{"o": o, "id": i} for o, i in sorted(heads)]})

    return edges.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, f"x {kind}")


#: Clusters that one task may finish by itself once the rounds have left so few; the rounds do not depend on it for the result.
CLUSTERS = 32_768


def average_linkage(vectors: DataFrame, threshold: float = 0.92, id_col: str = "vec_id", vector: str = "embedding", max_rounds: int = 200, rest: int = CLUSTERS) -> DataFrame:
    """Agglomerative clusters cut where the mean similarity of two clusters falls below ``threshold``: ``id, cluster`` (smallest member).

    Clusters that are each other's nearest merge in the same round.  Average linkage never makes a merged cluster nearer to
    a third one than the nearer of its parts was, so that gives the clusters of the one-by-one procedure, a cluster's
    nearest stays so until either merges, and one that reaches no other never will.  A cluster is its size and its sum of
    unit vectors; the mean similarity of two is the product of their mean vectors, so no edges are kept: only clusters
    whose nearest has merged look for another among those left.  Edges of equal similarity rank by their smaller, then
    larger id.  When at most ``rest`` clusters are left one task goes on by itself, which ends the many rounds that merge
    little.  Raises if ``max_rounds`` does not suffice; thresholds are above 0.
    """
    if threshold <= 0:
        raise ValueError("average linkage needs a threshold above 0")
    unit = "transform(v, x -> x / sqrt(aggregate(v, 0D, (a, y) -> a + y * y)))"
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("c"), vx.as_double(F.col(vector)).alias("v")).where(vx.norm(F.col("v")) > 0)
    clusters = cut(rows.select("c", F.lit(1).cast("long").alias("n"), F.expr(unit).alias("s")))
    mean = lambda df: df.select("c", F.transform("s", lambda x: x / F.col("n")).alias("m"))
    rank = F.struct(F.col("sim").alias("sim"), (-F.col("o")).alias("o"))
    merges, near, asking = None, None, clusters
    for _ in range(max_rounds):
        if clusters.count() <= rest:
            last = _merge_rest(clusters, threshold)
            merges = cut(last if merges is None else merges.unionByName(last))
            break
        found = cut(nb.nearest_means(mean(asking), mean(clusters), threshold))
        # What is found may be nearer to the other one, too, by rounding.
        both = found.unionByName(found.select(F.col("o").alias("c"), F.col("c").alias("o"), "sim"))
        both = both if near is None else both.unionByName(near)
        near = cut(both.groupBy("c").agg(F.max(rank).alias("e")).select("c", (-F.col("e.o")).alias("o"), F.col("e.sim").alias("sim")))
        other = near.select(F.col("c").alias("o"), F.col("o").alias("back"))
        # Of all edges the best is the best of both its ends: every round merges something.
        step = cut(near.join(other, "o").where("back = c AND c < o").select(F.col("c").alias("a"), F.col("o").alias("b")))
        if step.isEmpty():
            break
        merges = step if merges is None else merges.unionByName(step)
        into = step.select(F.col("b").alias("c"), F.col("a").alias("t"))
        moved = clusters.join(near.select("c"), "c", "left_semi").join(into, "c", "left").select(F.coalesce("t", "c").alias("c"), "n", "s", F.col("c").alias("own"))
        # Two rows at most meet in one.
        two = moved.groupBy("c").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("own", "s"))).alias("p"))
        clusters = cut(two.select("c", "n", F.when(F.size("p") == 1, F.col("p")[0]["s"]).otherwise(F.zip_with(F.col("p")[0]["s"], F.get("p", 1)["s"], lambda x, y: x + y)).alias("s")))
        gone = step.select(F.col("a").alias("x")).union(step.select(F.col("b").alias("x")))
        near = cut(near.join(gone, near.c == gone.x, "left_anti").join(gone, F.col("o") == gone.x, "left_anti"))
        asking = clusters.join(near.select("c"), "c", "left_anti")
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    out = vectors.select(F.col(id_col).cast("long").alias("id"))
    if merges is None:
        return out.select(F.col("id").alias(id_col), F.col("id").alias("cluster"))
    comps = connected_components(merges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return out.join(comps, "id", "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("cluster"))


def _merge_rest(clusters: DataFrame, threshold: float) -> DataFrame:
    """Merges ``a, b`` of a bounded set of clusters ``c, n, s``, by the same rounds in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        ids, n, s, out = pdf.c.to_numpy(), pdf.n.to_numpy().astype(float), np.stack(pdf.s.to_numpy()), []
        near, sims = np.full(len(ids), -1), np.full(len(ids), -np.inf)
        live = asking = np.arange(len(ids))
        while len(asking):
            mean = s / n[:, None]
            for q, o, sim in nb.nearest(mean[asking], asking, mean[live], live, 1, None, threshold):
                for c, d in ((q, o), (o, q)):  # what is found may be nearer to the other one, too, by rounding
                    best = nb._best(c, d, sim, 1)
                    c, d, x = c[best], d[best], sim[best]
                    better = (near[c] < 0) | (x > sims[c]) | ((x == sims[c]) & (d < near[c]))
                    near[c[better]], sims[c[better]] = d[better], x[better]
            live = live[near[live] >= 0]
            a = live[(near[near[live]] == live) & (live < near[live])]
            if not len(a):
                break
            b = near[a]
            out.append(pd.DataFrame({"a": ids[a], "b": ids[b]}))
            s[a] += s[b]
            n[a] += n[b]
            merged = np.zeros(len(ids), bool)
            merged[a] = merged[b] = True
            live = np.setdiff1d(live, b)
            asking = live[merged[live] | merged[near[live]]]
            near[asking], sims[asking] = -1, -np.inf
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return clusters.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "a long, b long")


def merge_by_centroid(members: DataFrame, threshold: float = 0.90, cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """Merge clusters whose mean vectors reach ``threshold``, transitively: ``cluster, merged`` (the smallest cluster id).

    Clusters without vectors stay by themselves.
    """
    means = vx.mean_vector(members.where(F.col(vector).isNotNull()), [cluster], vector)
    pairs = nb.similarity_join(means.select(F.col(cluster).alias("vec_id"), F.col("mean").alias("embedding")), threshold)
    comps = connected_components(pairs.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    every = members.select(F.col(cluster).cast("long").alias(cluster)).distinct()
    return every.join(comps.withColumnRenamed("id", cluster), cluster, "left").select(cluster, F.coalesce("component", cluster).alias("merged"))


def purity(members: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of rows in the majority label of their cluster."""
    counts = members.groupBy(cluster, label).agg(F.count("*").alias("c")).groupBy(cluster).agg(F.max("c").alias("m"), F.sum("c").alias("n"))
    return counts.agg(F.round(F.sum("m") / F.sum("n"), 6).alias("purity"), F.count("*").alias("n_clusters"), F.sum("n").alias("n_rows"))


def quality(members: DataFrame, cluster: str, vector: str = "embedding") -> DataFrame:
    """Mean similarity within and between clusters, their gap, singletons and median size.

    Pair sums follow from the sums of unit vectors, so no pair is ever formed.
    """
    unit = members.select(cluster, vx.as_double(F.col(vector)).alias("v")).select(cluster, F.expr("transform(v, x -> x / nullif(sqrt(aggregate(v, 0D, (a, y) -> a + y * y)), 0))").alias("v"))
    dims = unit.select(cluster, F.posexplode("v").alias("i", "x"))
    by = cut(dims.groupBy(cluster, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n")))
    inside = by.groupBy(cluster).agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("sim"), F.max("n").alias("n"))
    sums = inside.agg(
        F.sum("sim").alias("intra"),
        F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"),
        F.count("*").alias("n_clusters"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.percentile("n", F.lit(0.5)).alias("median_size"),
        F.sum("n").alias("total"),
    )
    whole = by.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("all_sim"))
    a, b = sums.first(), whole.first()
    all_pairs = a["total"] * (a["total"] - 1) / 2
    intra = a["intra"] / a["pairs"] if a["pairs"] else None
    inter = (b["all_sim"] - a["intra"]) / (all_pairs - a["pairs"]) if all_pairs > a["pairs"] else None
    row = [(intra, inter, a["n_clusters"], a["singletons"], float(a["median_size"]))]
    out = members.sparkSession.createDataFrame(row, "intra double, inter double, n_clusters long, singletons long, median_size double")
    return out.select(F.round("intra", 6).alias("intra_mean"), F.round("inter", 6).alias("inter_mean"), F.round(F.col("intra") - F.col("inter"), 6).alias("gap"), "n_clusters", "singletons", "median_size")


def best_duplicate(df: DataFrame, group: str, text_col: str, score: str, order: str) -> DataFrame:
    """Of each group the row with the best ``.4 * length share + .6 * score``.

    Null groups are one group.  Rows without a value (null text or score, or a group of empty texts) come last, null orders behind others.
    """
    longest = F.max(F.length(text_col)).over(Window.partitionBy(group))
    value = 0.4 * F.length(text_col) / F.nullif(longest, F.lit(0)) + 0.6 * F.col(score)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("_value"), F.asc_nulls_last(order)))
    return df.withColumn("_value", value).withColumn("_rn", rank).where("_rn = 1").drop("_value", "_rn")


def kmeans_tree(vectors: DataFrame, stop: int = 5, ratio: int = 10, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding", size: int = cells.SIZE) -> DataFrame:
    """KMeans hierarchy: n // ratio clusters a level until ``stop`` nodes or fewer: ``level, node, parent``.

    Parents carry the mean vector of their children as summary.  Levels shrink by ``ratio``.  So many clusters take n * n
    distances a step, so a level of over ``size`` nodes is clustered within cells of that size (``cells.kmeans``).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    level = 0
    nodes = vectors.select(F.col(id_col).cast("long").alias("node"), vx.as_double(F.col(vector)).alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        n = nodes.count()
        k = n // ratio
        if n <= stop or k < 1:
            top = nodes.select(F.lit(level).alias("level"), "node", F.lit(None).cast("long").alias("parent"))
            return top if out is None else out.unionByName(top)
        if n > size:
            step, parents = cells.kmeans(nodes, k, size, seed)
            step = step.select(F.lit(level).alias("level"), "node", "parent")
            out = step if out is None else out.unionByName(step)
            nodes, level = parents, level + 1
            continue
        feats = cut(nodes.withColumn("features", array_to_vector("v")))
        model = KMeans(k=max(k, 2) if n > ratio else 1, seed=seed, maxIter=20).fit(feats) if k >= 2 else None
        if model is None:
            assigned = feats.withColumn("parent", F.lit(0).cast("long"))
            parents = vx.mean_vector(assigned, ["parent"], "v").select(F.col("parent").alias("node"), F.col("mean").alias("v"))
        else:
            assigned = model.transform(feats).withColumn("parent", F.col("prediction").cast("long"))
            parents = assigned.select(F.col("parent").alias("node"), vector_to_array("features").alias("v"))
            parents = vx.mean_vector(parents, ["node"], "v").select("node", F.col("mean").alias("v"))
        step = assigned.select(F.lit(level).alias("level"), "node", "parent")
        out = step if out is None else out.unionByName(step)
        nodes, level = cut(parents), level + 1

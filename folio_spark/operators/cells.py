"""KMeans of many clusters within cells of bounded size, so that its work grows with the vectors and not with their square."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.functions.graph import cut

#: Distinct vectors of a cell at most, and parts that one round splits a cell into at most.
SIZE = 8_192
FAN = 64


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def _dealt(cells: np.ndarray, x: np.ndarray, centres: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    """Number of each row's nearest centre among those of its cell (``first number, centres``); -1 for other cells."""
    out = np.full(len(cells), -1, "int64")
    order = np.argsort(cells, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        if len(rows) and (mine := centres.get(int(cells[rows[0]]))):
            out[rows] = mine[0] + _nearest(x[rows], mine[1])
    return out


def _moved(points: DataFrame, centres: dict[int, tuple[int, np.ndarray]]) -> dict[int, tuple[int, np.ndarray]]:
    """The centres after one step; one without rows stays. Every task hands on one sum a centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, None
        for b in batches:
            if not b.num_rows:
                continue
            x, w = _matrix(b.column("v")), b.column("w").to_numpy()
            if total is None:
                last = max(first + len(c) for first, c in centres.values())
                total, count = np.zeros((last, x.shape[1])), np.zeros(last, "int64")
            to = _dealt(b.column("cell").to_numpy(), x, centres)
            x, w, to = x[to >= 0], w[to >= 0], to[to >= 0]
            np.add.at(total, to, x * w[:, None])
            np.add.at(count, to, w)
        if total is not None:
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"c": hit, "n": count[hit], "s": pa.array(list(total[hit]), pa.list_(pa.float64()))})

    sums = points.mapInArrow(run, "c long, n long, s array<double>").select("c", "n", F.posexplode("s").alias("i", "x"))
    means = sums.groupBy("c", "i").agg((F.sum("x") / F.sum("n")).alias("x")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    new = {r["c"]: np.array(r["p"]) for r in means.select("c", F.transform("p", lambda p: p["x"]).alias("p")).collect()}
    return {cell: (first, np.stack([new.get(first + j, old) for j, old in enumerate(c)])) for cell, (first, c) in centres.items()}


def split(points: DataFrame, size: int = SIZE, fan: int = FAN, seed: int = 42, steps: int = 4, rounds: int = 8) -> tuple[DataFrame, dict[int, int]]:
    """``points(v, w, h)``, distinct vectors with a hash, in cells of ``size`` at most: with ``cell``, and the cells' sizes.

    A cell that is too large is split around ``fan`` centres at most, which ``steps`` steps of KMeans over its rows move;
    after ``rounds`` such rounds the rest is dealt by hash.  The driver holds the centres: a few a cell.
    """
    points, level = points.withColumn("cell", F.lit(0).cast("long")), 0
    while True:
        sizes = {r["cell"]: r["n"] for r in points.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        big = {c: min(fan, -(-2 * n // size)) for c, n in sizes.items() if n > size}
        if not big:
            return points, sizes
        start = dict(zip(sorted(sizes), np.cumsum([0] + [big.get(c, 1) for c in sorted(sizes)]).tolist(), strict=False))
        parts = points.sparkSession.createDataFrame([(c, big.get(c, 1), start[c]) for c in sizes], "cell long, parts long, start long")
        draw = F.xxhash64("h", F.lit(seed + level))
        if level < rounds:
            named = points.join(F.broadcast(parts), "cell").where("parts > 1").select("cell", F.pmod(draw, "parts").alias("slot"), draw.alias("d"), "v")
            drawn: dict[int, list] = {}
            for r in named.groupBy("cell", "slot").agg(F.min_by("v", "d").alias("v")).orderBy("cell", "slot").collect():
                drawn.setdefault(r["cell"], []).append(r["v"])
            # Parts are numbered in the order of their cells; a cell that fits keeps one number.
            centres, whole, first = {}, {}, 0
            for cell in sorted(sizes):
                if cell in drawn:
                    centres[cell] = (first, np.array(drawn[cell]))
                else:
                    whole[cell] = first
                first += len(drawn.get(cell, [0]))
            for _ in range(steps):
                centres = _moved(points, centres)

            def run(batches: Iterator[pa.RecordBatch], centres=centres, whole=whole) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        cells = b.column("cell").to_numpy()
                        to = _dealt(cells, _matrix(b.column("v")), centres)
                        stay = to < 0
                        to[stay] = [whole[c] for c in cells[stay].tolist()]
                        yield b.set_column(b.schema.get_field_index("cell"), "cell", pa.array(to))

            points = cut(points.mapInArrow(run, points.schema))
        else:
            dealt = points.join(F.broadcast(parts), "cell")
            points = cut(dealt.withColumn("cell", F.col("start") + F.pmod(draw, "parts")).drop("parts", "start"))
        level += 1


def _fit(x: np.ndarray, w: np.ndarray, k: int, seed: int, steps: int) -> np.ndarray:
    """Cluster of each row: Lloyd's steps from centres drawn by their squared distance to those before (k-means++)."""
    rng = np.random.RandomState(seed)
    square = (x * x).sum(1)
    at = rng.choice(len(x), p=w / w.sum())
    centres, near = [at], None
    for _ in range(k - 1):
        d = np.maximum(square - 2 * (x @ x[at]) + square[at], 0)
        d[at] = 0
        near = d if near is None else np.minimum(near, d)
        chance = near * w
        at = rng.choice(len(x), p=chance / chance.sum()) if chance.sum() > 0 else rng.randint(len(x))
        centres.append(at)
    centres, label = x[centres], None
    for _ in range(steps):
        now = _nearest(x, centres)
        if label is not None and (now == label).all():
            break
        label = now
        n = np.bincount(label, w, k)
        sums = np.stack([np.bincount(label, x[:, i] * w, k) for i in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return label


def kmeans(nodes: DataFrame, k: int, size: int = SIZE, seed: int = 42, steps: int = 20) -> tuple[DataFrame, DataFrame]:
    """``k`` clusters of ``nodes(node, v)`` (fewer if their vectors are): ``node, parent`` and the clusters' means ``node, v``.

    Equal vectors are one weighted point.  Points meet in cells of ``size`` at most; each cell gets its share of ``k`` and
    clusters its points by itself, in one task.
    """
    weighted = nodes.groupBy("v").agg(F.count("*").alias("w")).withColumn("h", F.xxhash64("v"))
    points, sizes = split(cut(weighted), size, seed=seed)
    total, spark = sum(sizes.values()), nodes.sparkSession
    k = min(k, total)
    # Neighbouring cells share a group while it stays within the size, and until it has a share of k.
    groups: list[list[int]] = []
    for cell in sorted(sizes):
        last = sum(sizes[c] for c in groups[-1]) if groups else 0
        if groups and (last + sizes[cell] <= size or last * k < 2 * total):
            groups[-1].append(cell)
        else:
            groups.append([cell])
    if len(groups) > 1 and sum(sizes[c] for c in groups[-1]) * k < 2 * total:
        groups[-2] += groups.pop()
    plan, before = [], 0
    for g, cells in enumerate(groups):
        after = before + sum(sizes[c] for c in cells)
        low, high = before * k // total, after * k // total
        plan += [(c, g, low, high - low) for c in cells]
        before = after

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        x, w = np.stack(pdf.v.to_numpy()), pdf.w.to_numpy().astype(float)
        label = _fit(x, w, int(pdf["k"].iloc[0]), seed, steps)
        first = ~pd.Series(label).duplicated().to_numpy()  # one row a cluster bears the mean
        mean = [np.average(x[label == c], axis=0, weights=w[label == c]) if f else None for c, f in zip(label, first, strict=True)]
        return pd.DataFrame({"v": list(pdf.v), "parent": label + int(pdf["first"].iloc[0]), "mean": mean})

    named = points.join(F.broadcast(spark.createDataFrame(plan, "cell long, g long, first long, k long")), "cell").select("g", "first", "k", "v", "w", "h")
    found = cut(named.groupBy("g").applyInPandas(run, "v array<double>, parent long, mean array<double>"))
    return nodes.join(found, "v").select("node", "parent"), found.where("mean IS NOT NULL").select(F.col("parent").alias("node"), F.col("mean").alias("v"))

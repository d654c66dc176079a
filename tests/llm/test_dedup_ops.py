"""Embedding, Jaccard, suffix and benchmark operators against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio_spark.llm import op2_embedding, op4_repeats, op5_decontaminate, op6_jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())


def prose(rng, n, vocab=400):
    return [f"w{int(i)}" for i in rng.randint(0, vocab, n)]


def find(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def union(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


# -- embeddings -------------------------------------------------------------------------------


def test_hadamard_keeps_norms():
    x = np.random.RandomState(0).standard_normal((3, 64))
    assert np.allclose(np.linalg.norm(op2_embedding.hadamard(x), axis=1), 8 * np.linalg.norm(x, axis=1))


def test_recall_at_the_threshold():
    """Pairs of cosine 0.98 exactly meet in a probed bucket."""
    rng = np.random.RandomState(1)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.standard_normal(a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * n
    x, y = op2_embedding.buckets(a).reshape(1500, -1), op2_embedding.buckets(b).reshape(1500, -1)
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() > 0.97


@pytest.mark.parametrize("block", [4, 512])
def test_embedding_links(spark, block):
    rng = np.random.RandomState(2)
    base = rng.standard_normal((6, 10))
    rows = [(i, int(i % 2), (base[i % 6] * (1 + i) + 0.02 * rng.standard_normal(10)).tolist()) for i in range(60)]
    odd = [(100, 1, None), (101, 1, [0.0] * 10), (102, 1, [float("nan")] + [1.0] * 9), (103, None, rows[0][2]), (104, 1, [None] + [1.0] * 9), (105, 0, [1e200] + [0.0] * 9), (106, 0, [2e-200] + [0.0] * 9), (107, 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r for r in op2_embedding.near_duplicates(df, block=block).collect()}
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parent, links = {i: i for i in range(60)}, dict.fromkeys(range(60), 0)
    for i in range(60):
        for j in range(i):
            if rows[i][1] == rows[j][1] and x[i] @ x[j] >= 0.98:
                union(parent, i, j)
                links[i] += 1
                links[j] += 1
    for i in range(60):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], find(parent, i), find(parent, i) == i)
    for i in (100, 101, 102, 103, 104, 107):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[105].component_id, got[106].component_id, got[106].n_links) == (105, 105, 1)
    assert op2_embedding.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_truncated_copies_part_no_links(spark, block):
    """60-wide copies share buckets with 64-wide vectors, which link among themselves all the same."""
    rng = np.random.RandomState(4)
    base = rng.standard_normal(64)
    base[60:] = 0
    rows = [(i, 0, (base + 0.02 * rng.standard_normal(64)).tolist()) for i in range(12)]
    rows += [(100 + i, 0, rows[i][2][:60]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op2_embedding.near_duplicates(df, block=block).collect()}
    assert got == {i: (11, 0) for i in range(12)} | {100 + i: (2, 100) for i in range(3)}


def test_repeated_ids_and_equal_vectors(spark):
    """Rows of one id are one vector; copies of a vector link without being compared; null ids link with nothing."""
    v, w = [1.0, 2.0, 0.5, -1.0], [-1.0, 0.3, 2.0, 0.1]
    rows = [(1, 0, v)] * 5 + [(2, 0, v), (3, 0, [2 * x for x in v]), (4, 0, w), (4, 0, v), (5, 0, w), (6, 1, v), (None, 0, v), (None, 0, None), (7, 0, []), (8, 0, [0.0, -0.0, 1.0, 1.0]), (9, 0, [-0.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("component_id", F.lit(1)).withColumn("key", F.lit("x"))
    got = sorted((tuple(r) for r in op2_embedding.near_duplicates(df).collect()), key=str)
    v_links = 3  # of 1, 2, 3 and the one vector of 4
    want = [(1, v_links, 1, True)] * 5 + [(2, v_links, 1, False), (3, v_links, 1, False), (4, 1, 1, False), (4, v_links, 1, False), (5, 1, 1, False), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (None, 0, None, None), (None, 0, None, None)]
    assert got == sorted(want, key=str)


# -- n-gram Jaccard ---------------------------------------------------------------------------


def brute_jaccard(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                union(parent, a, b)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "share"), [(4, 85, 3e-4), (5, 80, 0.05), (1, 85, 0.2)])
def test_jaccard_components(spark, n, percent, share):
    rng = np.random.RandomState(n)
    rows = []
    line = prose(rng, 30)
    for g in range(12):
        base = prose(rng, int(rng.randint(5, 120))) + (line if g % 3 == 0 else [])
        for _ in range(int(rng.randint(1, 12))):
            w = list(base)
            for _ in range(int(rng.randint(0, 4))):
                w[int(rng.randint(len(w)))] = f"e{int(rng.randint(50))}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900 + i, " ".join(line)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(df, n, percent, common_share=share).collect()}
    assert got == brute_jaccard(rows, n, percent)


#: The two smallest of the 13 shingles of FAR and NEAR are the same, the others are not.
FAR = "w727729 w928742 w694138 w825472 w544406 w404199 w624285 w497085 w155643 w746490 w648974 w981352 w929310 w906376 w391336 w426928"
NEAR = "w143267 w470719 w524667 w68128 w810606 w452443 w727729 w928742 w694138 w825472 w544406 w87137 w683462 w239268 w957330"


def test_members_of_a_group_link_without_its_head(spark):
    # Equal sizes and prefixes make one group; its head links with neither of the two that link.
    rows = [(1, FAR), (2, f"{NEAR} w215835"), (3, f"{NEAR} w998044")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(rows, 4, 85) == {1: (13, 1), 2: (13, 2), 3: (13, 2)}


@pytest.mark.parametrize("copies", [2, 3])
def test_copies_of_a_row_lose_no_link(spark, copies):
    rows = [(1, FAR), (2, f"{NEAR} w215835")] + copies * [(3, f"{NEAR} w215835 w998044")]
    got = sorted((r.doc_id, r.component_id) for r in op6_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 2)] + copies * [(3, 2)]


def test_sets_are_joined_once_whatever_copies(spark):
    rows = 20 * [(1, "a b c d e f g h")] + 20 * [(2, "a b c d e f g h i")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert op6_jaccard._of_wanted(df, 4, df.select("id").distinct(), "set", "array<long>", lambda s: s).count() == 2


def test_jaccard_edges(spark, docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(docs).collect())
    assert got == [(1, 5, 1), (2, 5, 1), (2, 5, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8)]
    assert op6_jaccard.jaccard_components(docs.limit(0)).count() == 0


# -- suffix arrays ----------------------------------------------------------------------------


def brute_repeats(rows, least):
    seen, marked = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        for p in range(len(w) - least + 1):
            k = tuple(w[p : p + least])
            if seen.setdefault(k, i) != i:
                marked.setdefault(i, set()).update(range(p, p + least))
    return marked


@pytest.mark.parametrize("slab", [7, 40_000])
def test_repeated_spans(spark, monkeypatch, slab):
    monkeypatch.setattr(op4_repeats, "SLAB", slab)
    rng = np.random.RandomState(5)
    passages = [prose(rng, n, 5000) for n in (20, 24, 40, 90)]
    rows = []
    for i in range(40):
        w = prose(rng, int(rng.randint(0, 60)), 5000)
        for _ in range(int(rng.randint(0, 3))):
            w += passages[int(rng.randint(4))] + prose(rng, 5, 5000)
        rows.append((i, " ".join(w)))
    rows += [(50, rows[3][1]), (51, rows[3][1].upper()), (52, " ".join(["same"] * 200)), (53, " ".join(["same"] * 150))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in op4_repeats.repeated_spans(df, 20).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        a, b = dict(rows)[r.doc_id], dict(rows)[r.source_id]
        assert r.source_id < r.doc_id and words(a)[r.start_word] is not None and words(b)
    assert got == brute_repeats(rows, 20)


def marked(spark, rows, least):
    got = {}
    for r in op4_repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), least).collect():
        assert r.source_id < r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return got


def test_repeats_of_a_passage_within_a_later_document(spark):
    """A document that holds a passage several times in equal surroundings: all of its places are marked."""
    rng = np.random.RandomState(6)
    p = prose(rng, 60, 5000)
    rows = [(1, " ".join(["x", *p, "y"])), (2, " ".join(["a", *p, "b"] * 3)), (3, " ".join(prose(rng, 40, 5000) + ["a", *p, "b"] * 2))]
    got = marked(spark, rows, 50)
    assert got == brute_repeats(rows, 50)
    assert len(got[2]) == 180


@pytest.mark.parametrize("lead", [5, 15, 20])
def test_repeats_around_a_frequent_line(spark, lead):
    """Pairs of documents share words before a line that all documents hold, and nothing after it."""
    rng = np.random.RandomState(lead)
    line = prose(rng, 55 - lead if lead > 5 else 45, 9000)
    heads = [prose(rng, lead, 9000) for _ in range(60)]
    rows = [(i, " ".join(prose(rng, 30, 9000) + heads[i % 60] + line + prose(rng, 40, 9000))) for i in range(120)]
    got = marked(spark, rows, 50)
    assert got == brute_repeats(rows, 50)
    assert len(got) == 60


def test_dropping_repeats(spark, docs):
    p = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a b {p} c", 0), (2, f"x {p}  y\nz", 9), (3, p, 9), (4, None, None), (5, "", 0), (6, "short", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in op4_repeats.drop_repeats(df).collect()}
    assert got == {1: (f"a b {p} c", 0), 2: ("x y\nz", 5), 4: (None, None), 5: ("", 0), 6: ("short", 5)}
    assert op4_repeats.repeated_spans(docs.limit(0)).count() == 0 and op4_repeats.repeated_spans(docs).count() == 0
    odd = df.withColumns({"spans": F.lit(1), "span_id": F.lit("x"), "_spans": F.lit(2)}).unionByName(df.withColumns({"doc_id": F.lit(None).cast("long"), "spans": F.lit(1), "span_id": F.lit("x"), "_spans": F.lit(2)}))
    left = op4_repeats.drop_repeats(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [1, 2, 4, 5, 6] and left.where("doc_id IS NULL").count() == 6


def test_merging_marks():
    import pyarrow as pa

    marks = [[(0, 50, 1, 7), (10, 60, 2, 0), (60, 90, 3, 1), (91, 95, 4, 4)], [(5, 6, 1, 1)]]
    columns = [pa.array([8, 9])] + [pa.array([[m[k] for m in row] for row in marks], pa.list_(pa.int64())) for k in range(4)]
    got = [tuple(r.values()) for b in op4_repeats._merge_marks([pa.RecordBatch.from_arrays(columns, list("abcde"))]) for r in b.column(1).to_pylist()]
    assert got == [(0, 90, 1, 7), (91, 95, 4, 4), (5, 6, 1, 1)]


# -- benchmark --------------------------------------------------------------------------------


def test_leaks(spark):
    rng = np.random.RandomState(9)
    items = [(i, " ".join(prose(rng, 12 + 3 * i, 3000))) for i in range(8)] + [(8, None), (9, ""), (10, "tiny item"), (11, None)]
    near = items[7][1].split()
    near[0] = "changed"
    rows = [
        (1, " ".join(prose(rng, 50)) + " " + items[3][1].upper() + ". " + " ".join(prose(rng, 9))),
        (2, items[5][1]),
        (3, " ".join(prose(rng, 80))),
        (4, items[2][1] + " , " + items[6][1]),
        (5, "start " + " ".join(near) + " end"),
        (6, " ".join(items[4][1].split()[: len(items[4][1].split()) // 2])),
        (7, None),
        (8, ""),
        (9, "a tiny item b"),
        (2, items[5][1]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in op5_decontaminate.find_leaks(df, bench).collect()}
    assert got[(5, 7)] == pytest.approx(28 / 30, abs=0.01)
    assert {k for k in got if k != (5, 7)} == {(1, 3), (2, 5), (4, 2), (4, 6), (9, 10)}
    assert all(got[k] == 1 for k in got if k != (5, 7))
    assert sorted(r.doc_id for r in op5_decontaminate.drop_leaking(df, bench).collect()) == [3, 6, 7, 8]
    plan = op5_decontaminate.find_leaks(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert op5_decontaminate.find_leaks(df.limit(0), bench).count() == 0 and op5_decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def brute_leaks(rows, items):
    """Every item-sized window of every text against every item: weighted Jaccard of shingle sets."""
    split = lambda t: [x for x in re.split(op5_decontaminate.BREAK, (t or "").translate(LOWER)) if x]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = {i: (len(split(t)), shingles(split(t))) for i, t in items if split(t)}
    df = {}
    for _, s in sets.values():
        for h in s:
            df[h] = df.get(h, 0) + 1
    weigh = lambda s: sum(math.log1p(len(sets) / df.get(h, 1)) if h in df else math.log1p(len(sets)) for h in s)
    out = {}
    for d, t in rows:
        w = split(t)
        for i, (n, s) in sets.items():
            for p in range(max(1, len(w) - n + 1)) if w else ():
                x = shingles(w[p : p + n])
                both = weigh(x & s)
                sim = both / (weigh(x) + weigh(s) - both)
                if sim >= 0.8 - 1e-12:
                    out[d, i] = max(out.get((d, i), 0.0), sim)
    return out


def test_leaks_by_brute_force(spark):
    """Windows of all kinds of alteration, items of one to sixty words."""
    rng = np.random.RandomState(21)
    items = [(i, " ".join(prose(rng, int(n), 60 if i % 4 == 0 else 4000))) for i, n in enumerate([1, 2, 3, 4, 4, 5, 6, 7, *rng.randint(8, 60, 40)])]
    rows = []
    for d in range(150):
        w = items[int(rng.randint(len(items)))][1].split()
        for _ in range(int(rng.randint(0, 3))):
            k = int(rng.randint(len(w)))
            w[k : k + int(rng.randint(0, 2))] = prose(rng, int(rng.randint(0, 2)), 4000)
        rows.append((d, " ".join(prose(rng, int(rng.randint(0, 20)), 4000) + w + prose(rng, int(rng.randint(0, 20)), 4000))))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in op5_decontaminate.find_leaks(df, bench).collect()}
    want = brute_leaks(rows, items)
    assert got == pytest.approx(want, abs=1e-8) and len(want) > 80


def test_leaks_in_another_order(spark):
    """Halves swapped, sentences reversed, words between, two copies side by side: the best window lies where no single shingle aligns it."""
    rng = np.random.RandomState(22)
    items = [(i, " ".join(prose(rng, int(n), 4000))) for i, n in enumerate([60, 60, 40, 25, 31, 12, 8, 80])]
    rows = []
    for d in range(96):
        w = items[d % len(items)][1].split()
        k = int(rng.randint(1, len(w)))
        kind = d % 4
        if kind == 0:
            w = w[k:] + w[:k]
        elif kind == 1:
            w = w[: len(w) // 2 + k % 3] + prose(rng, k % 4, 4000) + w[len(w) // 2 + k % 3 :]
        elif kind == 2:
            third = max(1, len(w) // 3)
            w = w[2 * third :] + w[third : 2 * third] + w[:third]
        else:
            w = w[k:] + w + w[:k]
        rows.append((d, " ".join(prose(rng, int(rng.randint(0, 50)), 4000) + w + prose(rng, int(rng.randint(0, 50)), 4000))))
    rows.append((900, " ".join(prose(rng, 40, 4000) + items[0][1].split()[30:] + items[0][1].split()[:30] + prose(rng, 40, 4000))))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in op5_decontaminate.find_leaks(df, bench).collect()}
    want = brute_leaks(rows, items)
    assert got == pytest.approx(want, abs=1e-8) and (900, 0) in want and len(want) > 40


def test_leaks_of_null_ids_and_clashing_columns(spark):
    rng = np.random.RandomState(22)
    item = " ".join(prose(rng, 30, 4000))
    rows = [(None, item, 1), (None, "clean words only here", 2), (3, "lead " + item, 3), (3, "clean words only here", 4), (4, " ".join(prose(rng, 40_000, 4000)) + " " + item, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int").withColumns({"id": F.lit(1), "c": F.lit("x"), "text_key": F.lit(0), "item_id": F.lit(9)})
    bench = spark.createDataFrame([(None, item), (1, item), (1, item)], "item_id long, text string").withColumn("s", F.lit(1))
    found = op5_decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(None, None), (None, 1), (3, None), (3, 1), (4, None), (4, 1)} and len(found) == 6
    left = op5_decontaminate.drop_leaking(df, bench)
    assert left.columns == df.columns and sorted(r.t for r in left.collect()) == [2, 4]


def test_multi_index_finds_all_within_the_radius(spark):
    """Fingerprints that differ in any ``RADIUS`` bits share a probed block; blocks hold every bit once."""
    rng = np.random.RandomState(23)
    assert [b for a, e in op5_decontaminate.block_edges() for b in range(a, e)] == list(range(128))
    rows = []
    for k in range(60):
        a = rng.randint(0, 2, 128)
        b = a.copy()
        far = rng.choice(128, op5_decontaminate.RADIUS, replace=False) if k % 2 else np.concatenate([rng.permutation(np.arange(x, y))[: 3 - (x == 0)] for x, y in op5_decontaminate.block_edges()])
        b[far] ^= 1
        word = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)
        rows.append((word(a[:64]), word(a[64:]), word(b[:64]), word(b[64:])))
    df = spark.createDataFrame(rows, "a0 long, a1 long, b0 long, b1 long")
    one, two = op5_decontaminate.block_keys([F.col("a0"), F.col("a1")]), op5_decontaminate.block_keys([F.col("b0"), F.col("b1")], op5_decontaminate.PROBE)
    assert df.where(F.size(F.array_intersect(one, two)) > 0).count() == 60

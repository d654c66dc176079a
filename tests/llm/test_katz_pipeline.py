"""Language model against a dictionary version; the pipeline's stages on planted cases."""

import base64
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio_spark.llm import katz_blocks, op9_katz
from folio_spark.llm.bytesops import Words, chunks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_word_hashes_depend_on_words_alone():
    import pyarrow as pa

    texts = pa.array(["One two\tthree", None, "", "three  ONE", "x" * 5000])
    seen = {}
    for limit in (1, 8, 1 << 20):
        got = []
        for _, _, data, off in chunks(texts, limit):
            w = Words(data, off)
            got += [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        seen[limit] = got
    assert seen[1] == seen[8] == seen[1 << 20]
    assert seen[1][0][0] == seen[1][3][1] and seen[1][0][2] == seen[1][3][0] and [len(x) for x in seen[1]] == [3, 0, 0, 2, 1]


def test_katz_against_dictionaries(spark, docs):
    rng = np.random.RandomState(3)
    zipf = lambda n: " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.4, n))
    rows = [(i, zipf(int(rng.randint(0, 40)))) for i in range(120)] + [(200, None), (201, "unseen words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = op9_katz.pair_rows(df, "doc_id", "text", F.col("doc_id") % 4 != 1)
    model = op9_katz.train_katz(pairs)
    got = {r.id: r for r in op9_katz.score_texts(pairs, model).collect()}
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for i, t in rows}
    train = [i for i in toks if i % 4 != 1]
    c = Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    b = Counter(p for i in train for p in zip(["S", *toks[i][:-1]], toks[i]))
    d1, d2 = op9_katz.good_turing(Counter(c.values())), op9_katz.good_turing(Counter(b.values()))
    disc = lambda d, r: d[r - 1] * r if r <= op9_katz.RELIABLE else r
    p = {w: disc(d1, r) / n for w, r in c.items()}
    unknown = 1 - sum(p.values())
    total, kept = Counter(), Counter()
    for (h, _), r in b.items():
        total[h] += r
        kept[h] += disc(d2, r)
    size = {h: t + 1 if kept[h] > t - 1e-6 else t for h, t in total.items()}
    pb = {k: disc(d2, r) / size[k[0]] for k, r in b.items()}
    weight = {}
    for h in total:
        mine = [(w, x) for (g, w), x in pb.items() if g == h]
        weight[h] = (1 - sum(x for _, x in mine)) / (1 - sum(p[w] for w, _ in mine))
        everything = sum(pb.get((h, w), weight[h] * p[w]) for w in p) + weight[h] * unknown
        assert everything == pytest.approx(1)
    assert model.tokens == n and model.types == v
    for i, t in toks.items():
        want = sum(math.log10(pb.get((h, w)) or weight.get(h, 1) * p.get(w, unknown)) for h, w in zip(["S", *t[:-1]], t))
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (got[i].n_tokens, got[i].n_known) == (len(t), sum(c[w] > 0 for w in t))
        assert got[i].score == pytest.approx(want) and got[i].base_score == pytest.approx(base)


@pytest.mark.parametrize("tokens", [50, 1_000_000])
def test_blocks_equal_tables(spark, tmp_path, tokens):
    rng = np.random.RandomState(4)
    rows = [(i, " ".join(f"w{min(int(x), 80)}" for x in rng.zipf(1.5, int(rng.randint(0, 60))))) for i in range(90)] + [(200, None), (201, ""), (5, "w1 w2")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    train = F.col("doc_id") % 3 != 1
    pairs = op9_katz.pair_rows(df.where("doc_id <> 5"), "doc_id", "text", train)
    got, shared = katz_blocks.score_corpus(df.where("doc_id <> 5"), "doc_id", "text", train, tokens)
    model = op9_katz.train_katz(pairs)
    want = {r.id: r for r in op9_katz.score_texts(pairs, model).collect()}
    got = {r.id: r for r in got.collect()}
    assert set(got) == set(want) and shared.tokens == model.tokens and shared.unknown == pytest.approx(model.unknown)
    for i, w in want.items():
        assert (got[i].train, got[i].n_tokens, got[i].n_known) == (w.train, w.n_tokens, w.n_known)
        assert got[i].score == pytest.approx(w.score) and got[i].base_score == pytest.approx(w.base_score)
    assert katz_blocks.score_corpus(df, "doc_id", "text", train, tokens)[0].where("id = 5").count() == 2
    odd = df.where("doc_id <> 5").withColumn("doc_id", F.when(F.col("doc_id") < 200, F.col("doc_id"))).withColumn("id", F.lit("x")).withColumn("t", F.lit(1))
    null, same = katz_blocks.score_corpus(odd, "doc_id", "text", F.col("doc_id").isNotNull() & (F.col("doc_id") % 3 != 1), tokens)
    assert null.where("id IS NULL").count() == 2 and same.tokens == shared.tokens - sum(w.n_tokens for i, w in want.items() if i == 200 or i == 201 and w.train)


def test_blocks_of_nothing(spark, docs):
    out, shared = katz_blocks.score_corpus(docs.where("doc_id > 99"), "doc_id", "text", F.lit(True))
    assert out.count() == 0 and shared.tokens == 0
    out, _ = katz_blocks.score_corpus(docs, "doc_id", "text", F.lit(False))
    assert out.count() == docs.count() and {r.score for r in out.collect()} == {0.0}


def test_packing():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([70000]), np.array([-1, 2**40]), np.array([2**63], np.uint64), np.array([0.5])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, katz_blocks.unpack(katz_blocks.pack(*arrays)), strict=True))


def test_katz_without_training(spark, docs):
    pairs = op9_katz.pair_rows(docs, "doc_id", "text", F.lit(False))
    model = op9_katz.train_katz(pairs)
    assert model.tokens == 0 and {r.score for r in op9_katz.score_texts(pairs, model).collect()} == {0.0}


def test_good_turing_falls_back():
    assert op9_katz.good_turing({}) == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
    d = op9_katz.good_turing({1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 75})
    assert all(0 < x < 1 for x in d)


def test_pipeline_on_planted_cases(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.RandomState(11)
    prose = lambda n: " ".join(f"v{int(i)}" for i in rng.randint(0, 3000, n))
    item, passage, base = prose(30), prose(70), prose(100)
    rows = [(i, prose(40) + (" scumbag" if i % 6 == 0 else "")) for i in range(600)]
    labels = [(i, int(i % 6 == 0)) for i in range(600)]
    rows += [(1000, base), (1001, base), (1002, base + " tail"), (1003, prose(20) + " " + passage), (1004, passage + " " + prose(20)), (1005, prose(9) + " " + item), (1006, ""), (1007, None), (1008, prose(30) + " scumbag")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1000, 1003, 1004, 1006, 1007} <= kept and not kept & {1001, 1002, 1005, 1008}
    toxic = {i for i, y in labels if y}
    assert len(kept & toxic) <= 2 and len(set(range(600)) - toxic - kept) <= 5
    stages = [f for _, f in corpus_pipeline.STAGES]
    part = stages[2](spark, docs, str(tmp_path))
    assert part.columns == docs.columns and len(part.where("doc_id = 1004").first().text.split()) == 20


def stage_input(spark, rows):
    """Documents with columns named like the stages' own, an extra one and null ids."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"score": F.lit(1), "text_key": F.lit("k"), "row": F.lit(2), "spans": F.lit(3), "span_id": F.lit(4), "id": F.lit("x"), "_score": F.lit(0)})


def test_jaccard_stage_by_brute_force(spark, tmp_path):
    """One row of each group: repeated rows, null ids, ties and texts without words included."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_dedup_ops import brute_jaccard

    rng = np.random.RandomState(31)
    base = [" ".join(f"v{int(i)}" for i in rng.randint(0, 900, 60)) for _ in range(8)]
    rows = [(i, base[i % 8] if i % 3 else base[i % 8] + f" tail{i}") for i in range(40)]
    rows += [rows[5], rows[5], (None, base[0]), (None, base[0]), (None, "alone in the world of words here"), (None, "alone in the world of words here"), (90, ""), (90, ""), (91, None), (None, None), (92, " \n")]
    docs = stage_input(spark, rows)
    got = corpus_pipeline.jaccard(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    comps = brute_jaccard([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    want = [r for k, r in enumerate(rows) if comps[k][0] == 0]
    groups = {}
    for k, r in enumerate(rows):
        if comps[k][0]:
            groups.setdefault(comps[k][1], []).append(r)
    want_ids = [min(g, key=order)[0] for g in groups.values()]
    assert sorted((r for r in kept if not (r[1] or "").split()), key=str) == sorted(want, key=str)
    assert sorted((r[0] for r in kept if (r[1] or "").split()), key=str) == sorted(want_ids, key=str)


def test_stages_on_odd_tables(spark, tmp_path):
    """Every stage keeps all columns, takes null ids and repeated rows, and one long text."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.RandomState(32)
    prose = lambda n: " ".join(f"v{int(i)}" for i in rng.randint(0, 3000, n))
    item, passage = prose(30), prose(60)
    rows = [(None, prose(40) + " scumbag"), (1, passage), (2, prose(5) + " " + passage), (None, item), (3, "ok " + item), (4, prose(60_000)), (5, None), (6, ""), (7, prose(50)), (7, prose(50))]
    train = [(100 + i, prose(20) + (" scumbag" if i % 4 == 0 else "")) for i in range(300)]
    docs = stage_input(spark, rows + train)
    spark.createDataFrame([(i, 1, int("scumbag" in t)) for i, t in train], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tox = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert tox.columns == docs.columns and tox.where("doc_id IS NULL").count() == 1 and tox.where("doc_id < 100").count() == 8
    cut = corpus_pipeline.suffix_dedup(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and cut.where("doc_id IS NULL").count() == 2 and len(cut.where("doc_id = 2").first().text.split()) == 5
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.where("doc_id IS NULL").count() == 1 and {r.doc_id for r in clean.where("doc_id < 100").collect()} == {1, 2, 4, 5, 6, 7}
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = corpus_pipeline.byte_bpe(spark, docs, str(tmp_path)).collect()
    texts = sorted((t or "") for _, t in rows + train)
    assert sorted(bytes(r.ids) for r in ids) == sorted(struct.pack(f"<{len(x)}I", *x) for x in map(enc.encode_ordinary, texts))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_hold_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """A worker and the executor beside it hold whole batches: their bytes are bounded, however long the texts are."""
    import corpus_pipeline as cp
    from folio_spark.llm import base, op3_toxicity, op4_repeats, op6_jaccard, op7_bpe

    seen = str(tmp_path / "seen")
    lean = base.lean

    def spy(run):
        def counted(batches):
            for batch in batches:
                with open(seen, "a") as f:
                    f.write(f"{batch.nbytes}\n")
                yield batch

        return lean(lambda batches: run(counted(batches)))

    for module in (base, op3_toxicity, op4_repeats, op6_jaccard, op7_bpe):
        monkeypatch.setattr(module, "lean", spy, raising=False)
    d = str(tmp_path)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.concat(F.lit("w"), F.col("id") * 1500 + i)))
    docs = spark.range(1, 1001, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source")).withColumn("n_chars", F.length("text").cast("int"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    whole = sum(len(r.text) for r in docs.select("text").collect())
    assert whole > 10_000_000
    for name, stage in cp.STAGES:
        if name != "decontamination":  # runs no Python
            out = stage(spark, spark.read.parquet(f"{d}/documents.parquet").coalesce(1), d)
            assert 0 < out.count() <= 1000, name
            sizes = [int(x) for x in open(seen).read().split()]
            assert 2_000_000 < max(sizes) < 5_000_000, (name, max(sizes))
            open(seen, "w").close()

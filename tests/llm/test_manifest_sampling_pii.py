"""Merkle manifest, importance resampling and personal data against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio_spark.llm import op11_merkle as mk
from folio_spark.llm import op12_resample as rs
from folio_spark.llm import op13_pii as pii
from folio_spark.llm import ranks


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- ranks ------------------------------------------------------------------------------------


@pytest.mark.parametrize("full", [4096, 3])
def test_radix_ranks(spark, full):
    """Sparse, negative, null and shared ids; with ``full`` at 3, digits of the digest split the blocks."""
    rng = random.Random(1)
    ids = [None] * 5 + [7] * 40 + [rng.randint(-(2**63), 2**63 - 1) for _ in range(60)] + list(range(30)) + [-1, -1024, -1025, 2**63 - 1, -(2**63)]
    rows = [(rng.choice(["", "=", "=a"]), i, sha(str(k)), rng.choice([1, 1, 3])) for k, i in enumerate(ids)]
    got = {r["digest"]: r["rank"] for r in ranks.radix_ranks(spark.createDataFrame(rows, "g string, id long, digest string, n long"), full).collect()}
    at = Counter()
    for g, _, d, n in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        assert got[d] == at[g]
        at[g] += n
    assert len(got) == len(rows)


def test_range_ranks(spark):
    rows = [(i % 7, i, 1 + i % 3) for i in range(200)]
    got = {r["b"]: r["rank"] for r in ranks.range_ranks(spark.createDataFrame(rows, "a long, b long, n long").repartition(5), [F.desc("a"), F.asc("b")], "n").collect()}
    at = 0
    for _, b, n in sorted(rows, key=lambda r: (-r[0], r[1])):
        assert got[b] == at
        at += n


# -- Merkle manifest --------------------------------------------------------------------------


def tree(leaves):
    """Levels of digests, bottom up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


def siblings(levels, i):
    out = []
    for low in levels[:-1]:
        j = i ^ 1
        out.append("-" if j >= len(low) else ("L" if j < i else "R") + low[j])
        i //= 2
    return out


def brute_manifest(rows):
    groups = {}
    for g, i, d in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([d for *_, d in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (known, x, d) in enumerate(sorted(groups[g])):
            out.append((g, x if known else None, d, trees[g][-1][0], siblings(trees[g], i) + siblings(top, k)))
    return out, top[-1][0]


@pytest.mark.parametrize("case", ["mixed", "deep", "one", "groups"])
def test_manifest(spark, case):
    rng = random.Random(3)
    if case == "mixed":  # nulls, shared ids, rows that stand many times (over several chunks), one row a group
        rows = [(rng.choice(["en", "de", None, "", "é"]), rng.choice([None, 5, rng.randint(-50, 50)]), sha(str(rng.randint(0, 60)))) for _ in range(300)]
        rows += [("solo", 1, sha("x"))] + [("en", 9, sha("same"))] * 1500
    elif case == "deep":
        rows = [("a", rng.randint(0, 2**40), sha(str(i))) for i in range(2300)] + [("b", i, sha(f"b{i}")) for i in range(1025)]
    elif case == "one":
        rows = [(None, None, sha("only"))]
    else:
        rows = [(f"g{i}", 1, sha(str(i))) for i in range(1100)]
    got, root = mk.manifest(spark.createDataFrame([(*r, None) for r in rows], "grp string, id long, leaf string, extra string"))
    want, want_root = brute_manifest(rows)
    assert root == want_root
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[4])
    folded = got.withColumn("up", mk.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted(((r["grp"], r["id"], r["leaf"], r["subroot"], r["path"]) for r in folded), key=key) == sorted(want, key=key)
    assert {r["up"] for r in folded} == {root}


def test_manifest_of_nothing(spark):
    got, root = mk.manifest(spark.createDataFrame([], "grp string, id long, leaf string, extra string"))
    assert got.count() == 0 and root == ""


def test_fields_and_tampering(spark, tmp_path):
    rows = [(1, "Ünï", "en", "s", 3), (None, None, None, None, None), (14, "", "en", "s", 0), (5, "x" * 200_000, "de", "", 2**63 - 1), (5, "x", "de", "", 1), (5, "x", "de", "", 1)]
    rows += [(i, "t", "en", "s", i) for i in range(20, 80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit(0)).withColumn("g", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    out = mk.op11_merkle_manifest(spark, str(tmp_path)).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(r["leaf"] for r in out) == sorted(sha(*[field(v) for v in (i, s, la, n, t)]) for i, t, la, s, n in rows)
    for r in out:
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert r["verified"] == (not touched) == (r["folded_root"] == r["root"])
    assert any(not r["verified"] for r in out)


# -- importance resampling --------------------------------------------------------------------


def rs_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def rs_features(text, max_n=2):
    w = rs_words(text)
    return Counter(" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))


def brute_weights(docs, aims, buckets, max_n=2):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for text in docs:
        for f, n in rs_features(text, max_n).items():
            s[bucket(f)] += n
    for text in aims:
        for f, n in rs_features(text, max_n).items():
            t[bucket(f)] += n
    S, T = sum(s.values()), sum(t.values())
    out = []
    for text in docs:
        fs = rs_features(text, max_n)
        total = sum(n * math.floor(1000 * math.log((t[bucket(f)] + 1.0) * (S + buckets) / ((s[bucket(f)] + 1.0) * (T + buckets)))) for f, n in fs.items())
        n = sum(fs.values())
        out.append((len(rs_words(text)), n, total // n if n else 0))
    return out


def brute_draw(rows, share=25, least=20, seed=7):
    """``rows(id, n_words, n_features, weight)`` -> sorted ``(id, n_features, weight, score, rank)``."""
    scored = []
    for i, words, n, weight in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[1]))
    k = share * len(able) // 100
    out = [(r[0], r[2], r[3], r[4], n + 1 if n < k else None) for n, r in enumerate(able)]
    return sorted(out + [(r[0], r[2], r[3], r[4], None) for r in scored if r[1] < least], key=str)


@pytest.mark.parametrize("max_n,buckets,small", [(2, 10_000, False), (3, 50, True)])
def test_resampling(spark, monkeypatch, max_n, buckets, small):
    if small:
        monkeypatch.setattr(rs, "BLOCK_BYTES", 300)
        monkeypatch.setattr(rs, "PART_BYTES", 200)
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["The", "cat", "Ünï", "x1", "über-all", "don't", "zz ", " "]) for _ in range(n))
    texts = [(i, prose(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for i in range(80)] + [(7, None), (None, prose(30)), (None, prose(30)), (8, ""), (9, "word " * 30_000), (9, "..!?\n\t")]
    texts += [(500, "the same text " * 10)] * 30
    aims = [prose(40), None, "", "the same cat"]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("weight", F.lit("x")).withColumn("block", F.lit(1)).repartition(4)
    got = rs.importance_weights(docs, spark.createDataFrame([(a,) for a in aims], "text string"), max_n=max_n, buckets=buckets).cache()
    want = [(i, *w) for (i, _), w in zip(texts, brute_weights([t for _, t in texts], aims, buckets, max_n))]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    drawn = rs.draw(got).select("id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in drawn), key=str) == brute_draw(want)
    assert sorted(r["rank"] for r in drawn if r["rank"]) == list(range(1, 25 * sum(w[1] >= 20 for w in want) // 100 + 1))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aims = spark.createDataFrame([("a b",)], "text string")
    assert rs.draw(rs.importance_weights(none, aims)).count() == 0
    docs = spark.createDataFrame([(i, "a b c " * 10, "kept") for i in range(8)], "doc_id long, text string, rank string")
    out = rs.resample(docs, none)
    assert out.columns == docs.columns and out.count() == 2


# -- personal data ----------------------------------------------------------------------------


def naive(text):
    """The patterns as they are stated."""
    out = []
    for k, (pattern, ok) in enumerate([
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]):
        out += [(k, *m.span()) for m in re.finditer(pattern, text) if ok(m.group())]
    return out


def test_base_spans_are_the_stated_patterns():
    rng = random.Random(8)
    for alphabet in ("a@.b-1_+ ", "0123456789 -", "1234.5", "+1 ()-.5a", "é@a.b%٣1+ \n"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
            assert sorted(pii.base_spans(text)) == sorted(naive(text)), text
    for text in ("a" * 200_000 + "@", "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1(" * 50_000, "0" * 50 + "1.1.1.1", "a@b." * 50_000):
        pii.base_spans(text)
        list(pii.lattices(pii.segments(text)))


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.variants())


def test_gradient_is_that_of_the_likelihood():
    text, spans = "tel (640) 555-0953 4952 9359 0025 3052 x", [(3, 4, 18)]
    run = next(iter(pii.lattices(pii.segments(text))))
    names = {}
    feats = [np.array([names.setdefault(f, len(names)) for f in pii.features(text, x)]) for x in run]
    lat = pii.Lattice(run, feats)
    rng = np.random.RandomState(0)
    w, moves = rng.standard_normal(len(names)) * 0.3, rng.standard_normal((pii.LABELS, pii.LABELS)) * 0.3
    path, trans = pii._gold(lat, run, set(spans))

    def loss(w, moves):
        total, *_ = pii._expect(lat, w, moves)
        return sum(w[lat.edges[k][3]].sum() for k in path) + (trans * moves).sum() - total

    _, prob, expected = pii._expect(lat, w, moves)
    prob = -prob
    prob[path] += 1
    dw = np.zeros(len(w))
    for p, e in zip(prob, lat.edges):
        dw[e[3]] += p
    for k in range(0, len(w), 5):
        step = np.eye(len(w))[k] * 1e-5
        assert abs((loss(w + step, moves) - loss(w - step, moves)) / 2e-5 - dw[k]) < 1e-5
    for a, b in ((0, 0), (0, 4), (4, 0), (0, 3)):
        step = np.zeros_like(moves)
        step[a, b] = 1e-5
        assert abs((loss(w, moves + step) - loss(w, moves - step)) / 2e-5 - (trans - expected)[a, b]) < 1e-5


def test_viterbi_is_the_best_of_all_paths(model):
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join(rng.choice(["555-0142", "4952935900253052", "+1", "(640)", "10.1.1.1", "a at b dot com", "12"]) for _ in range(rng.randint(2, 4)))
        for run in pii.lattices(pii.segments(text)):
            lat = pii.Lattice(run, [None] * len(run))
            score = [sum(model.weights.get(f, 0.0) for f in pii.features(text, x)) - model.caution for x in run]
            best = [-math.inf, None]

            def walk(at, y, v, spans):
                if at == lat.size - 1:
                    if v > best[0] + 1e-9:
                        best[:] = [v, spans]
                    return
                for a, b, label, _, n in lat.edges:
                    if a == at:
                        more = [(run[n].kind, run[n].start, run[n].end)] if n >= 0 else []
                        walk(b, label, v + model.moves[y, label] + (score[n] if n >= 0 else 0.0), spans + more)

            if len(run) <= 14:
                walk(0, 0, 0.0, [])
                assert model.best(text, run) == best[1]


def test_model_finds_written_out_forms(model):
    """Other draws of the same forms: nearly all found, nearly nothing invented."""
    hit = extra = miss = 0
    for text, spans in pii.variants(seed=77, each=5):
        got, want = set(model.spans(text)), set(spans)
        hit, extra, miss = hit + len(got & want), extra + len(got - want), miss + len(want - got)
    assert hit > 300 and miss <= 0.06 * hit and extra <= 0.02 * hit


def test_private_spans(spark, model):
    texts = [
        "write to jo.doe [at] mail [dot] org or jo@mail.org now", "call (640) 555-0953 or +1 (640) 555-0953",
        "7536784127813050 4845168114407329", "order 1234567890, 2024-05-17, v1.2.3, 4.0.", None, "", "x" * 300_000 + " 10.0.0.1", "7 " * 30_000,
    ]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, texts[1], "k"), (1, texts[1], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumn("added", F.lit(1)).repartition(3)
    out = pii.find_private(docs, model, redact=True).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(enumerate(texts)).get(r["id"], texts[1]) or ""
        assert sorted((pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base"]) == sorted(naive(text) if len(text) < 1000 else pii.base_spans(text))
        for s in r["added"]:
            assert all(s["end"] <= b["start"] or s["start"] >= b["end"] for b in r["base"])
    by = {r["id"]: r for r in out}
    assert [(s["kind"], texts[0][s["start"] : s["end"]]) for s in by[0]["added"]] == [("email", "jo.doe [at] mail [dot] org")]
    assert by[0]["redacted"] == "write to [EMAIL] or [EMAIL] now"
    assert by[1]["redacted"] == by[None]["redacted"] == "call [PHONE] or [PHONE]"
    assert [s["kind"] for s in by[2]["added"]] == ["card", "card"] and not by[2]["base"]
    assert not by[3]["base"] and not by[3]["added"] and not by[4]["added"] and by[4]["redacted"] == ""


def test_training_on_a_corpus(spark):
    """Copies do not fill the sample, and an empty corpus still trains."""
    docs = spark.createDataFrame([(i, "mail an.19@mail5.example.com today") for i in range(50)] + [(99, None), (100, "id 4952935900253052 x")], "doc_id long, text string")
    found = pii.excerpts(docs.select("text"), 5)
    assert 2 <= len(found) <= 4
    assert pii.excerpts(docs.where("doc_id < 0").select("text")) == []


def test_listing(spark):
    one = spark.range(1).select(F.expr("array(named_struct('kind','phone','start',1L,'end',9L), named_struct('kind','email','start',30L,'end',40L), named_struct('kind','email','start',4L,'end',8L))").alias("s"))
    assert one.select(pii.listed(F.col("s"))).first()[0] == "email:4:8,email:30:40,phone:1:9"

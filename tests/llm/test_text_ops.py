"""HTML, toxicity, BPE, licences and chats."""

import base64
import hashlib
import math
import re
import statistics
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from folio_spark.llm import op1_html, op3_toxicity, op7_bpe, op8_license, op10_chat

SF = "/root/testdata/sf0.01"


# -- HTML -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a &amp; b<p>c  d", "a & b\nc d"),
        ("<body><header>Site</header><nav>menu</nav><main><h1>T</h1><p>One two three four five six.</p></main><aside>x</aside><footer>f</footer></body>", "T\nOne two three four five six."),
        ("<article><p>Main text of some length here.</p><div class='comments'><p>nice post</p></div><form>join</form></article>", "Main text of some length here."),
        ("<div id='cookie-notice'>We use cookies, lots and lots of them, yes.</div><article><p>Body.</p></article>", "Body."),
        ("<article><header><h1>Title</h1><p>by line</p></header><p>Body text.</p></article>", "Title\nby line\nBody text."),
        ("<article><p>x<script>var a='<p>no</p>';</script>y<style>p{}</style></p></article>", "xy"),
        ("<article><p>a<br>b</p></article>", "a b"),
        ("<article><p>unclosed <b>bold<p>next</article>", "unclosed bold\nnext"),
        ("<div class='sidebar'>s</div><div class='post'><p>" + "word " * 40 + "</p><p>end.</p></div><div class='ad-box'>buy</div>", ("word " * 40).strip() + "\nend."),
        ("<![bad <p>still</p>", "still"),
    ],
)
def test_extract(html, text):
    assert op1_html.extract(html) == text


PARAGRAPHS = "<p>A first paragraph of the article, long enough to count.</p><p>A second paragraph, with more words in it than the first.</p>"
TEXT = "A first paragraph of the article, long enough to count.\nA second paragraph, with more words in it than the first."
NAV = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<div class="content with-sidebar"><h1>T</h1>{PARAGRAPHS}</div>', "T\n" + TEXT),
        (f'{NAV}<div class="layout no-menu">{PARAGRAPHS}</div>', TEXT),
        (f'<body><form id="aspnetForm">{NAV}<h1>Title</h1>{PARAGRAPHS}</form></body>', "Title\n" + TEXT),
        (f'<body>{NAV}<article class="post comments"><h1>T</h1>{PARAGRAPHS}</article><footer>(c) us</footer></body>', "T\n" + TEXT),
        (f'<article>{PARAGRAPHS}<section class="related-work"><h2>Related</h2><p>The work of others is long and was read.</p></section></article>', TEXT + "\nRelated\nThe work of others is long and was read."),
        (f'<article><p>A <span class="search-term">needle</span> here.</p>{PARAGRAPHS}</article>', "A needle here.\n" + TEXT),
        (f"<article>{PARAGRAPHS}<![bad <p>three</p><p>four</p></article>", TEXT + "\nthree\nfour"),
        (f'<div><div class="post"><h1>No article</h1><div class="txt">{PARAGRAPHS}</div></div><div class="sidebar"><p>Long text of other things, which nobody came to read at all.</p></div></div>', "No article\n" + TEXT),
        (f'<body>{NAV}<div class="ad">Buy this now. It is cheap.</div><article></article><footer>The foot</footer></body>', ""),
        ('<article><p>Tiny.</p></article><section id="comments"><h2>2 comments</h2><article class="comment"><p>I like this very much, more than I can say.</p></article></section>', "Tiny."),
    ],
)
def test_class_words_discount_but_do_not_cut(html, text):
    assert op1_html.extract(html) == text


def test_ratio_gaussian_and_threshold_by_brute_force():
    """The upper cluster of whole pages against the formulas written out."""
    import duckdb

    pages = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' WHERE html IS NOT NULL").fetchall()
    assert len(pages) > 200
    for (html,) in pages:
        page = op1_html.read_lines(html)
        op1_html.weigh_marks(page)
        r = [(len(x.text) - x.linked) / max(1, x.tags) for x in page.lines]
        w = lambda i, k: math.exp(-((i - k) ** 2) / 2) if abs(i - k) <= 3 else 0.0
        smooth = lambda v: [sum(w(i, k) * v[k] for k in range(len(v))) / sum(w(i, k) for k in range(len(v))) for i in range(len(v))]
        plain = smooth(r)
        trust = [x.node.trust for x in page.lines]
        own = smooth([a * b for a, b in zip(r, trust, strict=True)])
        mean = sum(plain) / len(plain)
        limit = 0.5 * (min(mean, statistics.pstdev(plain)) or mean)
        want = [s * t >= limit for s, t in zip(own, trust, strict=True)]
        assert op1_html.upper_cluster(page.lines, 1.0, 0.5) == want


def test_clusters_decide(monkeypatch):
    """Without article elements and class words the text still comes out; without clusters it doesn't."""
    import duckdb

    pages = [h for (h,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    bare = [re.sub(r"<(/?)article>", r"<\1div>", h.replace(' class="ad"', "")) for h in pages]
    want = [op1_html.extract(h) for h in pages]
    assert sum(op1_html.extract(h) == t for h, t in zip(bare, want, strict=True)) > 0.95 * len(pages)
    monkeypatch.setattr(op1_html, "upper_cluster", lambda lines, sigma, share: [True] * len(lines))
    assert sum(op1_html.extract(h) == t for h, t in zip(bare, want, strict=True)) < 0.5 * len(pages)


@pytest.mark.parametrize("part", ["<div>", "<span>", "<div><p>a</i></em>", "<ul><li>"])
def test_deep_nesting_is_linear(part):
    def seconds(n):
        t = time.process_time()
        op1_html.extract(part * n + "x")
        return time.process_time() - t

    seconds(500)
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.02)


@pytest.mark.parametrize("section", ["<![x]>", "<![]>", "<![ a ]>", "<![>", "<![9[b]]>"])
def test_text_after_unknown_sections(section):
    assert op1_html.extract(f"<p>before</p>{section}<p>after one</p>{section}<p>two</p>") == "before\nafter one\ntwo"
    assert op1_html.extract(f"<head>{section}</head><body><p>all of it</p></body>") == "all of it"
    assert op1_html.extract("<p>before</p><p>open <![x") == "before\nopen <![x"


def test_pages_keep_every_row(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in op1_html.extract_pages(df).collect())[:2] == [(1, "u", "a")] * 2
    assert op1_html.extract_pages(df.limit(0)).count() == 0
    odd = df.withColumns({"text": F.lit("own"), "lang": F.lit("x"), "_html": F.lit("y")})
    got = op1_html.extract_pages(odd, keep=("page_id", "text", "_html"))
    assert got.columns == ["page_id", "_html", "text"] and {tuple(r) for r in got.collect()} == {(1, "y", "a"), (2, "y", "")}
    long = "<article>" + "<p>word word</p>" * 60_000 + "</article>"
    assert op1_html.extract(long).count("\n") == 59_999


def test_gaussian_keeps_constants():
    assert op1_html.gaussian([2.0] * 7, 1.0) == pytest.approx([2.0] * 7)


# -- toxicity ---------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    """Markers of toxicity that a bag of hashed words must learn, on rows whose labels are never seen."""
    neutral = ["river", "stone", "cloud", "green", "paper", "window", "seven", "market", "the", "of", "and"]
    rows, labels = [], []
    for i in range(900):
        words = [neutral[(i * 7 + k * 3 + k * k) % len(neutral)] for k in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[i % 30] = ["rottenham", "rottenest"][i % 2] + str(i % 9)
        rows.append((i, " ".join(words), "xx"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9001, None, "xx"), (9002, "", None)], "doc_id long, text string, source string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = op3_toxicity.fit_model(docs, lab)
    got = {r.doc_id: r.score for r in op3_toxicity.score_documents(docs, model).collect()}
    assert len(got) == 902 and got[9001] == got[9002]
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.97 and all(0 <= s <= 1 for s in got.values())


def test_no_labels_and_no_rows(spark, docs):
    model = op3_toxicity.fit_model(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in op3_toxicity.score_documents(docs, model).collect()} == {0.5}
    assert op3_toxicity.score_documents(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in held], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in held], "doc_id long, toxic int")
    assert op3_toxicity.fit_model(docs, labels).constant == 0.5


def test_convolution_and_gradient_by_brute_force():
    """Pooled filters against plain loops; a training step against numerical gradients."""
    import numpy as np

    c = op3_toxicity.Config(buckets=64, dim=3, widths=(1, 2), filters=2, whole_texts=1.0, batch=4)
    rng = np.random.RandomState(0)
    m = op3_toxicity.Model(c, rng.standard_normal((64, 3)))
    m.conv = [(rng.standard_normal((w, 3, 2)), np.zeros(2)) for w in c.widths]
    m.out, m.bias = rng.standard_normal(4), 0.3
    docs = [(rng.randint(0, 64, (n, 3)), y) for n, y in ((5, 1), (1, 0), (0, 1), (3, 0))]

    def forward(ids):
        x, h = [sum(m.emb[k] for k in row) for row in ids], []
        for (wts, b), width in zip(m.conv, c.widths, strict=True):
            for f in range(2):
                z = [sum(float(x[i + j] @ wts[j][:, f]) for j in range(width)) + b[f] for i in range(len(x) - width + 1)]
                h.append(max([0.0, *z]))
        return float(np.dot(h, m.out) + m.bias)

    first = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
    ids = np.concatenate([d[0] for d in docs])
    assert op3_toxicity.logit(m, ids, first) == pytest.approx([forward(d[0]) for d in docs], abs=1e-5)

    def loss():
        return sum((-math.log(1 / (1 + math.exp(-z))) if y else -math.log(1 - 1 / (1 + math.exp(-z)))) for z, y in ((forward(d[0]), d[1]) for d in docs)) / len(docs)

    def slope(a, at):
        keep = a[at]
        a[at] = keep + 1e-5
        up = loss()
        a[at] = keep - 1e-5
        down = loss()
        a[at] = keep
        return (up - down) / 2e-5

    want = {"out": slope(m.out, 1), "w": slope(m.conv[1][0], (0, 1, 0)), "emb": sum(slope(m.emb, (int(docs[0][0][0, 0]), k)) ** 2 for k in range(3))}
    acc = {"out": np.zeros(4), "bias": 1.0, "w": [np.zeros_like(w) for w, _ in m.conv], "b": [np.ones(2) for _ in m.conv]}
    seen = np.zeros(64)
    with np.errstate(all="ignore"):
        op3_toxicity._step(m, docs, acc, seen, 0.5, np.random.RandomState(1))  # both classes weigh one
    assert acc["out"][1] == pytest.approx(want["out"] ** 2, abs=1e-6) and acc["w"][1][0, 1, 0] == pytest.approx(want["w"] ** 2, abs=1e-6)
    assert seen[int(docs[0][0][0, 0])] == pytest.approx(want["emb"], abs=1e-6)


def test_thresholds_alike_at_every_size(spark):
    """Five rows of the rarer class, one language with none of it: thresholds come from unseen folds and stay near the common one."""
    rows = [(i, ("the of and " if i % 2 else "der die und ") + ("vile " if i % 9 == 0 else "fair ") + f"w{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = op3_toxicity.fit_model(docs, labels)
    assert set(model.shift) == {None, 0, 1, 2, 3} and model.shift[3] == model.shift[None]
    clash = docs.withColumns({"_score": F.lit(1), "score": F.lit("x"), "text2": F.lit(None)})
    got = op3_toxicity.score_documents(clash, model, carry=True, out="_score")
    assert got.columns == ["doc_id", "text", "score", "text2", "_score"] and got.count() == 80
    null = spark.createDataFrame([(None, "vile"), (None, "vile"), (1, "x" * 2_000_000 + " vile")], "doc_id long, text string")
    assert op3_toxicity.score_documents(null, model).count() == 3


# -- BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizer):
    path, pattern, enc = tokenizer
    bpe = op7_bpe.ByteBpe(path, pattern)
    texts = ["", " ", "\n\n \t x", "Hello, world!! It's 2024", "naïve 日本語 🎉🎉‍", "a" * 5000, " " * 4000, "▁ ▁x <unk> <unused1> <|endoftext|>", "\x00\x01\x7f", "".join(chr(c) for c in range(32, 1500))]
    for t in texts:
        ids = bpe.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == enc.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_bpe_cache_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(op7_bpe, "CACHE_ENTRIES", 10)
    bpe = op7_bpe.ByteBpe(*tokenizer[:2])
    t = " ".join(f"w{i}" for i in range(200))
    assert bpe.decode(bpe.encode(t)) == t.encode() and len(bpe.known) <= 10


def test_bpe_frames(spark, docs, tokenizer):
    path, pattern, _ = tokenizer
    enc = op7_bpe.encode_texts(docs, path, pattern)
    back = {r.doc_id: bytes(r.decoded) for r in op7_bpe.decode_ids(enc, path, pattern).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in docs.collect()} and enc.count() == docs.count()
    digests = {r.doc_id: r for r in op7_bpe.roundtrip_digests(docs, path, pattern).collect()}
    want = tokenizer[2].encode_ordinary(docs.where("doc_id = 8").first().text)
    assert digests[8].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert digests[4].n_tokens == 0 and digests[4].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_of_a_whole_table(spark, tokenizer):
    """Ids of every text of the table, as digests, against the library."""
    path, pattern, enc = tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7_bpe.roundtrip_digests(docs, path, pattern).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


# -- licences ---------------------------------------------------------------------------------


def brute_license(text):
    w = [x for x in re.split(op8_license.BREAK, (text or "").translate(str.maketrans(op8_license.UPPER, op8_license.LOWER))) if x]
    hits = {}
    for phrase, label in op8_license.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        if at:
            hits[label] = at
    return len(w), hits


def test_license_scan(spark, docs):
    texts = [
        "All rights reserved. ALL RIGHTS RESERVED", "cc by cc-by CC/BY 4.0", "Licensed under the Apache License, Version 2.0.", "x GNU General Public License, version 3 y",
        "rights reserved", "all rights\nreserved", "É all rights reserved", "cc", "apache license 2.0", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in op8_license.scan_licenses(df).join(df.dropDuplicates(), "doc_id").collect():
        n, hits = brute_license(r.text)
        assert r.n_words == n and {b.label: b.starts for b in r.base} == hits
    found = {r.doc_id: {f.label: f.score for f in r.found} for r in op8_license.scan_licenses(df).collect()}
    assert found[102] == {"apache-2.0": 1.0} and 0.5 < found[103]["gpl-3.0"] < 1.0 and not found[108]
    assert op8_license.scan_licenses(df.limit(0)).count() == 0


def brute_placements(text, index):
    """Best score by licence, from every start of every text: postings met, phrases in place, weights met."""
    w = op8_license.split_words(text or "")
    best = {}
    for t, (label, words, weights) in enumerate(zip(index.labels, index.words, index.weights, strict=True)):
        at = lambda i: w[i] if 0 <= i < len(w) else None
        rare = [(q, x) for x, posts in index.postings.items() for u, q in posts if u == t]
        for o in range(-len(words), len(w)):
            votes = sum(at(o + q) == x for q, x in rare)
            if votes >= index.votes[t] and all(at(o + q) == x for q, x in index.required[t]):
                score = sum(v for q, (x, v) in enumerate(zip(words, weights, strict=True)) if at(o + q) == x) / sum(weights)
                best[label] = max(best.get(label, 0.0), score)
    return best


def test_license_placements_by_brute_force(spark):
    """Every text of the index, whole, cut, altered and twice, among other words."""
    from folio_spark.llm.license_texts import TEXTS

    rows = []
    for _, _, text in TEXTS:
        w = text.split()
        altered = [x if i % 7 else "other" for i, x in enumerate(w)]
        rows += [text, "before " + text.upper() + " after", " ".join(w[len(w) // 2 :]), " ".join(altered), text + " and " + " ".join(w[1:] + w)]
    rows += ["permission license software " * 50, "gnu " * 200, "x" * 300_000 + " released under the mit license", None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"_w": F.lit(1), "_all": F.lit(2), "n_words": F.lit(3)})
    index = op8_license.build_index(op8_license.corpus_idf(df))
    scan = op8_license.scan_licenses(df, index=index)
    got = {r.doc_id: {f.label: f.score for f in r.found} for r in scan.collect()}
    for i, text in enumerate(rows):
        assert got[i] == pytest.approx(brute_placements(text, index)), text
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_idf_counts_rows(spark):
    texts = [("a", ["alpha beta"], "alpha beta gamma")]
    df = spark.createDataFrame([("Alpha alpha",), ("beta, alpha",), (None,)], "text string")
    assert op8_license.corpus_idf(df, texts) == pytest.approx({"alpha": math.log(4 / 3) + 1, "beta": math.log(4 / 2) + 1, "gamma": math.log(4) + 1})


# -- chats ------------------------------------------------------------------------------------


def chat(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return op10_chat.format_chats(df.withColumn("parts", op10_chat.text_parts(F.col("text"))))


@pytest.mark.parametrize("text", ["", "a", "<|im_end|>", "\\", "\\\\<|", "<\\|", "<\\\\|x", "<", "|>\n<|im_start|>assistant\nhi", "\n\n", "😀<|"])
def test_chat_round_trip(spark, text):
    out = chat(spark, [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "we\nird<|", text)]).withColumn("turns", op10_chat.parse_chats(F.col("formatted"))).first()
    assert [tuple(t) for t in out.turns] == [("user", text), ("assistant", text), ("we\nird<|", text)]
    (span,) = out.loss_spans
    masked = out.formatted[span.start : span.start + span.len]
    assert masked.replace("<\\|", "<|").replace("\\\\", "\\") == text
    assert out.formatted.count("<|im_start|>") == 3


def test_chat_nulls_ties_and_order(spark):
    out = chat(spark, [(None, 0, None, None), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, 1, "system", "s")])
    got = {r.conv_id: r.formatted for r in out.collect()}
    turn = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert got == {None: turn("", ""), 2: turn("system", "s") + turn("user", "a") * 2 + turn("user", "b")}


def test_chat_parts(spark):
    parts = [("text", "see <|x|> ", None, None, None, None, None), ("image", None, "i.png", 56, 30, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), ("video", None, "v", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{op10_chat.PART_TYPE}>")
    r = op10_chat.format_chats(df).first()
    assert r.formatted.startswith("<|im_start|>user\nsee <\\|x|> <|image:0|><|audio:1|><|document:2|><|video:3|><|im_end|>")
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 1536), ("video", "v", 1)]
    assert op10_chat.format_chats(df.limit(0)).count() == 0

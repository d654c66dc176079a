"""Operators on small literal frames, expected rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from folio_spark.functions import text as tx
from folio_spark.functions import neighbours as nb
from folio_spark.functions import vector as vx
from folio_spark.functions.graph import connected_components
from folio_spark.operators import assoc, catalog, chunking, classify, dedup, ranking, retrieval


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


# -- text -------------------------------------------------------------------------------------


def test_tokens_are_unicode(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Über naïve café, a B2 x_y") == ["über", "naïve", "café", "b2", "x_y"]


def test_hash_ignores_case_and_outer_space(spark):
    df = spark.createDataFrame([("  Some Text\n",), ("some text",)], ["t"]).select(tx.content_hash(F.col("t")))
    a, b = (r[0] for r in df.collect())
    assert a == b and len(a) == 16


def test_latex_round_trip(spark):
    s = r"50% of {a_b} \ $x$ ~^#&"
    assert one(spark, tx.latex_unescape(tx.latex_escape(F.col("t"))), t=s) == s
    assert one(spark, tx.latex_escape(F.col("t")), t="a\\{b}") == r"a\textbackslash{}\{b\}"


@pytest.mark.parametrize(("s", "ok"), [("{a{b}}", True), ("}{", False), (r"\{", True), ("{", False), ("", True)])
def test_balanced_braces(spark, s, ok):
    assert one(spark, tx.balanced_braces(F.col("t")), t=s) is ok


def test_dois_json_names(spark):
    assert one(spark, tx.dois(F.col("t")), t="see 10.1000/ABC.1, and doi:10.1000/abc.1; 10.5555/x_(2).") == ["10.1000/abc.1", "10.5555/x_(2"]
    assert one(spark, tx.json_block(F.col("t")), t='Sure:\n```json\n[{"id": 1}]\n``` done') == '[{"id": 1}]'
    assert one(spark, tx.json_block(F.col("t")), t="none") is None
    assert one(spark, tx.safe_name(F.col("t")), t=" A topic: x/y! ") == "a_topic_x_y"
    assert one(spark, tx.markdown_to_latex(F.col("t")), t="**b** *i* [@k1]") == r"\textbf{b} \textit{i} \cite{k1}"


def test_sentences(spark):
    assert one(spark, tx.sentences(F.col("t")), t="One. Two!  Three? ") == ["One.", "Two!", "Three?"]


# -- vectors and graphs -----------------------------------------------------------------------


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0])], "i int, a array<double>, b array<double>")
    got = [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b")), "i").orderBy("i").collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1] == 0.0 and got[2] is None
    with pytest.raises(Exception, match="width"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vx.cosine(F.col("a"), F.col("b"))).collect()


def _chain(spark):
    """a - b - c at 30 degrees each: neighbours reach .8, the ends do not; d is alone."""
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    return spark.createDataFrame([(1, at(0)), (2, at(30)), (3, at(60)), (9, at(200))], "vec_id long, embedding array<double>")


def test_three_dedups_differ(spark):
    v = _chain(spark)
    assert rows(dedup.transitive(v, 0.8)) == [(1, 1), (2, 1), (3, 1), (9, 9)]
    assert rows(dedup.leader(v, 0.8)) == [(1, 1, True), (2, 1, False), (3, 3, True), (9, 9, True)]
    assert rows(dedup.average_linkage(v, 0.8)) == [(1, 1), (2, 1), (3, 3), (9, 9)]


def test_blocked_joins_equal_one_block(spark):
    v = _chain(spark)
    assert rows(nb.similarity_report(v, 0.8, block=1).pairs.drop("sim")) == rows(nb.similarity_join(v, 0.8).drop("sim")) == [(1, 2), (2, 3)]
    assert rows(nb.knn_report(v, 1, block=1).pairs.select("id", "neighbour")) == rows(nb.knn_join(v, 1).select("id", "neighbour"))


def test_connected_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (8, 9)] + [(i, i + 1) for i in range(20, 60)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in (3, 4, 5)} == {3} and got[9] == 8 and {got[i] for i in range(20, 61)} == {20}
    assert connected_components(edges.where("src > 100")).count() == 0


# -- retrieval --------------------------------------------------------------------------------


def test_bm25_repeats_and_unknown_words(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue cat"), (4, None)], "doc_id long, text string")
    once = dict(rows(retrieval.bm25(docs, "red zebra")))
    twice = dict(rows(retrieval.bm25(docs, "red red zebra")))
    assert set(once) == {1, 2} and twice[1] == pytest.approx(2 * once[1])
    idf, avg = math.log(1 + (4 - 2 + 0.5) / 2.5), 7 / 4
    assert once[1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg)))


def test_hybrid_merge_takes_both_lists(spark):
    d = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id long, score double")
    s = spark.createDataFrame([(7, 5.0), (1, 4.0)], "id long, score double")
    assert [r.id for r in retrieval.hybrid_merge(d, s, pool=3).collect()] == [1, 7, 2]
    assert {r.id: r.origin for r in retrieval.hybrid_merge(d, s).collect()} == {1: "both", 2: "dense", 3: "dense", 7: "sparse"}


def test_diversify_ties_go_by_id(spark):
    df = spark.createDataFrame([(3, "a", 1.0), (1, "a", 1.0), (2, "b", 1.0), (4, "a", 0.5)], "id long, source string, score double")
    assert [r.id for r in retrieval.diversify(df, "source", "score", "id", 2, 10).collect()] == [1, 2, 3]


def test_confidence_bounds(spark):
    full = spark.createDataFrame([(i, f"s{i % 4}", 60.0) for i in range(12)], "id long, source string, score double")
    assert tuple(retrieval.confidence(full).first()) == (0.97, "high", 12, 4)
    assert retrieval.confidence(full.limit(0)).first().confidence == 0.12


# -- chunking and classification --------------------------------------------------------------


def test_word_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "doc_id long, text string")
    got = rows(chunking.fixed_words(df, 4, 1).select("chunk_no", "content"))
    assert got == [(0, "0 1 2 3"), (1, "3 4 5 6"), (2, "6 7 8 9"), (3, "9")]


def test_paragraph_packing(spark):
    p = ["a" * 40, "b" * 40, "c" * 40]
    df = spark.createDataFrame([(1, "\n\n".join(p)), (2, "short"), (3, "")], "doc_id long, text string")
    got = rows(chunking.pack_paragraphs(df, size=100))
    assert got == [(1, 0, p[0] + "\n\n" + p[1]), (1, 1, p[1] + "\n\n" + p[2]), (2, 0, "short")]


def test_heading_sections_drop_the_preamble(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\ny\n## B\nz")], "doc_id long, text string")
    assert rows(chunking.by_headings(df)) == [(1, 1, 1, "A", "x\ny"), (1, 2, 2, "B", "z")]


def test_small_chunks_merge_in_pairs(spark):
    df = spark.createDataFrame([(1, i, f"c{i}", n) for i, n in enumerate([1, 1, 1, 9, 1])], "doc_id long, chunk_no long, content string, word_count long")
    assert rows(chunking.merge_small(df, 5).select("chunk_no", "word_count")) == [(0, 2), (2, 1), (3, 9), (4, 1)]


def test_pages_by_range_equal_fixed_pages(spark):
    df = spark.createDataFrame([(1, "x" * 5000)], "doc_id long, text string")
    chunks = chunking.fixed_chars(df)
    pages = spark.createDataFrame([(1, p, (p - 1) * 2000) for p in (1, 2, 3)], "doc_id long, page long, page_start long")
    a = rows(chunking.assign_pages(chunks, 2000).select("chunk_no", F.col("page").cast("long")))
    assert rows(chunking.assign_pages_by_range(chunks, pages).select("chunk_no", "page")) == a


def test_backoff_ends_at_sentences(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb. cccc dddd eeee.")], "doc_id long, text string")
    assert rows(chunking.backoff_chars(df, 12, 0).select("content"))[0] == ("aaaa bbbb.",)


def test_query_class_by_whole_words(spark):
    rules = [("contraindication", ["not", "avoid"]), ("spatial", ["above"])]
    q = lambda s, sub=False: one(spark, classify.query_class(F.col("q"), rules, substring=sub), q=s)
    assert q("the notochord") == "factual" and q("the notochord", True) == "contraindication" and q("do NOT cut above") == "contraindication"


def test_query_intent(spark):
    qs = spark.createDataFrame([("basilar aneurysm technique",), ("lumbar discectomy complications",), ("pterional approach",), ("history of surgery",)], ["query"])
    got = {r[0]: (r[1], r[2]) for r in classify.query_intent(qs, {"TECHNIQUE": ["pterional"]}, {"TECHNIQUE": ["technique"], "COMPLICATION": ["complications"]}).collect()}
    assert got["basilar aneurysm technique"] == ("basilar aneurysm", "TECHNIQUE")
    assert got["lumbar discectomy complications"] == ("lumbar discectomy", "COMPLICATION")
    assert got["pterional approach"] == ("pterional approach", "TECHNIQUE") and got["history of surgery"][1] == "GENERAL"


def test_step_numbers(spark):
    f = lambda s: one(spark, classify.step_number(F.col("t")), t=s)
    assert (f("Step 3: open"), f("stage b"), f("nothing")) == (3, 2, None)


def test_line_offsets(spark):
    df = spark.createDataFrame([(1, "ab\n\ncd")], "doc_id long, text string")
    assert rows(classify.line_offsets(df)) == [(1, 0, 0, "ab"), (1, 1, 3, ""), (1, 2, 4, "cd")]


# -- associations and catalog -----------------------------------------------------------------


def test_consecutive_groups_break_on_gaps(spark):
    df = spark.createDataFrame([("d", s, p) for s, p in [(1, 1), (2, 1), (4, 1), (5, 2), (6, 9)]], "d string, s int, p int")
    assert [r.run for r in assoc.consecutive_groups(df, "d", ["s"], "s", "p").orderBy("s").collect()] == [1, 1, 2, 2, 3]


def test_captions_are_used_once(spark):
    im = spark.createDataFrame([(1, "i1", 0.0, 0.0), (1, "i2", 0.0, 1.0)], "page long, image_id string, x double, y double")
    ca = spark.createDataFrame([(1, "c1", 0.0, 0.9), (1, "c2", 0.0, 9.0)], "page long, caption_id string, x double, y double")
    assert [(r.image_id, r.caption_id) for r in assoc.captions_for_images(im, ca).orderBy("image_id").collect()] == [("i1", "c1"), ("i2", "c2")]


def test_path_clusters(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0), (2, 60.0, 60.0), (3, 500.0, 10.0), (4, 20.0, 20.0)], "path_id long, x double, y double")
    assert rows(assoc.path_clusters(df)) == [(1, 1), (2, 1), (3, 3), (4, 1)]


def test_figure_sequences_drop_overlaps(spark):
    df = spark.createDataFrame([(1, f"i{k}", k, "Fig 1" if k < 4 else None, k) for k in (1, 2, 3, 4)], "doc_id long, image_id string, page long, prefix string, step long")
    got = assoc.figure_sequences(df).collect()
    assert [(r.kind, r.image_ids) for r in got] == [("prefix", ["i1", "i2", "i3"])]


def test_range_join_takes_the_first_span(spark):
    p = spark.createDataFrame([(1, 5), (2, 15), (3, 99)], "k long, at long")
    s = spark.createDataFrame([("a", 0, 10), ("b", 4, 20), ("c", 12, 30)], "name string, start long, stop long")
    got = catalog.range_join_first(p, s, "at", "start", "stop", ["start"], 8, "k")
    assert [(r.k, r.name) for r in got.orderBy("k").collect()] == [(1, "a"), (2, "b")]


def test_evict_rollup_upsert(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "t long, id long")
    assert catalog.evict_oldest(df, ["t", "id"]).count() == 8 and catalog.evict_oldest(df.limit(0), ["t", "id"]).count() == 0
    r = catalog.hierarchy_rollup(spark.createDataFrame([("a", "x"), ("a", "y")], "p string, q string"), ["p", "q"], n=F.count("*"))
    assert rows(r.select("level", "n")) == [(0, 2), (1, 2), (2, 1), (2, 1)]
    up = catalog.upsert(df, spark.createDataFrame([(0, 3), (7, 77)], "t long, id long"), ["id"])
    assert up.count() == 11 and up.where("id = 3").first().t == 0


def test_phrase_match_escapes(spark):
    assert one(spark, ranking.phrase_match(F.col("t"), "a.b c"), t="xa.b .. c") is True
    assert one(spark, ranking.phrase_match(F.col("t"), "a.b c"), t="aXb c") is False


def test_equal_evidence_goes_to_the_stronger_level(spark):
    # .3 * 2 + .1 * 3 and .3 * 1 + .1 * 6 are both nine tenths, but not as sums of doubles.
    levels = [("strong", ["alpha", "beta"]), ("medium", ["gamma"])]
    t = "alpha beta beta " + "gamma " * 6
    assert one(spark, classify.best_evidence(classify.evidence(F.col("t"), levels)), t=t) == "strong"


def test_evidence_summary_counts_equal_confidences_as_its_sql(spark, tmp_path):
    import duckdb

    from folio_spark.plans import texts
    from folio_spark.registry import ORACLES

    # Strong by two matches in three places, medium by one in six: nine tenths each.
    rows = [(1, "ing of " * 6 + "tionth tionth thered"), (2, "and the and the"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.evidence_level: r.n_docs for r in texts.evidence_summary(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[2] for r in con.execute(ORACLES["evidence_summary"]).fetchall()}
    assert got == {"strong": 1, "medium": 1, "weak": 0, "none": 0}


def test_equal_spans_meet_a_point_once(spark):
    # 300 points of one place in 300 spans of the same ends: joined row by row they would make 90,000 rows.
    p = spark.range(300).select(F.col("id").alias("k"), F.lit(5).cast("long").alias("at"))
    s = spark.range(300).select(F.col("id").alias("name"), F.lit(0).cast("long").alias("start"), F.lit(10).cast("long").alias("stop"))
    got = catalog.range_join_first(p, s, "at", "start", "stop", ["start", "name"], 8, "k").cache()
    assert [(r.k, r.name) for r in got.orderBy("k").collect()] == [(k, 0) for k in range(300)]
    assert most_join_rows(got) <= 300


def most_join_rows(cached):
    """Rows of the largest join in the executed plan of a cached frame."""
    import re

    found, todo = [], [cached._jdf.queryExecution().withCachedData().cacheBuilder().cachedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if re.search("Join", name):
            found.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return max(found)


def test_nearby_text_meets_places_not_rows(spark):
    import numpy as np

    from folio_spark.operators import search

    rng = np.random.RandomState(3)
    spots = lambda n, at: [(int(i % 2), i, *(at or (int(rng.randint(600)), int(rng.randint(800))))) for i in range(n)]
    images = spark.createDataFrame(spots(40, None), "page long, image long, x long, y long")
    texts = spark.createDataFrame(spots(300, None), "page long, block long, x long, y long")
    want = set()
    for p, i, x, y in images.collect():
        near = [(round(max(0.0, 1 - math.hypot(x - tx_, y - ty) / 500), 9), b) for q, b, tx_, ty in texts.collect() if p == q]
        want |= {(i, b) for s, b in sorted((n for n in near if n[0] >= 0.3), key=lambda n: (-n[0], n[1]))[:5]}
    assert {(r.image, r.block) for r in search.nearby_text(images, texts, "page", "image", "block").collect()} == want
    # 200 images and 200 texts of two places.
    one_place = [spark.createDataFrame(spots(200, (5, 5)), f"page long, {k} long, x long, y long") for k in ("image", "block")]
    got = search.nearby_text(*one_place, "page", "image", "block").cache()
    assert got.count() == 1000 and most_join_rows(got) <= 1000


def test_evidence_summary_gives_an_id_one_level_as_its_sql(spark, tmp_path):
    import duckdb
    import pandas as pd
    from folio_spark.plans import texts
    from folio_spark.registry import ORACLES

    rows = [(1, "tionth 123"), (1, "and the and the"), (2, "and the"), (2, "and the"), (3, "123"), (None, "tionth"), (None, "123 456"), (4, None)]
    pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = sorted(tuple(r) for r in texts.evidence_summary(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["evidence_summary"]).fetchall())


def tasks_rows(df):
    """Rows of each partition of a frame."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_a_key_are_dealt_by_row_count(spark):
    from folio_spark.functions import deal

    df = spark.range(20_000).select((F.col("id") % 2000).alias("k"), "id")
    got = deal.dealt(df, "k", parts=deal.parts_for(df, 500))
    assert got.rdd.getNumPartitions() == 40 and max(tasks_rows(got)) < 1000
    placed = got.withColumn("part", F.spark_partition_id())
    assert placed.select("k", "part").distinct().count() == 2000


@pytest.mark.parametrize("query, column", [("consecutive_groups", "l_partkey"), ("chunks_merge_small", "l_orderkey")])
def test_tasks_of_long_tables_hold_few_rows(spark, tmp_path, monkeypatch, query, column):
    from folio_spark.functions import deal
    from folio_spark.registry import QUERIES

    monkeypatch.setattr(deal.parts_for, "__defaults__", (100,))
    rows = spark.range(8000).select(
        (F.col("id") % 1000).alias("l_partkey"), (F.col("id") % 900).alias("l_suppkey"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(20.0).alias("l_quantity")
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert max(tasks_rows(QUERIES[query](spark, str(tmp_path)).select(column))) < 1000


def test_details_are_found_in_one_pass(spark):
    heads = [f"{'é' * (i % 3)}sentence number {i} of the claim stands here" for i in range(450)]
    claims = spark.createDataFrame([(i % 7, h) for i, h in enumerate(heads)], "item_id long, text string")
    texts = [None, "", "short", " ".join(heads[:300:2]), "x" + heads[301] + "y", heads[303][:-1], heads[305][:20]]
    merged = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    kept = {h for h in heads if any(t and h[:50] in t for t in texts)}
    tracker, before = spark.sparkContext.statusTracker(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    frame = assoc.details_preserved(claims, merged)
    jobs = len(tracker.getJobIdsForGroup(None)) - before
    got = {r.item_id: (r.n_details, r.n_kept) for r in frame.collect()}
    assert got == {k: (sum(i % 7 == k for i in range(450)), sum(i % 7 == k and h in kept for i, h in enumerate(heads))) for k in range(7)}
    # Only the sentences come to the driver; no pass over the texts for every 200 of them.
    assert jobs <= 4
    brief = assoc.details_preserved(spark.createDataFrame([(1, "ab cd")], "item_id long, text string"), spark.createDataFrame([("xab cdx",)], "text string"), more_than=1)
    assert [tuple(r) for r in brief.collect()] == [(1, 1, 1)]


def test_captions_are_dealt_in_order_without_pairs(spark):
    import numpy as np

    rng = np.random.RandomState(8)
    spot = lambda: (int(rng.randint(6)), int(rng.randint(6)) if rng.rand() > 0.1 else None)
    draw = lambda n, letter: [(int(rng.randint(9)), f"{letter}{rng.randint(n)}", *spot()) for _ in range(n)]
    images, captions = draw(120, "i"), draw(60, "c")
    want = set()
    for page in range(9):
        own, used = {}, set()
        for p, i, x, y in images:
            if p == page:
                own.setdefault(i, []).append((x, y))
        last = lambda v: (v is None, v or 0)
        for i, at in sorted(own.items(), key=lambda kv: (*min(last(y) for _, y in kv[1]), kv[0])):
            far = lambda x, y: min((last(None if b is None or y is None else math.hypot(a - x, b - y)) for a, b in at))  # noqa: B023, E731
            free = sorted((*far(x, y), c) for p, c, x, y in captions if p == page and c not in used)
            if free:
                used.add(free[0][2])
                want.add((page, i, free[0][2], None if free[0][0] else round(free[0][1], 9)))
    frames = [spark.createDataFrame(r, f"page long, {k} string, x long, y long") for r, k in ((images, "image_id"), (captions, "caption_id"))]
    got = assoc.captions_for_images(*frames)
    assert {(r.page, r.image_id, r.caption_id, None if r.distance is None else round(r.distance, 9)) for r in got.collect()} == want
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()

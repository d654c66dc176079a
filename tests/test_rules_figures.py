"""Row rules, figures and knowledge operators on literal frames."""

import pytest
from pyspark.sql import functions as F

from folio_spark.operators import figures, knowledge, rules


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_hybrid_intent(spark):
    lean = spark.createDataFrame([("a", "GENERAL", 0.5), ("b", "TECHNIQUE", 0.9), ("c", "GENERAL", 0.5)], "query string, intent string, confidence double")
    cache = spark.createDataFrame([("a", "ANATOMY", 0.7), ("b", "ANATOMY", 0.7)], "query string, intent string, confidence double")
    assert {r.query: (r.intent, r.source) for r in rules.hybrid_intent(lean, cache).collect()} == {"a": ("ANATOMY", "cache"), "b": ("TECHNIQUE", "rules"), "c": ("GENERAL", "rules")}


def test_query_analysis(spark):
    tax = spark.createDataFrame([("region", "skull", "clival"), ("region", "skull", "petrous"), ("region", "spine", "lumbar"), ("category", "technique", "approach")], "kind string, name string, term string")
    got = {r.query: r for r in rules.analyze_queries(spark.createDataFrame([("Clival and petrous approach",), ("unknown",)], ["query"]), tax).collect()}
    assert (got["Clival and petrous approach"].region, got["Clival and petrous approach"].confidence) == ("skull", 0.55)
    assert got["unknown"].region is None and got["unknown"].confidence == 0


def test_locations(spark):
    t = "Head line\nbody text\n12. note text"
    loc = lambda at, first=False: one(spark, rules.match_location(F.col("t"), F.lit(at), F.lit(first), r"^[0-9]+\. note", r"^Head"), t=t)
    assert (loc(2), loc(12), loc(12, True), loc(26)) == ("header", "body", "title", "footnote")


def test_strings_and_scores(spark):
    assert one(spark, rules.key_concepts(F.col("t"), ["aa", "bb", "cc"]), t="bb aa bb") == ["bb", "aa"]
    assert one(spark, rules.annotate({"RCT": "randomi[sz]ed"})(F.col("t")), t="A randomized trial, Randomised.") == "A randomized [RCT] trial, Randomised [RCT]."
    assert one(spark, rules.cue_score(F.col("t")), t="As shown in Fig 3, this image") == pytest.approx(1.0)
    assert one(spark, rules.procedural_score(F.col("t"), ["incise"], [], ["a", "b", "c", "d"]), t="incise a b c d") == pytest.approx(0.6)
    c = one(spark, rules.caption_parts(F.col("t")), t="Figure 2.1 (A) left, (b) right; see Fig. 3")
    assert (c.is_caption, c.figure_id, c.subfigures, c.references) == (True, "2.1", ["A", "B"], ["3"])
    assert one(spark, rules.within("/lib", F.col("p")), p="/lib/a/../../etc") is False and one(spark, rules.within("/lib", F.col("p")), p="/lib/a") is True
    assert one(spark, rules.citation(F.col("a"), F.col("y"), F.col("t"), F.col("p")), a=["Ann Lee", "Bo Im"], y=1999, t="T", p=3) == "Lee et al. (1999), T, p. 3"
    assert one(spark, rules.byte_entropy(F.col("b")), b=bytes(range(256))) == pytest.approx(8) and one(spark, rules.byte_entropy(F.col("b")), b=b"aaaa") == 0
    assert one(spark, rules.model_hook()(F.col("p")), p="One. Two. Three.") == "One. Two." and one(spark, rules.model_hook(str.upper)(F.col("p")), p="x") == "X"


def test_relevance_gate(spark):
    df = spark.createDataFrame([("a", 1, 8), ("a", 2, 3), ("b", 3, 2), ("b", 4, 1), ("b", 5, 1), ("b", 6, 0)], "q string, id long, s int")
    assert sorted(r.id for r in rules.relevance_gate(df, "q", "s").collect()) == [1, 3, 4, 5]


def test_image_rules(spark):
    k = one(spark, figures.image_type(F.col("t"), {"imaging": ["mri", "ct"], "anatomical": ["nerve"]}), t="MRI and CT of a nerve")
    assert k.kind == "imaging" and k.confidence == pytest.approx(0.3 + 0.35 * 1.0986122887)
    px = [[[10 * i, 10 * i, 10 * i] for i in range(20)] for _ in range(4)]
    f = one(spark, figures.pixel_features(F.col("p")), p=px)
    assert f.grayscale == 1.0 and f.dynamic_range > 0.5
    assert one(spark, figures.medical_class(F.col("g"), F.col("d"), F.col("c"), F.col("e")), g=1.0, d=0.7, c=8, e=0.0) == "radiology"


def test_image_duplicates_and_selection(spark):
    im = spark.createDataFrame([("1", "x", "h1"), ("2", "x", "h2"), ("3", None, "h1"), ("4", None, None)], "image_id string, xref string, hash string")
    assert sorted(r.image_id for r in figures.unique_images(im, ["xref", "hash"]).collect()) == ["1", "4"]
    s = spark.createDataFrame([("s", "a", "p", 1, 0.9, [1.0, 0.0]), ("s", "b", "p", 2, 0.8, [0.0, 1.0]), ("s", "c", "q", 9, 0.7, [1.0, 0.01]), ("s", "d", "q", 20, 0.6, None)], "section string, image_id string, source string, page long, score double, embedding array<double>")
    assert [r.image_id for r in figures.select_images(s, 3).orderBy("rank").collect()] == ["a", "d"]


def test_visual_clusters_and_sequences(spark):
    v = spark.createDataFrame([("i1", "s1", 3, "c1", "x"), ("i2", "s1", 9, None, "y"), ("i3", "s9", 1, None, "facial nerve course")], "image_id string, source_id string, page long, chunk_id string, text string")
    c = spark.createDataFrame([("c1", 1, "s1", 3, "other words"), ("c2", 2, "s2", 1, "facial nerve course here")], "chunk_id string, cluster_id long, source_id string, page long, content string")
    got = {(r.image_id, r.cluster_id): round(r.score, 2) for r in figures.visual_clusters(v, c).collect()}
    assert got == {("i1", 1): 1.0, ("i2", 1): 0.7, ("i3", 2): 0.75}
    q = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 5), ("b", 3, 4)], "seq_id string, step long, page long")
    assert {r.seq_id: r.valid for r in figures.validate_sequences(q).collect()} == {"a": True, "b": False}


def test_graph_and_outline(spark):
    t = spark.createDataFrame([(1, "A", "treats", "B"), (1, "a ", "TREATS", "b"), (2, "B", "odd", "C"), (3, None, "x", "C")], "chunk_id long, subject string, relation string, object string")
    nodes, edges = knowledge.ingest_graph(t)
    assert sorted(r.node for r in nodes.collect()) == ["a", "b", "c"] and sorted(map(tuple, edges.collect())) == [("a", "TREATS", "b"), ("b", "RELATED_TO", "c")]
    outline = spark.createDataFrame([(1, "Intro", []), (2, "Anatomy", ["nerve"]), (3, "Steps", ["cut", "nerve"])], "ord int, section string, keywords array<string>")
    cl = spark.createDataFrame([(1, "a nerve", None), (2, "cut nerve", None), (3, "none", None), (4, "x", "Steps")], "cluster_id long, text string, topic_hint string")
    got = {r.cluster_id: r.section for r in knowledge.assign_sections(cl, outline).collect()}
    assert got == {1: "Anatomy", 2: "Steps", 3: "Intro", 4: "Steps"}
    done = knowledge.complete_outline(outline, spark.createDataFrame([(9, "References")], "ord int, section string"), spark.createDataFrame([("Steps",)], ["section"]))
    assert [(r.ord, r.section) for r in done.orderBy("ord").collect()] == [(1, "Steps"), (2, "References")]


def test_search_compositions(spark):
    rows = [(1, "red fox", "a", [1.0, 0.0]), (2, "blue fox", "b", [0.0, 1.0]), (3, "green", "b", [0.9, 0.1])]
    c = spark.createDataFrame(rows, "id long, text string, source string, embedding array<double>")
    assert [r.id for r in knowledge.hybrid_search(c, "fox", [1.0, 0.0], 3).collect()] == [1, 3, 2]
    assert [r.id for r in knowledge.hybrid_search(c, "fox", [1.0, 0.0], 3, where=F.col("source") == "b").collect()] == [3, 2]
    d = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[1.0, 0.0]])], "id long, token_vectors array<array<double>>")
    assert [(r.id, r.score) for r in knowledge.late_interaction(d, [[1.0, 0.0], [0.0, 1.0]]).collect()] == [(1, 2.0), (2, 1.0)]
    top, im = knowledge.retrieve_topic(c.withColumnRenamed("id", "chunk_id"), spark.createDataFrame([("i", "a", [1.0, 0.0]), ("j", "z", [1.0, 0.0])], "image_id string, source string, embedding array<double>"), [1.0, 0.0], 2, 1)
    assert [r.chunk_id for r in top.collect()] == [1, 3] and [r.image_id for r in im.collect()] == ["i"]


def test_documents(spark):
    s = spark.createDataFrame([(2, "B", "y"), (1, "A & C", "x_1")], "ord int, title string, content string")
    v = knowledge.latex_document(s, "T").first().value
    assert v.index("\\section{A \\& C}\nx\\_1") < v.index("\\section{B}")
    r = knowledge.recoveries(spark.createDataFrame([("a_b_20240102_030405",), ("a_20230102_030405",), ("bad",)], ["name"])).collect()
    assert [x.topic for x in r] == ["a_b", "a"]

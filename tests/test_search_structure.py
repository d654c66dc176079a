"""Search, structure, reports, sinks and sources that no SQL can hold against, and their edge cases."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folio_spark import config
from folio_spark.functions import maps
from folio_spark.operators import catalog, figures, reports, search
from folio_spark.operators import structure as st
from folio_spark.sources import epub, files, sinks


def test_occurrences_of_variants(spark):
    df = spark.createDataFrame([(1, "The art of the ART. the  art"), (2, None), (3, ""), (4, "aaa")], "doc_id long, text string")
    got = [tuple(r) for r in search.occurrences_all(df, ["the art", "art", "aa"], 4).orderBy("doc_id", "position").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [(1, 0, "the art"), (1, 4, "art"), (1, 11, "the art"), (1, 15, "art"), (1, 25, "art"), (4, 0, "aa")]
    assert got[0][3] == "The art of..." and got[-2][3] == "...he art"


def test_search_modes(spark):
    pages = spark.createDataFrame([(1, "Needle work", "needle needle"), (2, "Other", "a needle"), (3, "Third", None), (4, "needles", "none")], "doc_id long, title string, text string")
    hits = spark.createDataFrame([(2, 0.9), (4, 0.5), (9, 0.4)], "doc_id long, score double")
    by = lambda mode: {r.doc_id: (r.origin, r.relevance) for r in search.search_library(pages, "Needle", hits, mode).collect()}
    assert by("keyword") == {1: ("keyword", 102.0), 2: ("keyword", 50.0)}
    assert by("semantic") == {2: ("semantic", 60.0), 4: ("semantic", 90.0)}
    assert by("hybrid") == {1: ("keyword", 102.0), 2: ("semantic", 60.0), 4: ("semantic", 90.0)}
    with pytest.raises(ValueError):
        search.search_library(pages, "x", None, "hybrid")


def test_expansion_by_whole_words(spark):
    words = spark.createDataFrame([(1, 1, "tumour", "tumor"), (2, 1, "CPA", "cerebellopontine angle"), (3, 1, "art", "craft"), (3, 2, "cpa tumour", "schwannoma")], "stage int, ord int, term string, variant string")
    q = spark.createDataFrame([("CPA  tumour",), ("party",), ("CPA  tumour",), ("",)], ["query"])
    got = {}
    for r in search.expand_by_dictionary(q, words).orderBy("query", "position").collect():
        got.setdefault(r.query, []).append(r.expanded)
    assert got == {"CPA  tumour": ["CPA  tumour", "cpa tumor", "cerebellopontine angle tumour", "schwannoma"], "party": ["party"], "": [""]}
    assert max(r.position for r in search.expand_by_dictionary(q, words, most=1).collect()) == 2


def test_rules(spark):
    df = spark.createDataFrame([("Do not touch",), ("risky",), (None,)], ["t"])
    assert [r[0] for r in df.select(search.safety_flag(F.col("t"))).collect()] == [True, False, False]
    images = spark.createDataFrame([("x", 50, 300), ("x", 50, 60), ("icon", 500, 500), (None, None, 50)], "k string, w int, h int")
    assert [r[0] for r in images.select(search.keep_images(F.col("k"), F.col("w"), F.col("h"), ["icon"])).collect()] == [True, False, False, True]
    dup = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "h"), (4, None, "h"), (5, None, None)], "image_id long, ref string, hash string")
    assert sorted(r.image_id for r in figures.unique_images(dup, ["ref", "hash"]).collect()) == [1, 3, 5]
    assert spark.range(1).select(maps.rendered(maps.merged(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)), F.create_map(F.lit("a"), F.lit(3))))).first()[0] == "a=3;b=1"


def test_reports_on_nothing(spark):
    none = spark.createDataFrame([], "feedback string, answer string")
    assert tuple(reports.evaluation_stats(none).first()) == (0, 0, 0.0, 0)
    some = spark.createDataFrame([("**Grade: 8.5/10**", "x"), ("Grade: 0/10", "SAFETY WARNING"), (None, None), ("Grade: ten/10", "")], "feedback string, answer string")
    assert tuple(reports.evaluation_stats(some).first()) == (4, 1, 8.5, 1)
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (1, None), (1, None), (2, None)], "c long, k string")
    assert {r.c: (r.topic, r.n_members) for r in reports.majority_topic(members, "c", "k").collect()} == {1: ("a", 5), 2: (None, 1)}


def test_eviction_by_brute_force(spark):
    for n, share in ((1, 0.2), (7, 0.2), (1000, 0.3), (500, 1.0)):
        df = spark.createDataFrame([((i * 37) % 11 if n < 1000 else i * 7919 % 1000, i) for i in range(n)], "at long, id long")
        left = sorted(r.id for r in catalog.evict_oldest(df, ["at", "id"], share).collect())
        want = sorted(r.id for r in df.orderBy("at", "id").collect()[max(1, int(n * share)) :])
        assert left == want
    assert catalog.evict_oldest(df.limit(0), ["at", "id"]).count() == 0


def test_hybrid_chunking(spark):
    paragraph = lambda n: " ".join(["w"] * n)
    rows = [(1, 0, "\n\n".join([paragraph(40), paragraph(40), paragraph(90)])), (1, 1, paragraph(5)), (1, 2, paragraph(6)), (1, 3, paragraph(7)), (2, 0, paragraph(3))]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no int, content string")
    split = st.split_large(df, 100)
    assert [len(r.content.split()) for r in split.orderBy("doc_id", "chunk_no", "part").collect()] == [80, 90, 5, 6, 7, 3]
    got = [(r.doc_id, r.position, r.n_merged, len(r.content.split())) for r in st.merge_small(split, 100).orderBy("doc_id", "position").collect()]
    assert got == [(1, 1, 1, 80), (1, 2, 1, 90), (1, 3, 2, 11), (1, 4, 1, 7), (2, 1, 1, 3)]


def test_font_sections(spark):
    lines = [(1, 0, 0, "front matter", 10.0, 0), (1, 1, 0, "Heading One", 16.5, 0), (1, 2, 0, "text", 10.0, 0), (1, 3, 1, "ab", 20.0, 0), (1, 4, 1, "1.2 Numbered part", 10.0, 0), (1, 5, 2, "more", 10.0, 0), (1, 6, 2, "Bold head", 11.5, 16), (2, 0, 0, "plain only", 9.0, 0)]
    df = spark.createDataFrame(lines, "doc long, n long, page long, line string, size double, flags int")
    got = [tuple(r) for r in st.sections_by_font(df, "doc", "n", "page", "line", "size", "flags").orderBy("doc", "section_no").collect()]
    assert got == [(1, 1, "Heading One", 1, 0, 1, "text\nab"), (1, 2, "1.2 Numbered part", 2, 1, 2, "more"), (2, 0, "Content", 1, 0, 0, "plain only")]


def test_bundle_and_index(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "id long, v array<double>")
    sinks.write_index(df, f"{tmp_path}/ix", "id", "v", "none")
    rows, meta = sinks.read_index(spark, f"{tmp_path}/ix")
    assert {r.id: r.norm for r in rows.collect()} == {1: 5.0, 3: 0.0} and meta == {"model": "none", "n_vectors": 2, "n_zero": 1, "width": 2}
    sinks.write_bundle({"a": df, "empty": df.limit(0)}, f"{tmp_path}/b", "bundle")
    assert {tuple(r) for r in sinks.verify_bundle(spark, f"{tmp_path}/b").collect()} == {("a", 3, True), ("empty", 0, True)}
    df.limit(1).write.mode("append").json(f"{tmp_path}/b/a")
    assert {tuple(r) for r in sinks.verify_bundle(spark, f"{tmp_path}/b").collect()} == {("a", 4, False), ("empty", 0, True)}


def book(order=("two", "one")):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        refs = "".join(f'<itemref idref="{x}"/>' for x in order)
        z.writestr("OPS/p.opf", f"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bo</dc:creator><dc:date>1999-05</dc:date></metadata>
            <manifest><item id="one" href="a%20one.xhtml"/><item id="two" href="b.xhtml"/><item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{refs}</spine></package>""")
        z.writestr("OPS/a one.xhtml", "<html><head><title>x</title></head><body><h1>One &amp; all</h1><p>first &#8212; text</p></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><p>second</p></body></html>")
        z.writestr("OPS/t.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a%20one.xhtml"/><navPoint><navLabel><text>Sub</text></navLabel><content src="b.xhtml#x"/></navPoint></navPoint></navMap></ncx>')
    return raw.getvalue()


def test_epub_structure(spark):
    df = spark.createDataFrame([("a.epub", bytearray(book())), ("bad.epub", bytearray(b"none"))], "path string, content binary")
    got = {r.path: r for r in epub.read_epubs(df).collect()}
    r = got["a.epub"]
    assert (r.title, r.authors, r.year, r.publisher) == ("Book", ["Ann", "Bo"], 1999, None)
    assert [tuple(c) for c in r.chapters] == [(0, "OPS/b.xhtml", None, "second"), (1, "OPS/a one.xhtml", "One & all", "One & all first — text")]
    assert [tuple(t) for t in r.toc] == [(1, "One", "OPS/a one.xhtml"), (2, "Sub", "OPS/b.xhtml#x")]
    assert got["bad.epub"].title is None and "BadZipFile" in got["bad.epub"].error


def test_paths_and_dates(spark):
    paths = [("lib/01_COMPLETE_TEXTBOOKS/03_Vascular_Surgery/Aneurysm/f.pdf",), ("lib/06_CLINICAL_GUIDELINES/f.pdf",), ("x/y.pdf",)]
    m = [tuple(r.m) for r in spark.createDataFrame(paths, ["p"]).select(files.folder_metadata(F.col("p")).alias("m")).collect()]
    assert m == [("Textbooks", "Vascular Surgery", "Aneurysm", 95), ("Guidelines", "General", None, 100), ("Unknown", "General", "x", 80)]
    d = spark.createDataFrame([("D:20210305120000Z",), ("D:2020",), ("D:20211399",), ("x",), (None,)], ["d"]).select(files.pdf_date(F.col("d"))).collect()
    assert [r[0] for r in d] == [datetime.date(2021, 3, 5), datetime.date(2020, 1, 1), None, None, None]
    s = spark.createDataFrame([("Big YOUMANS set", 3), ("other", None), ("other", 1)], "f string, n int")
    assert [r[0] for r in s.select(files.series_of(F.col("f"), {"youmans": "Youmans"})).collect()] == ["Youmans", "other", "other"]
    assert [r.n for r in s.orderBy(*files.chapter_order(F.col("n"), F.col("f"))).collect()] == [1, 3, None]


def test_settings():
    got = config.load({"top_k": "7", "strict": "yes"}, {"FOLIO_TOP_K": "9", "OTHER": "1"})
    assert (got.top_k, got.strict, got.chunk_size) == (9, True, 1500)
    with pytest.raises(ValueError):
        config.load({"nope": 1}, {})
    with pytest.raises(ValueError):
        config.load(None, {"FOLIO_STRICT": "perhaps"})

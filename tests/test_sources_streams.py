"""Sources, sinks and streams on temporary folders."""

import io
import zipfile

from pyspark.sql import functions as F

from folio_spark.sources import files, sinks
from folio_spark.streaming import windows as sw


def test_files_by_format(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.TXT").write_bytes("naïve".encode("latin-1"))
    buf = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(buf.getvalue())
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.parse_files(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"].text == got["b.TXT"].text == "naïve"
    assert got["c.docx"].text == "# T\n\nbody" and got["d.docx"].error.startswith("BadZipFile") and "e.bin" not in got


def test_headings_and_metadata(spark):
    df = spark.createDataFrame([("p", "# One\ntext\n## Two"), ("q", "1. First\nx\n1.2 Second"), ("r", "ALL CAPS\nx")], "path string, text string")
    got = sorted((r.path, r.level, r.title) for r in files.infer_headings(df).collect())
    assert got == [("p", 1, "One"), ("p", 2, "Two"), ("q", 1, "First"), ("q", 2, "Second"), ("r", 1, "ALL CAPS")]
    m = files.text_metadata(spark.createDataFrame([("Title\nby A. One and B. Two\n1999",)], ["text"])).first()
    assert (m.title, m.year, m.authors) == ("Title", 1999, ["A. One", "B. Two"])


def test_index_lines(spark, tmp_path):
    (tmp_path / "x.ini").write_text("[A]\nAneurysm\tABC-1 12, Foo 3\nBrain — DEF 1\naneurysm\tXYZ 9\nClip\tsee Brain\n")
    got = {r.term: r for r in files.index_lines(spark, str(tmp_path / "x.ini")).collect()}
    assert got["aneurysm"].references == ["XYZ 9"] and got["brain"].primary_sources == ["DEF"] and got["clip"].see == "Brain"


def test_upsert_and_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    sinks.merge_into(spark, path, make((1, "a"), (2, "b")), ["id"])
    sinks.merge_into(spark, path, make((2, "x"), (2, "y"), (3, "c")), ["id"], [F.desc("v")])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "y"), (3, "c")]
    kids = str(tmp_path / "k")
    spark.createDataFrame([(10, 1), (11, 3)], "kid long, parent long").write.parquet(kids)
    sinks.delete_children(spark, path, kids, F.col("id") == 1, "id", "parent")
    assert [r.kid for r in spark.read.parquet(kids).collect()] == [11] and spark.read.parquet(path).count() == 2


def test_documents_and_names(spark):
    df = spark.createDataFrame([("S", "C2", "b", 1), ("S", "C1", "a", 2), ("S", "C1", "z", 1)], "s string, c string, l string, o int")
    assert sinks.grouped_document(df, "s", "c", F.col("l"), F.col("o")).first().value == "# S\n\n## C1\n\nz\na\n\n## C2\n\nb\n"
    n = sinks.unique_names(spark.createDataFrame([(1, "f.png"), (2, "f.png")], "i int, name string"), "name", "i")
    assert [r.file_name for r in n.orderBy("i").collect()] == ["f.png", "f_1.png"]


def test_incremental_index_is_idempotent(spark, tmp_path):
    src, index = str(tmp_path / "in"), str(tmp_path / "ix")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "page long, checksum string").write.parquet(src)
    stream = lambda: spark.readStream.schema("page long, checksum string").parquet(src)
    for run in ("c1", "c2"):  # a second run without the first one's checkpoint sees all rows again
        sw.index_batches(stream(), index, str(tmp_path / run), ["page", "checksum"]).awaitTermination()
    assert spark.read.parquet(index).count() == 2


def test_expiry(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL), (2, TIMESTAMP'2000-01-01'), (3, TIMESTAMP'2999-01-01') AS t(id, expires_at)")
    assert sorted(r.id for r in df.where(sw.live()).collect()) == [1, 3]

"""PDF files written here by hand: tables and streams of cross-references, compressed objects, fonts, outlines, damage."""

import random
import zlib

import pytest

from folio_spark.operators import structure as st
from folio_spark.sources import files, pdf


def stream(data, extra=b"", pack=True):
    if pack:
        data, extra = zlib.compress(data), extra + b"/Filter/FlateDecode"
    return b"<<" + extra + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"


def table_file(objects, trailer):
    """Objects by number with a classic cross-reference table."""
    out, at = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n" for n in range(1, size))
    return bytes(out + b"trailer\n<</Size %d" % size + trailer + b">>\nstartxref\n%d\n%%%%EOF" % start)


def stream_file(objects, trailer, packed):
    """Objects in ``packed`` go to an object stream; the cross-references are a stream with a predictor."""
    out, at = bytearray(b"%PDF-1.5\n"), {}
    holder, xref = max(objects) + 1, max(objects) + 2
    head, body = b"", b""
    for n in packed:
        head += b"%d %d " % (n, len(body))
        body += objects[n] + b" "
    plain = {n: b for n, b in objects.items() if n not in packed} | {holder: stream(head + body, b"/Type/ObjStm/N %d/First %d" % (len(packed), len(head)))}
    for n, b in plain.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + b + b"\nendobj\n"
    at[xref] = len(out)
    rows = [b"\0\0\0\0"]
    for n in range(1, xref + 1):
        rows.append(b"\2" + holder.to_bytes(2, "big") + bytes([packed.index(n)]) if n in packed else b"\1" + at[n].to_bytes(2, "big") + b"\0" if n in at else b"\0\0\0\0")
    before, coded = b"\0" * 4, b""
    for r in rows:  # "up" predictor
        coded += b"\2" + bytes((x - y) & 255 for x, y in zip(r, before))
        before = r
    info = b"/Type/XRef/W[1 2 1]/Size %d/DecodeParms<</Predictor 12/Columns 4>>" % (xref + 1)
    out += b"%d 0 obj\n" % xref + stream(coded, info + trailer) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at[xref]
    return bytes(out)


PAGE_1 = b"BT /F2 18 Tf 72 720 Td (Deep Anatomy) Tj /F1 11 Tf 0 -30 Td (The first \\(and only\\) line) Tj T* 0 -14 Td [(Kern) -20 (ed) -600 (words) ] TJ ET"
PAGE_2 = b"q 1 0 0 1 72 700 cm BT /F1 11 Tf 14 TL (above) Tj (below) ' ET Q /X1 Do BT /F3 11 Tf 1 0 0 1 72 600 Tm <00010002> Tj ET"
CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00C4> endbfchar 1 beginbfrange <0002> <0003> <006200630041> endbfrange"
OBJECTS = {
    1: b"<</Type/Catalog/Pages 2 0 R/Outlines 12 0 R/Names<</Dests 17 0 R>>>>",
    2: b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/Resources<</Font<</F1 7 0 R/F2 8 0 R/F3 9 0 R>>/XObject<</X1 11 0 R>>>>>>",
    3: b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>",
    4: b"<</Type/Page/Parent 2 0 R/Contents[6 0 R]>>",
    5: stream(PAGE_1),
    6: stream(PAGE_2, pack=False),
    7: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</Differences[1/fi/uni00E9]>>>>",
    8: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold>>",
    9: b"<</Type/Font/Subtype/Type0/BaseFont/Sub/ToUnicode 10 0 R/DescendantFonts[<</DW 600/W[1[500 700]]>>]>>",
    10: stream(CMAP),
    11: stream(b"BT /F1 11 Tf 72 650 Td (\\001nal caf\\002) Tj ET", b"/Subtype/Form"),
    12: b"<</First 13 0 R/Last 14 0 R>>",
    13: b"<</Title(Part One)/Parent 12 0 R/Next 14 0 R/First 15 0 R/Dest[3 0 R/Fit]>>",
    14: b"<</Title<FEFF00C400740065>/Parent 12 0 R/A<</S/GoTo/D(end)>>>>",
    15: b"<</Title(Inner)/Parent 13 0 R/Dest[4 0 R/XYZ 0 0 0]/Next 13 0 R>>",
    16: b"<</Title(A Handbook)/Author(Jo Doe and Al Bo)/CreationDate(D:20190304120000Z)>>",
    17: b"<</Names[(end)[4 0 R/Fit]]>>",
}
TRAILER = b"/Root 1 0 R/Info 16 0 R"
LINES = [(1, "Deep Anatomy", 18.0, 16), (1, "The first (and only) line", 11.0, 0), (1, "Kerned words", 11.0, 0), (2, "above", 11.0, 0), (2, "below", 11.0, 0), (2, "final café", 11.0, 0), (2, "ÄbcA", 11.0, 0)]


def check(found):
    assert (found["title"], found["author"], found["year"], found["n_pages"]) == ("A Handbook", "Jo Doe and Al Bo", 2019, 2)
    assert [(x["level"], x["title"], x["page"]) for x in found["toc"]] == [(1, "Part One", 1), (2, "Inner", 2), (1, "Äte", 2)]
    assert [(x["page"], x["text"], x["size"], x["flags"]) for x in found["lines"]] == LINES


def test_table_and_stream_files():
    check(pdf.read(table_file(OBJECTS, TRAILER)))
    check(pdf.read(stream_file(OBJECTS, TRAILER, [1, 2, 3, 4, 7, 8, 12, 13, 14, 15, 16])))


def test_updates_take_the_newest_objects():
    first = table_file(OBJECTS, TRAILER)
    start = int(first.rsplit(b"startxref\n", 1)[1].split()[0])
    body = b"\n16 0 obj\n<</Title(Second)>>\nendobj\n"
    xref = b"xref\n16 1\n%010d 00000 n \ntrailer\n<</Size 18/Prev %d%s>>\nstartxref\n%d\n%%%%EOF" % (len(first) + 1, start, TRAILER, len(first) + len(body))
    assert pdf.read(first + body + xref)["title"] == "Second"


def test_damaged_files_are_rebuilt_or_refused():
    good = table_file(OBJECTS, TRAILER)
    check(pdf.read(good.replace(b"startxref\n", b"startxref\n9")))
    check(pdf.read(b"junk before\n" + good))
    assert pdf.read(stream_file(OBJECTS, TRAILER, [1, 2, 3, 4, 16]).replace(b"startxref", b"startxxxx"))["title"] == "A Handbook"
    for bad in (b"", b"no pdf", b"%PDF-1.4\n", table_file(OBJECTS, TRAILER + b"/Encrypt<<>>"), table_file(OBJECTS | {5: stream(PAGE_1, b"/Filter/JBIG2Decode", pack=False)}, TRAILER)):
        with pytest.raises(pdf.PdfError):
            pdf.read(bad)
    loop = OBJECTS | {2: b"<</Type/Pages/Kids[2 0 R 3 0 R]/Resources 2 0 R>>", 11: stream(b"/X1 Do", b"/Subtype/Form")}
    assert pdf.read(table_file(loop, TRAILER))["n_pages"] == 1


def test_random_damage_never_hangs():
    rng = random.Random(2)
    good = table_file(OBJECTS, TRAILER)
    for _ in range(150):
        raw = bytearray(good)
        for _ in range(rng.randint(1, 12)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            pdf.read(bytes(raw[: rng.randint(len(raw) // 2, len(raw))]))
        except Exception as e:  # noqa: BLE001
            assert not isinstance(e, (RecursionError, MemoryError, KeyboardInterrupt)), e


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_predictors(kind):
    rng = random.Random(kind)
    rows = [bytes(rng.randrange(256) for _ in range(6)) for _ in range(5)]
    coded, before = b"", b"\0" * 6
    for r in rows:
        line = []
        for i, x in enumerate(r):
            a, b, c = (r[i - 2] if i > 1 else 0), before[i], (before[i - 2] if i > 1 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        coded += bytes([kind, *line])
        before = r
    assert pdf._predicted(coded, {"Predictor": 15, "Colors": 2, "Columns": 3}) == b"".join(rows)


def test_files_to_sections_and_toc(spark, tmp_path):
    for name, raw in (("a.pdf", table_file(OBJECTS, TRAILER)), ("b.pdf", b"broken")):
        (tmp_path / name).write_bytes(raw)
    found = pdf.read_pdfs(files.read_files(spark, str(tmp_path))).cache()
    by = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert by["a.pdf"]["error"] is None and by["a.pdf"]["year"] == 2019
    assert by["b.pdf"]["error"].startswith("PdfError") and by["b.pdf"]["lines"] is None
    none = spark.createDataFrame([("x", None), ("y", bytearray())], "path string, content binary")
    assert all(r["error"] and r["n_pages"] is None for r in pdf.read_pdfs(none).collect())
    sections = st.sections_by_font(pdf.pdf_lines(found), "path", "position", "page", "line", "size", "flags").collect()
    assert [(r["title"], r["content"].split("\n")[0]) for r in sections if "first" in r["content"]] == [("Deep Anatomy", "The first (and only) line")]
    entries = st.toc_entries(found.where("error IS NULL"), "path", "toc")
    chunks = st.toc_chunks(entries, pdf.pdf_pages(found), "path", "entry_no", "page", "text").orderBy("entry_no").collect()
    assert [(r["page_from"], r["content"].split("\n")[0]) for r in chunks] == [(1, "Deep Anatomy"), (2, "above")]
    text = {r["path"].rsplit("/", 1)[1]: r for r in files.parse_files(files.read_files(spark, str(tmp_path))).collect()}
    assert text["a.pdf"]["text"].startswith("[Page 1]\nDeep Anatomy\n") and text["b.pdf"]["error"]

"""EPUB: metadata, reading order, table of contents and chapters, by the standard library alone."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_DC = "{http://purl.org/dc/elements/1.1/}"
_OPF = "{http://www.idpf.org/2007/opf}"
_BOX = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_NCX = "{http://www.daisy.org/z3986/2005/ncx/}"

SCHEMA = (
    "path string, title string, authors array<string>, year int, publisher string, language string, "
    "toc array<struct<level:int,title:string,target:string>>, chapters array<struct<position:int,name:string,title:string,text:string>>, error string"
)


def plain(html: str) -> str:
    body = re.sub(r"(?is)<(script|style|head)[^>]*>.*?</\1>", " ", html)
    return " ".join(unescape(re.sub(r"(?s)<[^>]*>", " ", body)).split())


def _first_heading(html: str) -> str | None:
    found = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", html)
    return plain(found[1]) if found else None


def _ncx(node, level: int = 1) -> Iterator[tuple[int, str, str]]:
    for point in node.findall(_NCX + "navPoint"):
        label, content = point.find(f"{_NCX}navLabel/{_NCX}text"), point.find(_NCX + "content")
        yield level, (label.text or "").strip() if label is not None else "", content.get("src", "") if content is not None else ""
        yield from _ncx(point, level + 1)


def spine(z: zipfile.ZipFile) -> tuple[ElementTree.Element | None, str, list[str], str | None]:
    """The package, its folder, the documents in reading order and the name of the NCX; without a package all pages by name."""
    names = set(z.namelist())
    try:
        root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(f".//{_BOX}rootfile").get("full-path")
        package = ElementTree.fromstring(z.read(root))
    except (KeyError, AttributeError, ElementTree.ParseError):
        return None, "", sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))), None
    folder = posixpath.dirname(root)
    place = lambda href: posixpath.normpath(posixpath.join(folder, unquote(href)))
    items = {i.get("id"): (place(i.get("href", "")), i.get("media-type", "")) for i in package.iter(_OPF + "item")}
    order = [items[r.get("idref")][0] for r in package.iter(_OPF + "itemref") if r.get("idref") in items]
    ncx = next((p for p, kind in items.values() if kind == "application/x-dtbncx+xml" and p in names), None)
    return package, folder, [n for n in order if n in names], ncx


def read(raw: bytes) -> dict:
    z = zipfile.ZipFile(io.BytesIO(raw))
    package, _, order, ncx = spine(z)
    texts = lambda tag: [(e.text or "").strip() for e in (package.iter(_DC + tag) if package is not None else ()) if (e.text or "").strip()]
    one = lambda tag: next(iter(texts(tag)), None)
    year = re.search(r"(1[0-9]|20)[0-9]{2}", one("date") or "")
    toc = []
    if ncx:
        base = posixpath.dirname(ncx)
        nav = ElementTree.fromstring(z.read(ncx)).find(_NCX + "navMap")
        toc = [(level, title, posixpath.normpath(posixpath.join(base, unquote(target)))) for level, title, target in (_ncx(nav) if nav is not None else ())]
    chapters = []
    for name in order:
        html = z.read(name).decode("utf-8", "replace")
        text = plain(html)
        if text:
            chapters.append((len(chapters), name, _first_heading(html), text))
    return {"title": one("title"), "authors": texts("creator"), "year": int(year[0]) if year else None, "publisher": one("publisher"), "language": one("language"), "toc": toc, "chapters": chapters, "error": None}


def read_epubs(files: DataFrame) -> DataFrame:
    """A row a file of ``files(path, content)``; what can't be read has its error in a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows.append({"path": path, **read(raw)})
                except Exception as e:  # noqa: BLE001
                    rows.append({"path": path, "title": None, "authors": [], "year": None, "publisher": None, "language": None, "toc": [], "chapters": [], "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(rows).astype({"year": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)

"""Text expressions: Column in, Column out.  Word classes are spelt out, never ``\\w`` or ``\\b``, so that engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD = r"[^ \t\n\r\x0b\x0c]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens of two letters, digits or underscores at least."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def words(text: Column) -> Column:
    """White-space words."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")


def content_hash(text: Column, length: int = 16) -> Column:
    """Start of the SHA-256 of the stripped, lower-cased text."""
    return F.substring(F.sha2(F.lower(stripped(text)), 256), 1, length)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def presence(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def sentences(text: Column) -> Column:
    """Split behind full stops, exclamation and question marks; blank pieces go."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r\x0b\x0c]+", "$1\u0001"), "\u0001")
    return F.filter(cut, lambda s: F.length(F.trim(s)) > 0)


def paragraphs(text: Column, separator: str = r"\n[ \t]*\n", least: int = 20) -> Column:
    """Trimmed paragraphs of more than ``least`` characters."""
    return F.filter(F.transform(F.split(text, separator), stripped), lambda p: F.length(p) > least)


def collapse(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\x0b\x0c]+", " "))


#: LaTeX's special characters and their escapes.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: Column) -> Column:
    """One pass over the characters, so that nothing inserted is escaped again."""
    mapping = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    return F.array_join(F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(mapping, ch), ch)), "")


def latex_unescape(text: Column) -> Column:
    out = text
    for k, v in sorted(LATEX.items(), key=lambda kv: -len(kv[1])):
        out = F.replace(out, F.lit(v), F.lit("\u0000" if k == "\\" else k))
    return F.replace(out, F.lit("\u0000"), F.lit("\\"))


def label_sanitize(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def bib_key(author: Column, year: Column, title: Column) -> Column:
    """Last word of the author, year, first longer word of the title."""
    first = F.get(F.filter(F.split(F.lower(title), " "), lambda w: F.length(w) > 3), 0)
    return F.concat(F.regexp_replace(F.lower(F.element_at(F.split(author, " "), -1)), "[^a-z0-9]", ""), year.cast("string"), F.coalesce(first, F.lit("untitled")))


def markdown_to_latex(text: Column) -> Column:
    out = F.regexp_replace(text, r"\*\*([^*]+)\*\*", r"\\textbf{$1}")
    out = F.regexp_replace(out, r"\*([^*]+)\*", r"\\textit{$1}")
    return F.regexp_replace(out, r"\[@([A-Za-z0-9_:-]+)\]", r"\\cite{$1}")


def balanced_braces(text: Column) -> Column:
    """Whether unescaped braces nest and close."""
    plain = F.regexp_replace(text, r"\\[{}]", "")
    depth = F.aggregate(
        F.split(plain, ""),
        F.lit(0),
        lambda acc, ch: F.when(acc < 0, acc).when(ch == "{", acc + 1).when(ch == "}", acc - 1).otherwise(acc),
    )
    return depth == 0


def dois(text: Column) -> Column:
    """DOIs in order of first appearance, trailing punctuation cut."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]+"), 0)
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;:)]+$", "")))


def json_block(text: Column) -> Column:
    """The first bracketed or braced block of free text, to its last closing sign."""
    block = F.regexp_extract(text, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.when(block == "", None).otherwise(block)


def safe_name(text: Column, length: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "_"), "^_+|_+$", ""), 1, length)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments cut, tags to spaces, basic character references decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(ch))
    return collapse(out)

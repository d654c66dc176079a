"""Rule classifiers over text: every dictionary is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import text as tx


def counts(text: Column, patterns: dict[str, list[str]]) -> dict[str, Column]:
    """Matches of each class's regular expressions."""
    return {name: sum((F.regexp_count(text, F.lit(p)) for p in ps), F.lit(0)) for name, ps in patterns.items()}


def argmax(scores: dict[str, Column], least: float, default: str) -> Column:
    """The class of the largest score, the first declared on ties, if it reaches ``least``."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(top < least, F.lit(default))
    for name, s in scores.items():
        out = out.when(s == top, F.lit(name))
    return out.otherwise(F.lit(default))


def content_type(text: Column, patterns: dict[str, list[str]], override: tuple[str, Column] | None = None, least: int = 2, default: str = "general") -> Column:
    """Chunk type by regex counts; ``override`` (class, condition) wins where its condition holds."""
    out = argmax(counts(text, patterns), least, default)
    return out if override is None else F.when(override[1], F.lit(override[0])).otherwise(out)


def specialty(text: Column, terms: dict[str, list[str]], default: str = "general") -> Column:
    """Class with the most terms present."""
    return argmax({k: tx.presence(text, v) for k, v in terms.items()}, 1, default)


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Class of the first rule with any term present."""
    out = None
    for name, terms in rules:
        cond = F.lit(False)
        for t in terms:
            cond = cond | F.contains(text, F.lit(t))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def query_class(query: Column, rules: list[tuple[str, list[str]]], default: str = "factual", substring: bool = False) -> Column:
    """Query class by whole words in rule order; ``substring`` also accepts parts of words."""
    if substring:
        return first_match(F.lower(query), rules, default)
    out = None
    for name, terms in rules:
        pattern = r"(?<![\p{L}\p{N}_])(" + "|".join(terms) + r")(?![\p{L}\p{N}_])"
        cond = F.lower(query).rlike(pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def query_intent(queries: DataFrame, strong: dict[str, list[str]], endings: dict[str, list[str]], query: str = "query") -> DataFrame:
    """``query, cleaned_query, intent, confidence``: a strong keyword anywhere, else the longest ending keyword, which is cut off."""
    q = F.lower(F.trim(F.col(query)))
    strong_rows = sorted(((k, kw) for k, kws in strong.items() for kw in kws), key=lambda x: (-len(x[1]), x[1]))
    end_rows = sorted(((k, kw) for k, kws in endings.items() for kw in kws), key=lambda x: (-len(x[1]), x[1]))
    hit = lambda kw: q.rlike(r"(?<![\p{L}\p{N}_])" + kw + r"(?![\p{L}\p{N}_])")
    intent, cleaned, conf = F.lit("GENERAL"), F.trim(F.col(query)), F.lit(0.5)
    for k, kw in reversed(end_rows):
        cond = q.endswith(" " + kw)
        intent, conf = F.when(cond, k).otherwise(intent), F.when(cond, 0.9).otherwise(conf)
        cleaned = F.when(cond, F.trim(F.expr(f"substring({query}, 1, length(trim({query})) - {len(kw)})"))).otherwise(cleaned)
    for k, kw in reversed(strong_rows):
        # A strong keyword decides the intent; it is only cut where it ends the query.
        intent, conf = F.when(hit(kw), k).otherwise(intent), F.when(hit(kw), 0.9).otherwise(conf)
    return queries.select(query, cleaned.alias("cleaned_query"), intent.alias("intent"), conf.alias("confidence"))


def evidence(text: Column, levels: list[tuple[str, list[str]]]) -> Column:
    """``array<struct<level, rank, confidence, distinct, total>>`` of the levels found.

    Confidence is ``min(1, .3 * distinct + .1 * total)`` over the matches of a level's patterns, summed in
    whole tenths: sums of fractions would tell equal confidences apart in their last digit.
    """
    low = F.lower(text)
    found = []
    for rank, (name, patterns) in enumerate(levels, 1):
        hits = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), 0) for p in patterns]))
        d, n = F.size(F.array_distinct(hits)), F.size(hits)
        found.append(
            F.struct(F.lit(name).alias("level"), F.lit(rank).alias("rank"), (F.least(F.lit(10), 3 * d + n) / 10.0).alias("confidence"), d.alias("distinct"), n.alias("total"))
        )
    return F.filter(F.array(*found), lambda x: x["total"] > 0)


def best_evidence(found: Column, least: float = 0.3) -> Column:
    """The level of most confidence, the stronger one on ties."""
    ok = F.filter(found, lambda x: x["confidence"] >= least)
    ranked = F.array_sort(F.transform(ok, lambda x: F.struct((-x["confidence"]).alias("c"), x["rank"].alias("r"), x["level"].alias("level"))))
    return F.get(ranked, 0)["level"]


def keyword_score(text: Column, dictionary: dict[str, tuple[float, list[str]]], context: float = 1.0) -> Column:
    """``min(1, context * sum w * (1 - .5 ** n))`` over categories, n the occurrences of a category's keywords."""
    low = F.lower(text)
    total = F.lit(0.0)
    for weight, words in dictionary.values():
        n = sum((tx.occurrences(low, w) for w in words), F.lit(0))
        total = total + weight * (1 - F.pow(F.lit(0.5), n))
    return F.least(F.lit(1.0), context * total)


def section_headers(df: DataFrame, patterns: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Header lines: ``id, line_no, start_offset, title, section_type``; the first pattern that matches a line decides."""
    lines = line_offsets(df, id_col, text_col)
    kind = None
    for name, p in patterns:
        cond = F.lower(F.trim("line")).rlike(p)
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
    return lines.withColumn("section_type", kind).where("section_type IS NOT NULL").select(id_col, "line_no", "start_offset", F.trim("line").alias("title"), "section_type")


def line_offsets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with the character offset they start at, by a fold within the row: no shuffle."""
    lengths = F.transform(F.split(text_col, "\n"), F.length)
    starts = F.aggregate(
        lengths,
        F.expr("CAST(array(0) AS array<int>)"),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)),
    )
    rows = df.select(id_col, F.arrays_zip(F.split(text_col, "\n").alias("line"), F.slice(starts, 1, F.size(lengths)).alias("start_offset")).alias("z"))
    return rows.select(id_col, F.posexplode("z").alias("line_no", "z")).select(id_col, "line_no", F.col("z.start_offset").alias("start_offset"), F.col("z.line").alias("line"))


def section_windows(headers: DataFrame, total_pages: Column, doc: str = "doc_id") -> DataFrame:
    """``start_page, end_page`` of a section: until the next header's page, the last one five pages at most."""
    from pyspark.sql import Window

    nxt = F.lead("page").over(Window.partitionBy(doc).orderBy("page", "start_offset"))
    return headers.withColumn("start_page", F.col("page")).withColumn("end_page", F.coalesce(nxt, F.least(F.col("page") + 4, total_pages)))


def image_validity(width: Column, height: Column, area_share: Column, least: int = 100, aspect: float = 8.0, area: float = 0.01) -> Column:
    """``struct<valid, reason>``: size, aspect ratio and area rules in order."""
    ratio = F.greatest(width / height, height / width)
    reason = F.when((width < least) | (height < least), "too_small").when(ratio > aspect, "aspect").when(area_share < area, "area")
    return F.struct(reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def step_number(text: Column) -> Column:
    """Number of a step, stage or phase; a letter counts from a = 1."""
    low = F.lower(text)
    number = F.regexp_extract(low, r"(?:step|stage|phase)[ \t]+([0-9]+)", 1)
    letter = F.regexp_extract(low, r"(?:step|stage|phase)[ \t]+([a-z])(?![a-z])", 1)
    return F.when(number != "", F.try_to_number(number, F.lit("9999")).cast("int")).when(letter != "", F.ascii(letter) - 96)


def bands(value: Column, edges: list[tuple[float, str]], default: str) -> Column:
    out = None
    for limit, name in edges:
        out = F.when(value >= limit, name) if out is None else out.when(value >= limit, name)
    return out.otherwise(default)

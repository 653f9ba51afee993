"""Features of text pages: headings, tables, appendices, how good an extraction is; texts made of record fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .questions import normalize_space

HEADING = r"^(?:(?:section|article|chapter|part|appendix|schedule)\s+[0-9ivxlc.]+\b.*|[0-9]+(?:\.[0-9]+)*[.)]\s+\S.*)$"
APPENDIX = r"^(?:appendix|annex|schedule)\b"
YEARS = r"\b(?:19|20)[0-9]{2}\s*-\s*(?:19|20)[0-9]{2}\b"


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def headings(text: Column) -> Column:
    """Heading lines among the first forty, each once."""
    return F.array_distinct(F.filter(F.slice(lines(text), 1, 40), lambda x: F.rlike(F.lower(x), F.lit(HEADING))))


def looks_like_table(text: Column) -> Column:
    """Wide gaps in a third of the lines, or several numbers in half of them."""
    rows = lines(text)
    gaps = F.size(F.filter(rows, lambda x: F.rlike(x, F.lit(r"\S\s{3,}\S"))))
    dense = F.size(F.filter(rows, lambda x: (F.regexp_count(x, F.lit("[0-9]")) >= 3) & (F.size(F.split(x, r"\s+")) >= 3)))
    third, half = F.floor(F.size(rows) / 3), F.floor(F.size(rows) / 2)
    return (F.size(rows) >= 3) & ((gaps >= F.greatest(F.lit(2), third)) | (dense >= F.greatest(F.lit(2), half)))


def extraction_score(text: Column) -> Column:
    """How good a page's extracted text looks: length, words and headings, less broken glyphs, lone characters and pipes."""
    t = normalize_space(F.coalesce(text, F.lit("")))
    count = lambda p: F.regexp_count(t, F.lit(p))
    lone = F.size(F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) == 1))
    score = F.length(t) * 0.01 + count("[ঀ-৿]") * 0.03 + count("[A-Za-z]{2,}") * 0.01 + count(r"(?:^|\n)[0-9]+(?:\.[0-9]+)*") * 0.75
    return score + count("## ") * 1.2 - count("�") * 1.5 - lone * 0.35 - count(r"\|") * 0.05


def best_extraction(candidates: DataFrame, keys: list[str], text: str, extractor: str) -> DataFrame:
    """The best-scored text of each page among its extractors' candidates; ties to the first extractor by name."""
    scored = candidates.withColumn("_s", extraction_score(F.col(text)))
    return scored.groupBy(*keys).agg(F.min_by(F.struct(text, extractor), F.struct((-F.col("_s")).alias("s"), extractor)).alias("_b")).select(*keys, f"_b.{text}", f"_b.{extractor}")


def page_features(pages: DataFrame, text: str) -> DataFrame:
    """``pages`` with n_lines, headings, years and the flags is_appendix, is_example, is_table_like."""
    own = F.col(text)
    heads = headings(own)
    top = F.slice(lines(own), 1, 15)
    return pages.withColumns({
        "n_lines": F.size(lines(own)), "headings": heads, "years": F.array_distinct(F.regexp_extract_all(own, F.lit(YEARS), F.lit(0))),
        "is_appendix": F.exists(F.concat(heads, top), lambda x: F.rlike(F.lower(x), F.lit(APPENDIX))), "is_example": F.exists(top, lambda x: F.rlike(F.lower(x), F.lit(r"^example\b"))), "is_table_like": looks_like_table(own),
    })


def search_text(fields: list[Column], twice: int = 0) -> Column:
    """The fields that aren't blank, joined by spaces; the first ``twice`` of them twice, to weigh more."""
    values = [F.nullif(F.trim(f), F.lit("")) for f in fields]
    return F.concat_ws(" ", *[v for i, v in enumerate(values) for _ in range(2 if i < twice else 1)])


def snippet(short: Column, full: Column, attributes: Column) -> Column:
    """240 characters of a description, else the attributes as sorted "key: value" pairs."""
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), ", ")
    return F.coalesce(F.substring(F.coalesce(F.nullif(short, F.lit("")), F.nullif(full, F.lit(""))), 1, 240), pairs)

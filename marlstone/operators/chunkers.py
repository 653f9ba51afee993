"""Cutting pages of law into blocks, tables into rows, and long passages at their sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a line of a page is.
LINES = {
    "page_number": r"^[0-9]{4,6}$",
    "context": r"^(?:(?i)(?:PART|CHAPTER)\s+[IVXLC0-9]+\s*$)|^[A-Z][A-Z\s,&/-]{2,}$",
    "section": r"^(?i)[0-9]+[a-z]?(?:\.[0-9]+)?\.\s+[a-z].+",
    "clause": r"^\([0-9]+[A-Za-z]?\)\s+",
    "example": r"(?i)example|উদাহরণ",
    "footnote": r"^(?i)[0-9]+\s+(?:The words?|The figures?|The brackets?|The punctuation|The sentence|The paragraph|The expression)\b",
    "structural": r"^(?:\(?[0-9]+\)?|[|:.\-–—/ ]+)$",
    "table_serial": r"^[0-9]+\.$",
    "table_code": r"^[0-9]{2,4}(?:\.[0-9]{2,4}){1,3}$",
}


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_line(line: Column, kind: str) -> Column:
    return F.rlike(line, F.lit(LINES[kind]))


def low_value(text: Column) -> Column:
    """Whether a passage says nothing: no lines, only page numbers and rules, or under 20 characters without a letter."""
    lines = lines_of(text)
    bare = F.forall(lines, lambda x: is_line(x, "page_number") | is_line(x, "structural"))
    return bare | ((F.length(F.trim(text)) < 20) & ~F.rlike(text, F.lit(r"\p{L}"))) | text.isNull()


def cleaned(text: Column) -> Column:
    """A passage without the numbers, rules and headings of the page around it, and from its first footnote on."""
    lines = lines_of(text)
    edge = lambda x: is_line(x, "page_number") | is_line(x, "structural") | is_line(x, "context")
    flags = F.transform(lines, lambda x: ~edge(x))
    first, last = F.array_position(flags, True), F.size(flags) - F.array_position(F.reverse(flags), True) + 1
    inner = F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))).otherwise(F.slice(lines, 1, 0))
    note = F.array_position(F.transform(inner, lambda x: is_line(x, "footnote")), True)
    return F.array_join(F.when(note > 0, F.slice(inner, F.lit(1), (note - 1).cast("int"))).otherwise(inner), "\n")


def page_blocks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, kind, heading, n_lines, chunk): a page's lines in blocks.

    A block starts at a section's heading, an example, after a context heading (part, chapter, capitals: they lead, but belong
    to no block), and, under a heading of definitions, at a clause. Page numbers are left out. Boundaries are flags and blocks
    their running sum within a page, so pages are independent.
    """
    rows = pages.select(key, F.posexplode(lines_of(F.col(text))).alias("_at", "_line")).where(~is_line(F.col("_line"), "page_number"))
    w = Window.partitionBy(key).orderBy("_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("_line")
    rows = rows.withColumns({"_context": is_line(line, "context"), "_section": is_line(line, "section")}).withColumn("_section", F.col("_section") & ~F.col("_context"))
    rows = rows.withColumns({"_c": F.last(F.when(F.col("_context"), line), ignorenulls=True).over(so_far), "_s": F.last(F.when(F.col("_section"), line).when(F.col("_context"), F.lit("")), ignorenulls=True).over(so_far)})
    heading = F.concat_ws(" > ", "_c", F.nullif("_s", F.lit("")))
    example = is_line(line, "example") & ~F.col("_section") & ~F.col("_context")
    clause = is_line(line, "clause") & F.contains(F.lower(heading), F.lit("definitions"))
    after = F.coalesce(F.lag("_context").over(w), F.lit(True))
    rows = rows.withColumns({"_new": (F.col("_section") | example | clause | (after & ~F.col("_context"))).cast("int"), "_example": example, "_heading": heading}).withColumn("_block", F.sum("_new").over(so_far)).where("NOT _context")
    per = rows.groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct("_at", "_line"))).alias("_l"), F.max("_heading").alias("heading"), F.bool_or("_example").alias("_e"), F.bool_or("_section").alias("_t"))
    kind = F.when(F.col("_e"), "example").when(F.col("_t") | (F.col("heading") != ""), "section").otherwise("text")
    return per.select(key, F.col("_block").cast("long").alias("block"), kind.alias("kind"), "heading", F.size("_l").alias("n_lines"), F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("chunk"))


def table_rows(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, chunk): each row of a table under the table's first line; two lines or fewer stay together."""
    lines = lines_of(F.col(text))
    whole = F.array(F.array_join(lines, "\n"))
    rows = F.when(F.size(lines) <= 2, whole).otherwise(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat_ws("\n", lines[0], x)))
    return pages.select(key, F.when(F.size(lines) > 0, rows).alias("_r")).select(key, F.posexplode("_r").alias("row", "chunk"))


def structured_rows(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, codes, chunk): the blocks of a page of serials and codes: each serial starts one; a block's codes are its path."""
    rows = pages.select(key, F.posexplode(lines_of(F.col(text))).alias("_at", "_line")).where(~is_line(F.col("_line"), "page_number"))
    so_far = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_serial": is_line(F.col("_line"), "table_serial"), "_code": is_line(F.col("_line"), "table_code")})
    rows = rows.withColumns({"_block": F.sum(F.col("_serial").cast("int")).over(so_far), "_codes": F.sum(F.col("_code").cast("int")).over(so_far)}).where((F.col("_block") > 0) | (F.col("_codes") > 0))
    per = rows.groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct("_at", "_line", "_code"))).alias("_l"))
    codes = F.array_distinct(F.transform(F.filter("_l", lambda x: x["_code"]), lambda x: x["_line"]))
    return per.select(key, F.col("_block").cast("long").alias("block"), F.array_join(codes, ">").alias("codes"), F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("chunk"))


def long_segments(docs: DataFrame, key: str, text: str, most: int = 200) -> DataFrame:
    """(key, piece, n_tokens, chunk): passages packed from whole sentences up to ``most`` tokens; a longer sentence is cut into windows of tokens.

    A fold in the order of sentences, in Python within a document; a token is a run of word characters or a single mark.
    """
    import re

    token, edge = re.compile(r"[0-9A-Za-z_À-ɏঀ-৿]+|[^\s0-9A-Za-z_À-ɏঀ-৿]"), re.compile(r"(?<=[.;:!?])\s+")

    def cut(part: str) -> list[tuple[int, str]]:
        found = token.findall(part)
        return [(len(found), part)] if len(found) <= most else [(len(x), " ".join(x)) for i in range(0, len(found), most) if (x := found[i : i + most])]

    def pack(whole: str) -> list[tuple[int, str]]:
        out, own, n = [], [], 0
        for sentence in filter(None, (s.strip() for s in edge.split(whole))):
            size = len(token.findall(sentence))
            if own and (n + size > most or size > most):
                out.append((n, " ".join(own)))
                own, n = [], 0
            if size > most:
                out += cut(sentence)
            else:
                own.append(sentence)
                n += size
        return [*out, (n, " ".join(own))] if own else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, n, c) for k, t in zip(batch[key], batch[text], strict=True) for i, (n, c) in enumerate(pack(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "piece", "n_tokens", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, piece int, n_tokens int, chunk string")

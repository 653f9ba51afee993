"""Document trees from lines, and chunks that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import packed_segments

# What a line that opens a node of each level looks like, outermost first; the number is the first group.
LEVELS = (
    ("part", r"^part\s+([0-9ivxlc]+)\b"),
    ("chapter", r"^chapter\s+([0-9ivxlc]+)\b"),
    ("section", r"^(?:section\s+)?([0-9]+[a-z]?)\.\s"),
    ("subsection", r"^\(([0-9]+)\)\s"),
    ("clause", r"^\(([a-z])\)\s"),
)


def level_of(line: Column) -> Column:
    """The place in LEVELS of the node that a line opens; null if it opens none."""
    lower, level = F.lower(F.trim(line)), F.lit(None).cast("int")
    for k in reversed(range(len(LEVELS))):
        level = F.when(F.rlike(lower, F.lit(LEVELS[k][1])), k).otherwise(level)
    return level


def number_of(line: Column) -> Column:
    lower = F.lower(F.trim(line))
    return F.coalesce(*[F.nullif(F.regexp_extract(lower, p, 1), F.lit("")) for _, p in LEVELS])


def build_structure(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, node, parent, node_type, number, text): a node for each line that opens one, with the lines up to the next.

    A node's parent is the nearest node before it of an outer level, or null under the document itself. Lines before the
    first node form node 0 of type preamble. Everything is windows over one document's lines.
    """
    w = Window.partitionBy(doc).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_level", level_of(F.col(text))).withColumn("_node", F.sum(F.when(F.col("_level").isNotNull(), 1).otherwise(0)).over(so_far))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("_level") == k, F.col("_node"))).over(before) for k in range(len(LEVELS) - 1)]
    outer = F.lit(None).cast("long")
    for k in range(1, len(LEVELS)):
        found = F.greatest(*last[:k]) if k > 1 else last[0]
        outer = F.when(F.col("_level") == k, found).otherwise(outer)
    rows = rows.withColumn("_parent", outer).withColumn("_number", F.when(F.col("_level").isNotNull(), number_of(F.col(text))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    nodes = rows.groupBy(doc, F.col("_node").alias("node")).agg(F.max("_parent").alias("parent"), F.max("_level").alias("_l"), F.max("_number").alias("number"), body.alias("text"))
    names = F.array(*[F.lit(n) for n, _ in LEVELS])
    return nodes.select(doc, "node", "parent", F.coalesce(F.try_element_at(names, F.col("_l") + 1), F.lit("preamble")).alias("node_type"), "number", "text")


def section_chunks(nodes: DataFrame, doc: str, least: int = 40, target: int = 180, most: int = 260) -> DataFrame:
    """(key, piece, chunk): chunks that stay within a node; key is document and node."""
    keyed = nodes.select(F.concat_ws("#", F.col(doc).cast("string"), F.col("node").cast("string")).alias("key"), "text")
    return packed_segments(keyed, "key", "text", least, target, most)


def merge_small(blocks: DataFrame, doc: str, order: str, text: str, shape: Column, least: int) -> DataFrame:
    """Neighbouring blocks of one shape joined while the block before is short: a block starts anew where the shape changes or the last was long."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = blocks.withColumn("_shape", shape)
    new = F.when(F.col("_shape").eqNullSafe(F.lag("_shape").over(w)) & (F.length(F.lag(text).over(w)) < least), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return rows.groupBy(doc, "block").agg(merged.alias(text))

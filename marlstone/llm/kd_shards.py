"""Shards by a k-d tree: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dense_rank, global_order

SHARDS = 8
#: Metadata by which documents are split; on equal widths the one that varies more is taken, then the first.
DIMENSIONS = ("source", "lang", "size", "doc_id")
#: Bins of each histogram by which a median is narrowed down, and the share of a shard's bytes at which that ends.
BINS, NEAR = 4096, 1e-4
#: Bits of a code that part ties, and how many of them part equal rows.
_BITS, _REPEATS = 31, 11


@dataclass
class Node:
    """``leaves`` shards from ``first`` on; below ``at`` on ``dim`` is the left child's."""

    first: int
    leaves: int
    dim: str = ""
    at: int = 0
    children: list[Node] = field(default_factory=list)


def coordinates(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and, for each dimension, a code of 62 bits: the scaled value, then a hash that parts ties.

    Nulls come first on every dimension. Rows equal in doc_id and text have nearly equal codes, so a cut may fall among them.
    """
    text = F.coalesce("text", F.lit(""))
    name = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)).cast("double")
    raw = {"source": name("source"), "lang": name("lang"), "size": F.log2(F.octet_length(text) + 1.0), "doc_id": F.col("doc_id").cast("double")}
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), (F.pmod(F.xxhash64(text, "doc_id"), F.lit(1 << _BITS - _REPEATS)) * (1 << _REPEATS) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << _REPEATS))).alias("_tie"), *[raw[d].alias(f"_{d}") for d in DIMENSIONS])
    rows = cut(rows)
    span = rows.agg(*[f(f"_{d}").alias(f"{w}_{d}") for d in DIMENSIONS for w, f in (("lo", F.min), ("hi", F.max))]).first()
    codes = []
    for d in DIMENSIONS:
        lo, hi = span[f"lo_{d}"] or 0.0, span[f"hi_{d}"] or 0.0
        scaled = F.floor((F.col(f"_{d}") - lo) / ((hi - lo) or 1.0) * ((1 << _BITS) - 2)).cast("long") + 1
        codes.append((F.coalesce(scaled, F.lit(0)) * (1 << _BITS) + F.col("_tie")).alias(f"_{d}"))
    return rows.select("doc_id", "size", "text_crc32", "_tie", *codes)


def _joined(rows: DataFrame, table: list[tuple], columns: str) -> DataFrame:
    """``rows`` with what ``table`` says of their node: a row for each open node, which every task holds."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, f"_leaf int, {columns}")), "_leaf")


def _code(dim: str = "_dim") -> Column:
    return F.element_at(F.array(*[F.col(f"_{d}") for d in DIMENSIONS]), F.col(dim) + 1)


def grow(rows: DataFrame, leaves: int) -> tuple[Node, DataFrame]:
    """The tree for ``coordinates``, and the rows with ``_leaf``, their shard.

    All nodes of a level are split in the same passes. Histograms stay with the tasks: a window over a node's bins finds the
    one in which its median lies, and one row a node reaches the driver. Rows learn their node by a join with the level's
    cuts and are cut once a level, so neither a plan nor an expression grows with the number of shards.
    """
    root = Node(0, leaves)
    level, placed = [root], rows.withColumn("_leaf", F.lit(0))
    while todo := [n for n in level if n.leaves > 1]:
        spans = [f(f"_{d}").alias(f"{w}_{d}") for d in DIMENSIONS for w, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop))]
        stats = {r["_leaf"]: r for r in placed.groupBy("_leaf").agg(F.sum("size").alias("bytes"), *spans).collect()}  # a row for each node
        seek = {}
        for n in todo:
            r = stats.get(n.first)
            n.dim = max(DIMENSIONS, key=lambda d: ((r[f"hi_{d}"] >> _BITS) - (r[f"lo_{d}"] >> _BITS), r[f"sd_{d}"])) if r else DIMENSIONS[0]
            n.at = 0
            if r:
                seek[n.first] = [n, r[f"lo_{n.dim}"], r[f"hi_{n.dim}"] + 1, 0, r["bytes"] * (n.leaves // 2) / n.leaves, NEAR * r["bytes"] / n.leaves]
        while seek:
            table = [(k, DIMENSIONS.index(n.dim), a, max(1, -(-(b - a) // BINS)), below, float(goal)) for k, (n, a, b, below, goal, _) in seek.items()]
            bins = _joined(placed.select("_leaf", "size", *[f"_{d}" for d in DIMENSIONS]), table, "_dim int, _lo long, _w long, _below long, _goal double")
            bins = bins.withColumn("_c", _code()).withColumn("_bin", F.expr("CASE WHEN _c >= _lo THEN (_c - _lo) div _w END"))
            bins = bins.where(F.col("_bin") < BINS).groupBy("_leaf", "_bin").agg(F.sum("size").alias("bytes"), F.min("_c").alias("_from"), F.max("_c").alias("_to"), F.first("_below").alias("_below"), F.first("_goal").alias("_goal"))
            upto = F.col("_below") + F.sum("bytes").over(Window.partitionBy("_leaf").orderBy("_bin"))
            met = bins.withColumn("_upto", upto).groupBy("_leaf").agg(F.min(F.when(F.col("_upto") >= F.col("_goal"), F.struct("_bin", "bytes", "_upto", "_from", "_to"))).alias("b"), F.max("_upto").alias("all"))
            found = {r["_leaf"]: r for r in met.collect()}  # a row for each node
            for k, (n, a, b, below, goal, near) in list(seek.items()):
                w = max(1, -(-(b - a) // BINS))
                hit = found[k]["b"] if k in found else None
                i, bytes_, before = (hit["_bin"], hit["bytes"], hit["_upto"] - hit["bytes"]) if hit else (BINS, 0, found[k]["all"] if k in found else below)
                if w == 1 or bytes_ <= near:  # cut before or after the bin, whichever is nearer
                    n.at = a + (i + (2 * (goal - before) >= bytes_)) * w
                    del seek[k]
                else:
                    seek[k] = [n, hit["_from"], hit["_to"] + 1, before, goal, near]  # no wider than what the bin holds
        cuts = [(n.first, DIMENSIONS.index(n.dim), n.at, n.first + n.leaves // 2) for n in todo]
        done = placed.join(F.broadcast(placed.sparkSession.createDataFrame([(n.first,) for n in todo], "_leaf int")), "_leaf", "left_anti")
        split = _joined(placed, cuts, "_dim int, _at long, _right int")
        split = split.withColumn("_leaf", F.when(_code() < F.col("_at"), F.col("_leaf")).otherwise(F.col("_right"))).drop("_dim", "_at", "_right")
        placed = cut(split.unionByName(done))
        for n in todo:
            half = n.leaves // 2
            n.children = [Node(n.first, half), Node(n.first + half, n.leaves - half)]
        level = [c for n in todo for c in n.children]
    return root, placed


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of ``shards``, or of as many as make leaves of ``target_bytes``.

    A cut falls between two documents, so sizes differ by no more than single documents, repeated rows among them. Null text: size 1. Null metadata come first. An empty table
    gives no rows. Slots number a shard's rows by doc_id without gathering a shard anywhere.
    """
    rows = cut(coordinates(docs))
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = grow(rows, shards)[1].select("doc_id", "size", "text_crc32", F.col("_leaf").alias("shard"), "_tie")
    return dense_rank(global_order(placed, ["shard", "doc_id", "_tie", "size"]), ["shard"], "slot").drop("_tie")

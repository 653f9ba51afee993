"""Ancestors in trees of any depth, found by doubling: each round knows twice as much of the way up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of node that state a rule, and those that hang on one.
RULES, ATTACHED = ("clause", "subsection", "section"), ("proviso", "explanation", "table")


def _double(open_: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    """Rows (node, hop, names) that know the way up to ``hop``, with what ``known`` says of the way up from there."""
    ahead = known.select(F.col("node").alias("hop"), F.col("hop").alias("_hop"), *[F.col(n).alias(f"_{n}") for n in names])
    return open_.join(ahead, "hop", "left").select("node", F.col("_hop").alias("hop"), *[F.coalesce(n, f"_{n}").alias(n) for n in names])


def typed_ancestors(nodes: DataFrame, node: str, parent: str, kind: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """(node, a column for each of ``wanted``): for every node the nearest one on its way up whose kind is among those wanted; null if none.

    A round joins what every node knows of its next stretch of the way to what the stretch's end knows, so the stretch
    doubles: a tree of depth d takes log2(d) + 2 rounds. Nodes that know the whole way, or all that is wanted, drop out. A
    parent that isn't a node ends the way; nodes that go round in a circle without finding all that is wanted are refused.
    """
    kinds = nodes.select(F.col(node).alias("hop"), F.col(kind).alias("_kind"))
    first = nodes.select(F.col(node).alias("node"), F.col(parent).alias("hop")).join(kinds, "hop", "left")
    named = [F.when(F.col("_kind").isin(*stops), F.col("hop")).alias(name) for name, stops in wanted.items()]
    known = first.select("node", F.when(F.col("_kind").isNotNull(), F.col("hop")).alias("hop"), *named).checkpoint()
    names, most, stretch = list(wanted), known.count(), 1
    pending = F.col("hop").isNotNull() & ~F.forall(F.array(*names), lambda x: x.isNotNull())
    done, open_ = known.where(~pending), known.where(pending)
    while stretch <= 2 * most and open_.take(1):
        met = _double(open_, known, names).checkpoint()
        settled = met.where(~pending)
        done, open_, stretch = done.unionByName(settled), met.where(pending), 2 * stretch
        known = done.unionByName(open_)
    if open_.take(1):
        raise ValueError("nodes go round in a circle")
    return done.drop("hop")


def ancestor(nodes: DataFrame, node: str, parent: str, kind: str, wanted: str) -> DataFrame:
    """(node, ancestor): the first node of type ``wanted`` on each node's way up, for nodes that have one."""
    return typed_ancestors(nodes, node, parent, kind, {"ancestor": (wanted,)}).where("ancestor IS NOT NULL")


def _parents(node: Column, parent: Column, kind: Column) -> Column:
    by_kind = F.when(kind == "section", node).when(kind == "subsection", F.col("section")).when(kind == "clause", F.coalesce("subsection", "section")).when(kind == "table", F.col("section"))
    return by_kind.when(kind.isin("proviso", "explanation"), F.col("rule")).otherwise(F.when(parent.isNull(), node).when(F.col("_parent_known"), parent))


def governing(nodes: DataFrame, node: str, parent: str, kind: str) -> DataFrame:
    """(node, reasoning_parent, governing_rule) for the nodes of a law.

    The reasoning parent of a section is itself, of a subsection or table its section, of a clause its subsection or else its
    section, of what hangs on a rule that rule, of any other node its parent, or itself without one. The governing rule of
    a proviso, explanation or table is the nearest clause, subsection or section above, of any other node its reasoning parent.
    """
    above = typed_ancestors(nodes, node, parent, kind, {"section": ("section",), "subsection": ("subsection",), "rule": RULES})
    known = nodes.select(F.col(node).alias("_p"), F.lit(True).alias("_parent_known"))
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(kind).alias("kind")).join(above, "node").join(known, F.col("parent") == F.col("_p"), "left").withColumn("_parent_known", F.coalesce("_parent_known", F.lit(False)))
    reasoning = _parents(F.col("node"), F.col("parent"), F.col("kind"))
    rows = rows.withColumn("reasoning_parent", reasoning)
    return rows.select("node", "reasoning_parent", F.when(F.col("kind").isin(*ATTACHED), F.col("rule")).otherwise(F.col("reasoning_parent")).alias("governing_rule"))

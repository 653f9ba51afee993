"""A Merkle manifest of a dataset: a hash tree for each source under one root, with proofs that replaced rows are folded through.

A parent keeps a copy of its running SHA-256 before each child's slot. Folding a replaced child takes the copy at its slot and
hashes on: the replacement and the siblings to its right, never those to its left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, dense_rank, global_order, whole_groups

#: Children of a parent, and levels that are hashed within one task: a task's group of nodes has ARITY ** LEVELS at most.
ARITY, LEVELS = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: dict[str, Column | str] | None = None) -> Column:
    """The hash of a row's fields: a dash for null, else the number of bytes, a colon and the value. ``columns`` stand in for fields of their name."""

    def part(c: Column | str) -> Column:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[part((columns or {}).get(f, f)) for f in FIELDS]).cast("binary"), 256)


class Parent:
    """The hash of up to ARITY children, given as hex digits, with a copied state before each slot."""

    def __init__(self, children: list[bytes]):
        state, self.states, self.children = sha256(), [], children
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The hash with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(child)
        for right in self.children[slot + 1 :]:
            state.update(right)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])


def grow(nodes: list[bytes], whole: bool, most: int) -> list[list[Parent]]:
    """Parents level by level: up to a single node if ``nodes`` are a ``whole`` tree, else ``most`` levels of a part of one."""
    levels: list[list[Parent]] = []
    while len(nodes) > 1 if whole else len(levels) < most:
        levels.append([Parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [p.digest for p in levels[-1]]
    return levels


def path(levels: list[list[Parent]], at: int) -> Iterator[tuple[Parent, int]]:
    for parents in levels:
        at, slot = divmod(at, ARITY)
        yield parents[at], slot


def _tops(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The node that stands above each group, for the tier of the groups' parents."""
        for rows in whole_groups(batches, "_group"):
            out = []
            for (tree, part), group in rows.groupby(["_tree", "_part"], sort=False):
                nodes = [h.encode() for h in group["_hash"]]
                levels = grow(nodes, bool(group["_whole"].iloc[0]), most)
                out.append((tree, part, (levels[-1][0].digest if levels else nodes[0]).decode()))
            yield pd.DataFrame(out, columns=["_tree", "_pos", "_hash"])

    return run


def _own_paths(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each node the siblings to its left and right on each level of its group."""
        for rows in whole_groups(batches, "_group"):
            for (tree, _), group in rows.groupby(["_tree", "_part"], sort=False):
                levels = grow([h.encode() for h in group["_hash"]], bool(group["_whole"].iloc[0]), most)
                for k in range(0, len(group), 4096):
                    steps = [[[b"".join(p.children[:s]).decode(), b"".join(p.children[s + 1 :]).decode()] for p, s in path(levels, at)] for at in range(k, min(k + 4096, len(group)))]
                    yield pd.DataFrame({"_tree": tree, "_pos": group["_pos"].to_numpy()[k : k + 4096], "_part": group["_part"].to_numpy()[k : k + 4096], "_path": steps})

    return run


_PATH = "array<array<string>>"


def _grouped(nodes: DataFrame, most: int) -> DataFrame:
    """(_tree, _pos, _hash) with _part, whether that is the whole tree, and rows of a group together, in order."""
    width = ARITY**most
    parted = nodes.withColumn("_part", F.floor(F.col("_pos") / width).cast("long"))
    many = nodes.where(F.col("_pos") >= width).select(F.col("_tree").alias("_large")).distinct()
    marked = parted.join(many, F.col("_tree") == F.col("_large"), "left").withColumn("_whole", F.col("_large").isNull()).drop("_large")
    return marked.withColumn("_group", F.xxhash64("_tree", "_part"))


def _in_groups(grouped: DataFrame) -> DataFrame:
    return grouped.repartition("_group").sortWithinPartitions("_group", "_tree", "_part", "_pos")


def _climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """For nodes (_tree, _pos, _hash): the root of each tree (_tree, _hash), and each node's path to it (_tree, _pos, _path).

    Tier by tier: a tier's groups give the nodes of the next, ARITY ** LEVELS times fewer.
    """
    tiers = []
    while nodes.where("_pos > 0").take(1):
        tiers.append(cut(_grouped(nodes, most)))
        nodes = cut(_in_groups(tiers[-1]).mapInPandas(_tops(most), "_tree string, _pos long, _hash string"))
    above = nodes.select("_tree", "_pos", F.array().cast(_PATH).alias("_path"))
    for tier in reversed(tiers):
        own = _in_groups(tier).mapInPandas(_own_paths(most), f"_tree string, _pos long, _part long, _path {_PATH}")
        above = cut(own.join(above.select("_tree", F.col("_pos").alias("_part"), F.col("_path").alias("_rest")), ["_tree", "_part"]).select("_tree", "_pos", F.concat("_path", "_rest").alias("_path")))
    return nodes.select("_tree", "_hash"), above


@dataclass
class Manifest:
    """``leaves``: (doc_id, claim, _tree, _part, _pos, _hash, _whole, _group) of every row; ``groups``: (_group, _tree, _part, _path, subroot, root), what stands above each group of leaves."""

    leaves: DataFrame
    groups: DataFrame
    levels: int

    def root(self) -> str | None:
        """The hash of the dataset; none for an empty one."""
        row = self.groups.select("root").first()
        return row and row[0]

    def subroots(self) -> DataFrame:
        """(source, subroot) for every source."""
        return self.groups.groupBy("_tree").agg(F.max("subroot").alias("subroot")).select(F.when(F.col("_tree") != "0", F.substr("_tree", F.lit(2))).alias("source"), "subroot")

    def fold(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's claim folded to a root with the manifest's siblings."""
        heads = self.groups.select("_group", "_tree", "_part", F.lit(-1).cast("long").alias("_pos"), F.lit(True).alias("_null"), F.lit(0).cast("long").alias("_id"), "subroot", "root", F.lit(True).alias("_whole"), "_path")
        # A null would turn the identifiers of its batch into floating-point numbers.
        rows = self.leaves.select("_group", "_tree", "_part", "_pos", F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("_hash").alias("subroot"), F.col("claim").alias("root"), "_whole", F.lit(None).cast(_PATH).alias("_path"))
        folded = _in_groups(heads.unionByName(rows)).mapInPandas(_fold(self.levels), "_null boolean, _id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
        return folded.select(F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _fold(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups of a head (path, subroot and root) and its leaves (in ``subroot`` the hash, in ``root`` the claim)."""
        for rows in whole_groups(batches, "_group"):
            for _, group in rows.groupby(["_tree", "_part"], sort=False):
                head, own = group.iloc[0], group.iloc[1:]
                levels = grow([h.encode() for h in own["subroot"]], bool(own["_whole"].iloc[0]), most)
                # Above the group: the state before its slot, what follows it, and both siblings for proofs.
                above = [(sha256(left.encode()), right.encode(), (left + right).encode()) for left, right in head["_path"]]
                proofs, folded = [], []
                for at, claim in enumerate(own["root"]):
                    proof, value = sha256(), claim.encode()
                    for parent, slot in path(levels, at):
                        proof.update(parent.siblings(slot))
                        value = parent.fold(slot, value)
                    for state, right, both in above:
                        proof.update(both)
                        state = state.copy()
                        state.update(value + right)
                        value = state.hexdigest().encode()
                    proofs.append(proof.hexdigest())
                    folded.append(value.decode())
                yield pd.DataFrame({"_null": own["_null"], "_id": own["_id"], "leaf": own["subroot"], "subroot": head["subroot"], "root": head["root"], "proof_sha256": proofs, "folded_root": folded})

    return run


def manifest(docs: DataFrame, claim: Column | None = None, levels: int = LEVELS) -> Manifest:
    """Hashes every row of ``docs`` into the tree of its source, and the sources' roots into one.

    ``claim``: a leaf hash of a row as somebody else has it, which ``Manifest.fold`` checks; without one the row's own.
    Leaves ascend by doc_id, null first, ties by their hash; equal rows are leaves each. Sources ascend bytewise, the null
    source first. Null fields are hashed as such, long texts whole; columns other than FIELDS aren't hashed. An empty
    table has neither leaves nor a root. Texts don't leave their task: what is ordered and moved are hashes.
    """
    bound_batches(docs.sparkSession)
    own = leaf()
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("_tree"), own.alias("_hash"), (own if claim is None else claim).alias("claim"), F.monotonically_increasing_id().alias("_at"))
    order = ["_tree", F.asc_nulls_first("doc_id"), "_hash", "_at"]
    leaves = cut(_grouped(dense_rank(global_order(rows, order), ["_tree"], "_pos").select("doc_id", "claim", "_tree", F.col("_pos").cast("long").alias("_pos"), "_hash"), levels))
    tops = cut(_in_groups(leaves.drop("doc_id", "claim")).mapInPandas(_tops(levels), "_tree string, _pos long, _hash string"))
    subroots, paths = _climb(tops, levels)
    subroots = cut(subroots)
    ranked = dense_rank(global_order(subroots.withColumn("_all", F.lit("")), ["_tree"]), ["_all"], "_pos")
    ranked = cut(ranked.select(F.col("_all").alias("_tree"), F.col("_pos").cast("long").alias("_pos"), "_hash", F.col("_tree").alias("_source")))
    top, ends = _climb(ranked.drop("_source"), levels)
    root = F.broadcast(top.select(F.col("_hash").alias("root")))  # one row
    last = ranked.join(ends, ["_tree", "_pos"]).crossJoin(root).select(F.col("_source").alias("_tree"), F.col("_hash").alias("subroot"), F.col("_path").alias("_end"), "root")
    groups = paths.join(last, "_tree").select("_tree", F.col("_pos").alias("_part"), F.concat("_path", "_end").alias("_path"), "subroot", "root")
    return Manifest(leaves, cut(groups.withColumn("_group", F.xxhash64("_tree", "_part"))), levels)


def without_newlines() -> Column:
    """The leaf of a row whose crc32 of the decimal doc_id is even as it is once its text has lost its line ends, else its own."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), leaf({"text": F.replace("text", F.lit("\n"), F.lit(""))})).otherwise(leaf())

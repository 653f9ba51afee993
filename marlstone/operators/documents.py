"""Passages and document graphs: near-duplicates, chunking, hierarchy, conflicts, support."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set, tokens, windows
from .lineage import ancestor  # noqa: F401 - part of this module too

#: Bytes of the claims that a task holds at once.
CLAIM_BYTES = 8 << 20
#: Bits of the sketch of a token set, and counters by which tokens are ordered from rare to common.
SKETCH, COUNTERS = 512, 1 << 18


def overlapping(docs: DataFrame, key: str, group: str, text: str, least: float = 0.82) -> DataFrame:
    """(group, a, b, overlap): pairs of different token sets of one group whose Jaccard is ``least`` or more; a < b.

    Equal sets are one, named by the smallest key. Sets that overlap so much share one of the rarest tokens of each, so
    only those prefixes are joined. Two that meet pass on only if their sizes, the place of the token they share and the
    parities of their tokens (``SKETCH`` bits a set) leave room for the share: bounds that no pair above it fails. So few
    others are written or moved, and the sets themselves go to the pairs that are left.
    """
    spark = docs.sparkSession
    hashed = F.sort_array(F.array_distinct(F.transform(tokens(text), lambda w: F.xxhash64(w))))
    read = docs.select(key, group, F.explode(F.array(hashed)).alias("_t")).where(F.size("_t") > 0)  # a generator's column is computed once
    sets = read.groupBy(group, "_t").agg(F.min(key).alias(key)).checkpoint()  # tokens as numbers
    counts = sets.select(F.explode("_t").alias("_w")).groupBy(F.pmod("_w", F.lit(COUNTERS)).cast("int").alias("_c")).agg(F.count("*").alias("_n")).toArrow()
    often = np.zeros(COUNTERS, dtype=np.int64)  # orders tokens, so it steers cost only
    often[counts["_c"].to_numpy()] = counts["_n"].to_numpy()
    held = spark.sparkContext.broadcast(often.astype(np.int32 if often.max(initial=0) < 1 << 31 else np.int64))
    kind = dict(docs.dtypes)[key]
    sketch = [f"_s{i}" for i in range(SKETCH // 64)]
    rows = sets.select(F.col(key).alias("_key"), F.xxhash64(F.lit(7), group).alias("_g"), "_t")
    prefix = rows.mapInArrow(lambda batches: _prefixes(batches, held.value, least), f"_key {kind}, _w long, _size int, _at int, {', '.join(f'{c} long' for c in sketch)}").repartition("_w")  # moved once for both sides
    a, b = (prefix.select("_w", *[F.col(c).alias(side + c) for c in prefix.columns if c != "_w"]) for side in "ab")
    size = F.col("a_size") + F.col("b_size")
    reaches = lambda both: both / (size - both) >= least
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in sketch])
    room = reaches(F.least("a_size", "b_size")) & reaches(F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))) & reaches(F.shiftright(size - apart, 1))
    met = a.join(b, "_w").where((F.col("a_key") < F.col("b_key")) & room).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()
    left, right = sets.select(group, F.col(key).alias("a"), F.col("_t").alias("_x")), sets.select(group, F.col(key).alias("b"), F.col("_t").alias("_y"))
    full = met.join(left, "a").join(right, [group, "b"])
    both = F.size(F.array_intersect("_x", "_y"))
    return full.withColumn("overlap", both / (F.size("_x") + F.size("_y") - both)).where(F.col("overlap") >= least).select(group, "a", "b", "overlap")


def _prefixes(batches: Iterator[pa.RecordBatch], often: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """For each set of tokens (sorted numbers) its rarest ones, as many as a set of ``least`` in common must share one of, with their places and the set's sketch.

    A sketch's bit is the parity of the tokens that fall on it: sets that differ in d tokens differ in at most d bits.
    """
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            lists = batch.column("_t")
            size = np.asarray(lists.value_lengths())
            token, of = np.asarray(lists.flatten()), np.repeat(np.arange(len(size)), size)
            bits = np.zeros(len(size) * SKETCH, dtype=np.uint8)
            fell = np.bincount(of * SKETCH + (token.view(np.uint64) >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=len(bits))
            words = np.packbits((fell & 1).astype(np.uint8)).view(np.int64).reshape(len(size), -1)
            token = token[np.lexsort((token, often[token % len(often)], of))]
            at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            few = size - np.ceil(size * least - 1e-9).astype(np.int64) + 1
            kept = at < few[of]
            own = of[kept]
            mixed = token[kept] ^ np.asarray(batch.column("_g"))[own]  # tokens of one group only meet
            columns = [batch.column("_key").take(pa.array(own)), mixed, size[own].astype(np.int32), at[kept].astype(np.int32), *words[own].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["_key", "_w", "_size", "_at", *(f"_s{i}" for i in range(SKETCH // 64))])


def copies(docs: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(group, key, representative): each document whose token set another of its group with a smaller key has; the smallest key stands for all in ``overlapping``.

    Sets are compared by a SHA-256 of their sorted tokens, so texts are read once and not moved.
    """
    named = F.sha2(F.array_join(F.sort_array(F.array_distinct(F.col("_t"))), " "), 256)
    read = docs.select(key, group, F.explode(F.array(tokens(text))).alias("_t")).where(F.size("_t") > 0)
    sets = read.select(key, group, F.unhex(named).alias("_t")).checkpoint()
    first = sets.groupBy(group, "_t").agg(F.min(key).alias("representative"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return sets.join(first, [group, "_t"]).where(F.col(key) != F.col("representative")).select(group, key, "representative")


def keep_first(docs: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key): documents dropped because an earlier kept one of their group is near. A copy is near whatever its representative is near, so it's always dropped."""
    near = greedy_keep(overlapping(docs, key, group, text)).select(F.col("node").alias(key))
    return near.unionByName(copies(docs, key, group, text).select(key))


def greedy_keep(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node): nodes of ``pairs`` (a before b) dropped because an earlier *kept* one is near.

    Each round settles the nodes whose earlier neighbours are all settled; chains settle one link a round.
    """
    links = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().checkpoint()
    state = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean"))
    before = None
    while True:
        seen = links.join(state.select(F.col("node").alias("a"), F.col("kept").alias("_k")), "a").groupBy(F.col("b").alias("node")).agg(F.bool_or(F.coalesce("_k", F.lit(False))).alias("_near"), F.bool_or(F.col("_k").isNull()).alias("_open"))
        decided = F.when(F.col("_near"), False).when(F.coalesce("_open", F.lit(False)), None).otherwise(True)
        state = state.join(seen, "node", "left").select("node", F.coalesce("kept", decided).alias("kept")).checkpoint()
        left = state.where("kept IS NULL").count()
        if not left:
            break
        if left == before:
            raise ValueError("pairs go round in a circle: a isn't before b in all of them")
        before = left
    return state.where("NOT kept").select("node")


def fixed_windows(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 120) -> DataFrame:
    """(key, piece, chunk): fixed windows of whole texts, stripped, empty ones left out."""
    return docs.where(F.length(text) > 0).select(key, F.inline(windows(F.col(text), size, overlap))).where("chunk <> ''")


def token_windows(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, piece, chunk): runs of ``size`` white-space tokens."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = docs.select(key, words.alias("_w")).where(F.size("_w") > 0)
    starts = F.posexplode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size)))
    return rows.select(key, "_w", starts.alias("piece", "_s")).select(key, "piece", F.array_join(F.slice("_w", F.col("_s") + 1, F.lit(size)), " ").alias("chunk"))


def packed_segments(docs: DataFrame, key: str, text: str, least: int, target: int, most: int) -> DataFrame:
    """(key, piece, chunk): a document's lines packed in order to about ``target`` words, ``most`` at the most; a tail under ``least`` joins the piece before.

    A fold in the order of lines, so it runs in Python within a document; documents are independent.
    """

    def pack(lines: list[str]) -> list[str]:
        units = [" ".join(w[i : i + most]) for line in lines if (w := line.split()) for i in range(0, len(w), most)]
        out, own, n = [], [], 0
        for unit in units:
            size = len(unit.split())
            if own and (n + size > most or n >= target):
                out.append(" ".join(own))
                own, n = [], 0
            own.append(unit)
            n += size
        if own:
            tail = " ".join(own)
            if out and n < least and len(out[-1].split()) + n <= most:
                out[-1] += " " + tail
            else:
                out.append(tail)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text], strict=True) for i, c in enumerate(pack((t or "").split("\n")))]
            yield pd.DataFrame(rows, columns=[key, "piece", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, piece int, chunk string")


def carried_heading(lines: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """``lines`` with the last heading at or before each line of its document."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(w))


def parent_links(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(source, target, relation): each node to its parent."""
    return nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("source"), F.col(parent).alias("target"), F.lit("PARENT_CONTEXT").alias("relation"))


def sibling_links(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(source, target, relation): each node to the next of its parent, by key; a chain of n - 1 links connects n siblings."""
    w = Window.partitionBy(parent).orderBy(node)
    return nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("source"), F.lead(node).over(w).alias("target"), F.lit("SIBLING_CONTEXT").alias("relation")).where("target IS NOT NULL")


def claim_support(claims: DataFrame, claim: str, claim_text: str, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(claim, best_doc, support): the document with the largest share of the claim's tokens; ties to the smallest key, null last.

    Blocks of claims, of a bounded size, meet slices of the documents in tasks. A task counts what each document shares with
    the block's claims and passes on one best document a claim, so neither pairs nor claims ever gather. Claims without
    tokens, or of which no document has any, have no row. Documents are tokenized once and moved once a block of claims.
    """
    spark = docs.sparkSession
    kinds = dict(claims.dtypes)[claim], dict(docs.dtypes)[key]
    nothing = [F.lit(None).cast(k) for k in kinds]
    asked = claims.select(F.col(claim).alias("_claim"), token_set(claim_text).alias("_t")).where(F.size("_t") > 0)
    blocks = max(1, -(-(asked.agg(F.sum(F.length(F.array_join("_t", " ")) + 16)).first()[0] or 0) // CLAIM_BYTES))
    slices = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    held = docs.select(F.col(key).alias("_key"), F.explode(F.array(token_set(text))).alias("_t")).where(F.size("_t") > 0)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heads = asked.select(F.pmod(F.xxhash64("_claim"), F.lit(blocks)).cast("int").alias("_block"), every(slices).alias("_slice"), F.lit(0).alias("_kind"), "_claim", nothing[1].alias("_key"), "_t")
    rows = held.select(every(blocks).alias("_block"), F.pmod(F.xxhash64("_key", F.size("_t")), F.lit(slices)).cast("int").alias("_slice"), F.lit(1).alias("_kind"), nothing[0].alias("_claim"), "_key", "_t")
    dealt = heads.unionByName(rows).repartition(blocks * slices, "_block", "_slice").sortWithinPartitions("_block", "_slice", "_kind")
    found = dealt.mapInArrow(_most_shared, f"claim {kinds[0]}, doc {kinds[1]}, shared int, asked int")
    best = found.groupBy("claim").agg(F.min_by(F.struct("doc", "shared", "asked"), F.struct((-F.col("shared")).alias("s"), F.col("doc").isNull().alias("n"), "doc")).alias("_b"))
    return best.select(F.col("claim").alias(claim), F.col("_b.doc").alias("best_doc"), F.round(F.col("_b.shared") / F.col("_b.asked"), 6).alias("support"))


class _Claims:
    """A block's claims by their tokens, and the document that shares most with each so far."""

    def __init__(self):
        self.names: list = []
        self.words: list[list[int]] = []
        self.number: dict[str, int] = {}
        self.of = None

    def add(self, name, words: list[str]) -> None:
        self.names.append(name)
        self.words.append([self.number.setdefault(t, len(self.number)) for t in words])

    def meet(self, doc, words: list[str]) -> None:
        if self.of is None:
            token = np.concatenate([np.array(w) for w in self.words])
            self.of = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])[np.argsort(token, kind="stable")]
            self.starts = np.r_[0, np.cumsum(np.bincount(token, minlength=len(self.number)))]
            self.most, self.best = np.zeros(len(self.words), dtype=np.int64), [None] * len(self.words)
        met = [self.number[t] for t in words if t in self.number]
        if met:
            shared = np.bincount(np.concatenate([self.of[self.starts[k] : self.starts[k + 1]] for k in met]), minlength=len(self.words))
            for i in np.flatnonzero((shared >= self.most) & (shared > 0)).tolist():
                if shared[i] > self.most[i] or doc is not None and (self.best[i] is None or doc < self.best[i]):
                    self.most[i], self.best[i] = shared[i], doc

    def found(self) -> list[tuple]:
        some = [] if self.of is None else np.flatnonzero(self.most).tolist()
        return [(self.names[i], self.best[i], int(self.most[i]), len(self.words[i])) for i in some]


def _most_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and slice, claims before documents, to one best document of each claim."""
    own, at, schema = _Claims(), None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*own.found(), strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        schema = pa.schema([("claim", batch.schema.field("_claim").type), ("doc", batch.schema.field("_key").type), ("shared", pa.int32()), ("asked", pa.int32())])
        for block, slice_, kind, claim, key, words in zip(*(batch.column(c).to_pylist() for c in ("_block", "_slice", "_kind", "_claim", "_key", "_t")), strict=True):
            if (block, slice_) != at:
                if own.found():
                    yield out()
                own, at = _Claims(), (block, slice_)
            if kind == 0:
                own.add(claim, words)
            elif own.names:
                own.meet(key, words)
    if own.found():
        yield out()


def token_statistics(docs: DataFrame, group: str, text: str) -> DataFrame:
    """(group, n_docs, n_tokens, avg_tokens, avg_distinct)."""
    sized = docs.select(group, tokens(text).alias("_t")).select(group, F.size("_t").alias("n"), F.size(F.array_distinct("_t")).alias("d"))
    return sized.groupBy(group).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 4).alias("avg_tokens"), F.round(F.avg("d"), 4).alias("avg_distinct"))

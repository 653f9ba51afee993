"""Exact top-k by inner product: scores of all pairs in blocks, and global histograms that close in on each query's kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, global_order, partitions

#: Components are numbered in steps of 1 / SCALE.
SCALE = 256
#: Bins of a histogram; a round divides the range in which a query's kth score lies by it.
BINS = 512
#: Vectors of a block of candidates and of queries, and the bytes of a block of long vectors.
BLOCK, QUERIES, BYTES = 2048, 1024, 8 << 20
#: Blocks that one task compares with a block of queries at most.
RUN = 1024
#: Scores are held to this, so that ranges of bins fit a long.
LIMIT = 1 << 61


def usable(vector: str) -> Column:
    """Not null and without null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def _blocks(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (_mid, _vector) in the order of _mid to blocks of one length of vector: numbers and whole components as bytes."""
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(length: int) -> pd.DataFrame:
            parts = held.pop(length)
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pd.DataFrame({"_length": [length], "_n": [len(ids)], "_ids": [ids.tobytes()], "_x": [x.tobytes()], "_top": [float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))]})

        for batch in batches:
            for length, part in batch.groupby(batch["_vector"].map(len), sort=True):
                size = max(1, min(most, BYTES // (8 * max(1, length))))
                for k in range(0, len(part), size):
                    own = part.iloc[k : k + size]
                    x = np.floor(np.stack(own["_vector"].to_numpy()).astype(np.float64) * SCALE).reshape(len(own), -1)
                    held.setdefault(length, []).append((own["_mid"].to_numpy(), x))
                    if sum(len(p[0]) for p in held[length]) >= size:
                        yield block(length)
        for length in list(held):
            yield block(length)

    return run


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact whatever their size; held to LIMIT."""
    bound = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * max(1, q.shape[1])
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)
    exact = whole(q) @ whole(c).T
    return np.array([[min(max(int(v), -LIMIT), LIMIT) for v in r] for r in exact.tolist()], dtype=np.int64).reshape(len(q), len(c))


class _Queries:
    """A block of queries and what is known of each: the range from low to before high in which its kth score lies, and how many of its best are still sought there."""

    def __init__(self, row: pd.Series):
        self.number, ids = row["_q"], np.frombuffer(row["_ids"], dtype=np.int64)
        x = np.frombuffer(row["_x"], dtype=np.float64).reshape(len(ids), -1)
        self.at, self.low, self.high, self.need = np.stack(row["_state"]).astype(np.int64).T
        self.step = -(-(self.high - self.low) // BINS)
        self.ids, self.x = ids[self.at], x[self.at]

    def scores(self, row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of a block of candidates, their numbers, and which pairs count: not a query with itself."""
        ids = np.frombuffer(row["_ids"], dtype=np.int64)
        score = products(self.x, np.frombuffer(row["_x"], dtype=np.float64).reshape(len(ids), -1))
        at = np.minimum(np.searchsorted(ids, self.ids), len(ids) - 1)
        counts = np.ones(score.shape, dtype=bool)
        itself = np.flatnonzero(ids[at] == self.ids)
        counts[itself, at[itself]] = False
        return score, ids, counts


def _histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each query the topmost bins of a task's scores that hold as many as are sought: lower ones can't hold the kth score of all."""
    queries, total = None, None

    def tops() -> Iterator[pd.DataFrame]:
        if queries is None:
            return
        down = total[:, ::-1]
        row, back = np.nonzero((down > 0) & (np.cumsum(down, axis=1) - down < queries.need[:, None]))
        low = queries.low[row] + (BINS - 1 - back) * queries.step[row]
        high = np.minimum(low + queries.step[row], queries.high[row])
        yield pd.DataFrame({"_q": np.full(len(row), queries.number), "at": queries.at[row], "low": low, "high": high, "n": down[row, back]})

    for batch in batches:
        for _, row in batch.iterrows():
            if row["_kind"] == 0:
                yield from tops()
                queries = _Queries(row)
                total = np.zeros((len(queries.at), BINS), dtype=np.int64)
            else:
                score, _, counts = queries.scores(row)
                r, c = np.nonzero(counts & (score >= queries.low[:, None]) & (score < queries.high[:, None]))
                place = (score[r, c] - queries.low[r]) // queries.step[r]
                total += np.bincount(r * BINS + place, minlength=total.size).reshape(total.shape)
    yield from tops()


def _winners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs over the query's kth score, and of those that tie with it as many of the smallest numbers as are sought."""
    queries, left = None, None
    for batch in batches:
        for _, row in batch.iterrows():
            if row["_kind"] == 0:
                queries = _Queries(row)
                left = queries.need.copy()
            else:
                score, ids, counts = queries.scores(row)
                tied = counts & (score == queries.low[:, None])
                tied &= np.cumsum(tied, axis=1) <= left[:, None]
                left -= tied.sum(axis=1)
                r, c = np.nonzero((counts & (score > queries.low[:, None])) | tied)
                yield pd.DataFrame({"_mid": queries.ids[r], "_other": ids[c], "score": score[r, c]})


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The Euclidean length of each query of each block."""
    for batch in batches:
        for q, n, x in zip(batch["_q"], batch["_n"], batch["_x"], strict=True):
            x = np.frombuffer(x, dtype=np.float64).reshape(n, -1)
            yield pd.DataFrame({"_q": np.full(n, q), "at": np.arange(n), "_own": np.sqrt((x * x).sum(axis=1))})


def _start(own: Column, most: float, k: int) -> list[Column]:
    """The range of all scores of a query of that length, by Cauchy and Schwarz."""
    bound = F.ceil(F.least(own * F.lit(most) * 1.000001, F.lit(float(LIMIT)))) + 1
    return [(-bound).alias("low"), (bound + 1).alias("high"), F.lit(k).cast("long").alias("need")]


def top_k(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score): for each row that ``queries`` chooses the k rows of largest inner product, itself left out.

    Components are floor(256 * x). Vectors that are null or hold null or non-finite components take no part; only vectors of
    one length meet; empty vectors score 0. Ties go to the smaller key, null keys last; rows of a repeated key are different
    rows, so each of them is a query and each is the others' candidate. Fewer rows are returned where there are fewer. Scores
    beyond plus or minus LIMIT are held to it. No queries or an empty table give no rows; other columns are ignored.

    Nothing that grows with the table is held whole: blocks of queries meet blocks of candidates in tasks, which pass on at
    most k bins or k rows a query. Every round scores all pairs again and divides the range of each kth score by BINS.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    held = vectors.where(usable(vector)).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"), F.coalesce(queries, F.lit(False)).alias("_asks"), F.monotonically_increasing_id().alias("_at"))
    points = global_order(held, [F.asc_nulls_last("_key"), F.col("_at")]).drop("_at")
    layout = "_length int, _n int, _ids binary, _x binary, _top double"
    chosen = points.where("_asks").select("_mid", "_vector")
    asked = chosen.coalesce(max(1, -(-chosen.count() // QUERIES)))
    asked = cut(asked.mapInPandas(_blocks(QUERIES), layout).withColumn("_q", F.monotonically_increasing_id()))
    blocks = cut(points.select("_mid", "_vector").mapInPandas(_blocks(BLOCK), layout).withColumn("_b", F.monotonically_increasing_id()))
    n_asked, (n_blocks, most) = asked.count(), blocks.agg(F.count("*"), F.max("_top")).first()
    groups = max(1, min(n_blocks, max(-(-4 * partitions(spark) // max(1, n_asked)), -(-n_blocks // RUN))))
    asking = asked.groupBy("_length").agg(F.collect_list("_q").alias("_asking"))  # a number for each block of queries
    asking = F.broadcast(asking) if n_asked < 500_000 else asking
    against = blocks.join(asking, "_length").select(F.explode("_asking").alias("_q"), F.pmod(F.xxhash64("_b"), F.lit(groups)).cast("int").alias("_g"), F.lit(1).alias("_kind"), "_b", "_ids", "_x", F.lit(None).cast("array<array<long>>").alias("_state"))

    def scan(known: DataFrame, work, schema: str) -> DataFrame:
        """``work`` over every block of queries, each with the blocks of its length; ``known`` is (_q, at, low, high, need)."""
        state = known.groupBy("_q").agg(F.collect_list(F.array("at", "low", "high", "need")).alias("_state"))  # QUERIES rows at most
        heads = asked.join(state, "_q").select("_q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_b"), "_ids", "_x", "_state")
        rows = heads.unionByName(against.join(state.select("_q"), "_q", "left_semi"))
        rows = rows.repartition(max(1, min(n_asked * groups, 8 * partitions(spark))), "_q", "_g")  # a number: few bytes, but much work
        return rows.sortWithinPartitions("_q", "_g", "_kind", "_b").mapInPandas(work, schema)

    known = cut(asked.select("_q", "_n", "_x").mapInPandas(_lengths, "_q long, at long, _own double").select("_q", "at", *_start(F.col("_own"), float(most or 0.0), k)))
    settled = known.where("false")
    while known.take(1):
        counts = scan(known, _histograms, "_q long, at long, low long, high long, n long").groupBy("_q", "at", "low").agg(F.max("high").alias("high"), F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("_q", "at").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        down = counts.join(known.select("_q", "at", "need"), ["_q", "at"]).withColumn("_above", above).where(F.col("_above") < F.col("need"))
        # The lowest of the bins that the best k reach; if there are fewer than k, the lowest of all.
        last = cut(down.groupBy("_q", "at").agg(F.min(F.struct("low", "high", (F.col("need") - F.col("_above")).alias("need"))).alias("s")).select("_q", "at", "s.*"))
        settled, known = settled.unionByName(last.where("high - low = 1")), last.where("high - low > 1")
    found = scan(settled, _winners, "_mid long, _other long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("_mid").orderBy(F.desc("score"), "_other"))).where(F.col("rank") <= k)
    named = best.join(points.select(F.col("_mid").alias("_other"), F.col("_key").alias(key)), "_other").join(points.where("_asks").select("_mid", F.col("_key").alias("query_id")), "_mid")
    return named.select("query_id", "rank", key, "score")

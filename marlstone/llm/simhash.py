"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, cut, join_weighted, whole_groups

BITS = 64
SEED = 42
SHINGLE = 3
#: Distinct fingerprints from which bit correlations and candidate counts are estimated. They steer the cost, never the result.
ESTIMATE_ROWS = 4096
#: A bucket of more fingerprints is split by the bits outside its key.
HEAVY = 20_000
#: Up to so many fingerprints of a bucket are compared by shifts of the whole batch.
SMALL = 12


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of a text: a bit is set if it is set in more than half of its shingles' XXH64. No words: 0."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only, as wanted
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long (null text: no words, so 0)."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(_fingerprints, "long")(F.col(text)))


def bits_of(sample: np.ndarray) -> np.ndarray:
    return (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)


def bit_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """The columns of ``bits`` in ``m`` partitions of nearly equal size; bits that go together in these rows share a partition."""
    width = bits.shape[1]
    x = bits.astype(np.float32)
    x -= x.mean(axis=0) if len(x) else 0
    norm = np.sqrt((x**2).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    free, ties, groups = np.ones(width, dtype=bool), corr.sum(axis=0), []
    for i in range(m):
        group: list[int] = []
        near = ties.copy()
        while len(group) < width // m + (i < width % m):
            nxt = int(np.argmax(np.where(free, near, -1.0)))
            near = corr[nxt] if not group else near + corr[nxt]
            group.append(nxt)
            free[nxt] = False
            ties -= corr[nxt]
        groups.append(sorted(group))
    return groups


def thresholds(sample: np.ndarray, groups: list[list[int]], n: int, within: int) -> tuple[float, list[int]]:
    """(cost, a threshold for each partition), -1 where a partition isn't probed; the sum of (threshold + 1) is ``within`` + 1.

    If two fingerprints differ in at most ``within`` bits, then in some partition they differ in at most its threshold.
    The cost is that of the probes plus the pairs expected within the threshold, and dynamic programming shares out the sum.
    """
    some = sample[:1500]
    differ = some[:, None] ^ some[None, :]
    pairs = max(1, len(some) * (len(some) - 1))
    costs = []
    for group in groups:
        apart = np.bitwise_count(differ & mask_of(group))
        cost = [0.0]
        for t in range(within + 1):
            probes = sum(comb(len(group), k) for k in range(t + 1))
            blind = probes / 2.0 ** len(group)  # if bits were fair coins
            share = max((np.count_nonzero(apart <= t) - len(some)) / pairs, blind)
            cost.append(n * probes * 1.0 + 0.05 * share * n * n / 2)
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for more in range(within + 2 - used):
                new = (spent + cost[more], [*chosen, more - 1])
                if used + more not in step or new[0] < step[used + more][0]:
                    step[used + more] = new
        best = step
    return best[within + 1]


def mask_of(group: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in group))


def plan_partitions(sample: np.ndarray, n: int, within: int) -> list[tuple[list[int], int]]:
    """The cheapest of 2 to ``within`` + 1 partitions with their thresholds."""
    plans = []
    for m in range(2, within + 2):
        groups = bit_groups(bits_of(sample), m)
        plans.append((*thresholds(sample, groups, n, within), groups))
    _, chosen, groups = min(plans, key=lambda p: p[0])
    return [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]


def _walk(values: np.ndarray, within: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct ``values``, without listing all pairs."""
    left, right = [], []
    rest = values
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= within
            if near.any():
                found = rest[near]
                left += [int(at)] * len(found)
                right += found.tolist()
                front += list(found)
                rest = rest[~near]
    return left, right


def _links(within: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole buckets to links."""

        def solve(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            size = np.repeat(sizes, sizes)
            left, right = [], []
            for d in range(1, min(SMALL, int(sizes.max())) if len(sizes) else 0):
                same = (keys[d:] == keys[:-d]) & (size[d:] <= SMALL)
                x, y = fps[d:][same], fps[:-d][same]
                near = (np.bitwise_count(x ^ y) <= within) & (x != y)
                left.append(x[near])
                right.append(y[near])
            for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                a, b = _walk(np.unique(fps[s : s + n]), within)
                left.append(np.array(a, dtype=np.uint64))
                right.append(np.array(b, dtype=np.uint64))
            none = [np.empty(0, dtype=np.uint64)]
            return pd.DataFrame({"a": np.concatenate(left or none).view(np.int64), "b": np.concatenate(right or none).view(np.int64)})

        for rows in whole_groups(batches, "_key"):
            yield solve(rows["_key"].to_numpy(), rows["_fp"].to_numpy().view(np.uint64))

    return run


def _signatures(parts: list[tuple[list[int], int]]):
    plan = [(mask_of(g), [mask_of(list(c)) for k in range(1, t + 1) for c in combinations(g, k)]) for g, t in parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each partition a row for the bits as they are, and one for each probe within the threshold."""
        for batch in batches:
            fps = batch["_fp"].to_numpy().view(np.uint64)
            for i, (mask, flips) in enumerate(plan):
                own = fps & mask
                for flip in [np.uint64(0), *flips]:
                    yield pd.DataFrame({"_part": np.full(len(fps), i, dtype=np.int32), "_bits": (own ^ flip).view(np.int64), "_fp": fps.view(np.int64)})

    return run


def links(fps: DataFrame, within: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints of column ``_fp`` that differ in at most ``within`` bits, enough to connect all that are linked."""
    n = fps.count()
    sample = np.array([r[0] for r in fps.select("_fp").orderBy(F.xxhash64(F.lit(7), "_fp"), "_fp").limit(ESTIMATE_ROWS).collect()], dtype=np.int64).view(np.uint64)
    parts = plan_partitions(sample, n, within)
    rows = cut(fps.select("_fp").mapInPandas(_signatures(parts), "_part int, _bits long, _fp long")) if max(t for _, t in parts) > 0 else fps.select("_fp").mapInPandas(_signatures(parts), "_part int, _bits long, _fp long")
    heavy = rows.groupBy("_part", "_bits").count().where(F.col("count") > HEAVY).select("_part", "_bits", F.lit(True).alias("_heavy"))
    marked = rows.join(heavy, ["_part", "_bits"], "left")
    # A heavy bucket: at most ``within`` bits differ outside the key, so of ``within`` + 1 slices of the other bits one agrees.
    rest = F.array(*[_slice_key(parts, s, within) for s in range(within + 1)])
    keys = marked.select(F.explode(F.when(F.col("_heavy"), rest).otherwise(F.array(F.xxhash64("_part", "_bits")))).alias("_key"), "_fp")
    placed = keys.repartition("_key").sortWithinPartitions("_key")
    return placed.mapInPandas(_links(within), "a long, b long").distinct()


def _slice_key(parts, s: int, within: int):
    key = F.lit(None).cast("long")
    for i, (group, _) in enumerate(parts):
        others = [b for b in range(BITS) if b not in group][s :: within + 1]
        mask = int(mask_of(others).astype(np.int64)) if others else 0
        key = F.when(F.col("_part") == i, F.xxhash64("_part", "_bits", F.lit(s), F.col("_fp").bitwiseAND(F.lit(mask)))).otherwise(key)
    return key


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", within: int = 3) -> DataFrame:
    """(doc_id, _fp, _root, component_id) for every row of ``docs``; rows whose fingerprints differ in at most ``within`` bits are linked.

    component_id is the smallest doc_id that can be reached, the row's own included; null if all of those are null.
    Null and empty texts have fingerprint 0 and are linked like others; repeated rows are kept; an empty table gives none.
    Rows of one fingerprint are grouped before anything is compared, so copies never become pairs.
    """
    marked = cut(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text").select("doc_id", "_fp"))
    fps = cut(marked.groupBy("_fp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")))
    roots = components(links(fps, within))
    rooted = cut(fps.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_least", "_n", F.coalesce("root", "_fp").alias("_root")))
    ids = cut(rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_many")))
    rooted = cut(join_weighted(rooted.select("_fp", "_root", "_n"), ids, ["_root"], "_many").select("_fp", "_root", "_n", "component_id"))
    return join_weighted(marked, rooted, ["_fp"], "_n").select("doc_id", "_fp", "_root", "component_id")


def hex_fingerprint(fp: str = "_fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

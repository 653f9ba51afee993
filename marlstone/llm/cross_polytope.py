"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, with multiprobe and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_weighted, whole_groups
from .sketches import connected

COSINE = 0.93
#: Hash tables; polytope hashes joined into a bucket; further buckets in which a vector is also put, next best first.
TABLES, JOINED, PROBES, SEED = 6, 2, 2, 20240229
#: Bytes of the sketch that travels with a bucket's members, at most; how far rounding, and in how many standard deviations projection, may move a cosine.
WIDTH, ROUNDING, DEVIATIONS = 128, 0.012, 4.5
#: A bucket or group of more vectors is compared in pairs of slices of about that size, each pair a key of its own.
SLICE = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` times the Hadamard matrix, by butterflies; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray) -> np.ndarray:
    """Rows of small whole numbers with nearly the cosines of ``x``: a byte a component, of longer vectors of WIDTH random projections."""
    x = units(x)
    if x.shape[1] > WIDTH:
        x = x @ np.random.default_rng([SEED, 1, x.shape[1]]).normal(size=(x.shape[1], WIDTH))
    return np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300))).astype(np.int8)


def least_near(cosine: float, width: int) -> float:
    """The cosine of two sketches below which those of their vectors don't reach ``cosine``."""
    return cosine - ROUNDING - (DEVIATIONS * (1 - cosine**2) / width**0.5 if width >= WIDTH else 0.0)


def buckets(x: np.ndarray, tables: int = TABLES, joined: int = JOINED, probes: int = PROBES) -> np.ndarray:
    """For each row of ``x`` (any length but zero) tables x (1 + probes) bucket codes.

    A hash is the signed axis nearest to the vector after three rounds of random signs and Hadamard. A probe replaces
    one of the joined hashes by its second axis; the least loss comes first.
    """
    width = 1 << max(1, int(np.ceil(np.log2(x.shape[1]))))
    unit = np.zeros((len(x), width))
    unit[:, : x.shape[1]] = units(x)
    rng = np.random.default_rng([SEED, x.shape[1]])
    rows, out = np.arange(len(x)), np.empty((len(x), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        axes, loss = [], []
        for _ in range(joined):
            y = unit
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            top = np.argpartition(-np.abs(y), 2, axis=1)[:, :3] if width > 2 else np.argsort(-np.abs(y), axis=1)
            order = np.argsort(-np.abs(np.take_along_axis(y, top, axis=1)), axis=1, kind="stable")
            top = np.take_along_axis(top, order, axis=1)
            size = np.take_along_axis(y, top, axis=1)
            axes.append(2 * top + (size > 0))
            loss.append((size[:, :1] ** 2 - size**2))
        code = np.zeros(len(x), dtype=np.int64)
        for a in axes:
            code = code * 2 * width + a[:, 0]
        out[:, t, 0] = code
        place = [(2 * width) ** (joined - 1 - j) for j in range(joined)]
        other = [(loss[j][:, r], code + (axes[j][:, r] - axes[j][:, 0]) * place[j]) for j in range(joined) for r in range(1, axes[j].shape[1])]
        cost, codes = np.stack([o[0] for o in other], axis=1), np.stack([o[1] for o in other], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")
        for p in range(probes):
            out[:, t, 1 + p] = codes[rows, order[:, min(p, codes.shape[1] - 1)]]
        out[:, t] = out[:, t] * tables + t
    return out.reshape(len(x), -1)


def _vectors(values: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    for _, part in values.groupby(values.map(len), sort=True):
        for k in range(0, len(part), 4096):
            yield part.index[k : k + 4096].to_numpy(), np.stack(part.iloc[k : k + 4096].to_numpy()).astype(np.float64)


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row with the sketch for each different bucket of each vector."""
    for batch in batches:
        batch = batch.reset_index(drop=True)
        for at, x in _vectors(batch["embedding"]):
            code, sketch = np.sort(buckets(x), axis=1), sketches(x)
            new = np.c_[np.ones(len(code), dtype=bool), code[:, 1:] != code[:, :-1]]
            row, _ = np.nonzero(new)
            yield pd.DataFrame({"_space": batch["_space"].to_numpy()[at][row], "_code": code[new], "_fp": batch["_rep"].to_numpy()[at][row], "_sketch": [sketch[i].tobytes() for i in row.tolist()]})


def _near(cosine: float, small: int = 12):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by _key to (a, b): links that connect, within a bucket, those whose sketches are near."""
        for rows in whole_groups(batches, "_key"):
            for width, own in rows.groupby(rows["_sketch"].map(len), sort=False):
                key, fp = own["_key"].to_numpy(), own["_fp"].to_numpy()
                x = np.frombuffer(b"".join(own["_sketch"]), dtype=np.int8).reshape(len(own), width).astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                least = least_near(cosine, width)
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sizes = np.diff(np.r_[starts, len(key)])
                size = np.repeat(sizes, sizes)
                left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
                for d in range(1, min(small, int(sizes.max()))):
                    i = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= small))
                    i = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= least]
                    left.append(i)
                    right.append(i + d)
                for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
                    for k in range(s, s + n, 512):
                        i, j = np.nonzero(np.triu(x[k : min(k + 512, s + n)] @ x[k : s + n].T >= least, 1))
                        left.append(i + k)
                        right.append(j + k)
                root = connected(np.concatenate(left), np.concatenate(right), len(fp))
                linked = fp[root] != fp
                yield pd.DataFrame({"a": fp[root[linked]], "b": fp[linked]}).drop_duplicates()

    return run


def _pairs(x: np.ndarray, cross: bool, part: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one key whose cosine reaches ``cosine``; of a key of two slices only pairs across them."""
    left, right = [], []
    for k in range(0, len(x), 512):
        near = x[k : k + 512] @ x[k:].T >= cosine
        if cross:
            near &= part[k : k + 512, None] != part[None, k:]
        i, j = np.nonzero(np.triu(near, 1))
        left.append(i + k)
        right.append(j + k)
    return np.concatenate(left), np.concatenate(right)


def _verify(cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole keys to (a, b) for edges that connect what is linked, and (a, null, n) for numbers of links."""
        for rows in whole_groups(batches, "_key"):
            a, b, n = [], [], []
            for _, group in rows.groupby("_key", sort=False):
                rep, many = group["_rep"].to_numpy(), group["_many"].to_numpy()
                x = units(np.stack(group["embedding"].to_numpy()).astype(np.float64))
                i, j = _pairs(x, bool(group["_cross"].iloc[0]), group["_part"].to_numpy(), cosine)
                links = np.bincount(i, many[j], len(rep)) + np.bincount(j, many[i], len(rep))
                root = connected(i, j, len(rep))
                moved, some = np.flatnonzero(root != np.arange(len(rep))), np.flatnonzero(links)
                a += [rep[root[moved]], rep[some]]
                b += [rep[moved], np.full(len(some), -1)]
                n += [np.zeros(len(moved), dtype=np.int64), links[some].astype(np.int64)]
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)})

    return run


def _sliced(df: DataFrame, key: str, member: str, count: str) -> DataFrame:
    """``df`` with _key, _part and _cross: keys of up to SLICE rows as they are, larger ones as each pair of slices."""
    parts = F.ceil(F.col(count) / SLICE).cast("int")
    own = F.pmod(F.xxhash64(member), parts).cast("int")
    dealt = df.withColumn("_part", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.xxhash64(key, F.least("_part", "_other"), F.greatest("_part", "_other"))
    return dealt.withColumn("_key", F.when(F.col(count) <= SLICE, F.col(key)).otherwise(pair)).withColumn("_cross", F.col("_part") != F.col("_other"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: rows of one label are linked at cosine ``cosine`` or more.

    Rows that share a bucket and whose sketches are near are candidates: a byte a component, which tells a cosine to about
    0.01, so that what is merely alike doesn't gather. Only numbers and sketches travel to the buckets; each vector travels
    once, to the group that its candidates connect, where pairs are compared exactly, in double precision. So no link is false; the tables, probes and sketches decide how many true ones are found (measured in the
    tests and the README). Null labels and vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing and keep their own vec_id; vectors of different lengths never link. Equal vectors are one point with a
    number, so copies are never compared. Repeated vec_ids count as different rows. An empty table gives no rows.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists("embedding", lambda v: v != 0)
    able = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & nonzero, F.lit(False))
    # Equal vectors of a label have equal hashes, of 96 bits.
    named = vectors.select("vec_id", "embedding", able.alias("_able"), F.xxhash64("label", "embedding").alias("_h"), F.hash("embedding", "label").alias("_g"), F.xxhash64("label", F.size("embedding")).alias("_space"))
    points = named.where("_able").groupBy("_h", "_g").agg(F.count("*").alias("_many"), F.min("vec_id").alias("_least"), F.any_value("_space").alias("_space"), F.any_value("embedding").alias("embedding"))
    points = cut(points.withColumn("_rep", F.monotonically_increasing_id()))
    slots = points.select("_space", "_rep", "embedding").mapInPandas(_slots, "_space long, _code long, _fp long, _sketch binary")
    slots = cut(slots.select(F.xxhash64("_space", "_code").alias("_bucket"), "_fp", "_sketch"))
    heavy = cut(slots.groupBy("_bucket").count().where(F.col("count") > SLICE))
    few = heavy.count() < 500_000  # rows of 16 bytes
    dealt = slots.join(F.broadcast(heavy) if few else heavy, "_bucket", "left").withColumn("count", F.coalesce("count", F.lit(1)))
    dealt = _sliced(dealt, "_bucket", "_fp", "count").select("_key", "_fp", "_sketch")
    met = dealt.repartition("_key").sortWithinPartitions("_key").mapInPandas(_near(cosine), "a long, b long")
    groups = components(met).withColumnsRenamed({"node": "_rep", "root": "_root"})
    groups = groups.join(groups.groupBy("_root").agg(F.count("*").alias("_n")), "_root")
    placed = _sliced(points.select("_rep", "_many", "embedding").join(groups, "_rep"), "_root", "_rep", "_n").select("_key", "_rep", "_many", "_part", "_cross", "embedding")
    met = cut(placed.repartition("_key").sortWithinPartitions("_key").mapInPandas(_verify(cosine), "a long, b long, n long"))
    links = met.where("b < 0").groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_links"))
    roots = components(met.where("b >= 0").select("a", "b")).withColumnRenamed("node", "_rep")
    final = points.select("_rep", "_h", "_g", "_least", "_many").join(links, "_rep", "left").join(roots, "_rep", "left")
    final = cut(final.select("_h", "_g", "_least", "_many", (F.coalesce("_links", F.lit(0)) + F.col("_many") - 1).alias("n_links"), F.coalesce("root", "_rep").alias("_root")))
    least = cut(final.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_of")))
    final = cut(join_weighted(final, least, ["_root"], "_of").select("_h", "_g", "_many", "n_links", "component_id"))
    found = join_weighted(named.where("_able").select("vec_id", "_h", "_g"), final, ["_h", "_g"], "_many").select("vec_id", "n_links", "component_id")
    rest = named.where("NOT _able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""SimHash near-duplicates by similarity: wide fingerprints, generalised pigeonhole with a stated risk, verified on the texts.

Two texts of Jaccard similarity s (over their sets of shingles) differ in each bit of a SimHash with a probability p(s)
that rises as s falls. The bits are dealt to parts of equal width, correlated bits together; each part has a threshold,
and two texts are candidates if in some part they differ in no more bits than its threshold. The thresholds (-1: the part
isn't probed) are those of least cost, by dynamic programming over candidate counts estimated from a sample, for which a
pair at the limit is missed with a probability of at most MISS. Candidates are probed by the parts' values, filtered
by further bits, and settled by the true Jaccard similarity, so that no link is false.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, cut, fresh_names, partitions, whole_groups
from .simhash import bit_groups
from .sketches import apart_by, close_links, connected

SHINGLE, PERCENT = 5, 80
#: The chance that a pair at the limit shares no probed part; a bit differs a little oftener in short texts than in theory.
MISS, SHORT_TEXTS = 1e-3, 1.12
#: Bits besides the parts by which candidates are filtered, and standard deviations from the limit at which they fall.
CHECK, DEVIATIONS = 192, 4.5
#: Fingerprints from which correlations and candidate counts are estimated: they steer the cost, never the result.
SAMPLE = 4096
#: Rows of a bucket, and sets and bytes of a candidate group, that one call compares; larger ones are sliced.
BUCKET, GROUP, GROUP_BYTES = 2048, 400, 32 << 20
#: Parts among whose bits correlations are looked at together.
BLOCK = 128
#: A bucket that so many fingerprints of the sample share is sliced before it is dealt.
HOT = 8
#: What is broadcast, at most; beyond, it is joined by shuffling.
BROADCAST_BYTES = 16 << 20
_SEED = np.random.default_rng(42)
_FLIP = _SEED.integers(0, 2**63, 256, dtype=np.uint64)
_TIMES = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: the finalizer of MurmurHash3


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted XXH64 of a text's distinct shingles. A text of fewer words is one shingle, no words are the empty one."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only, as wanted
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s) for s in shingles), dtype=np.uint64))


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of ``words`` words of 64 bits: a bit is set if it is set for more than half of the hashes."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for k in range(0, len(hashes), 255):  # sums of bytes hold up to 255
        x = hashes[k : k + 255, None] ^ _FLIP[:words]
        for times in _TIMES:
            x ^= x >> np.uint64(33)
            x *= times
        x ^= x >> np.uint64(33)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def differing(percent: int) -> float:
    """The probability that a bit differs between sets of that similarity, of equal size."""
    s = percent / 100
    return acos(min(1.0, 2 * s / (1 + s))) / pi


def within(p: float, width: int, t: int) -> float:
    return sum(comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(t + 1))


def layout(n: int, percent: int) -> tuple[int, int]:
    """(width of a part, parts to choose from) for ``n`` texts, by the cost of rows and random pairs if bits were fair coins."""
    p = min(0.5, differing(percent) * SHORT_TEXTS)
    plans = []
    for width in range(8, max(10, min(30, ceil(log2(n + 2)) + 2))):
        parts = ceil(log(MISS) / log(1 - within(p, width, 0))) if p else 1
        plans.append((parts * (1 + 0.0025 * n / 2**width / 2), width, parts))
    _, width, parts = min(plans)
    return width, ceil(1.2 * parts) + 1  # some more: the costly ones are left out


def thresholds(bits: np.ndarray, groups: np.ndarray, n: int, percent: int) -> list[int]:
    """A threshold for each part: the least cost at which a pair at the limit is missed with probability ``MISS`` at most."""
    width = groups.shape[1]
    p = min(0.5, differing(percent) * SHORT_TEXTS)
    reach = [within(p, width, t) for t in (0, 1)]
    unit = log(1 / MISS) / 400
    worth = [min(400, int(log(1 / (1 - min(r, 1 - 1e-12))) / unit)) for r in reach]
    pairs, cost = max(1, len(bits) ** 2 - len(bits)), []
    for group in groups:
        _, count = np.unique(bits[:, group].astype(np.int64) @ (1 << np.arange(width)), return_counts=True)
        share = max(float((count * (count - 1)).sum()) / pairs, 2.0**-width)
        cost.append([(probes * (1 + 0.0025 * min(1.0, probes * share) * n / 2)) for probes in (1, 1 + width)])
    best: list[tuple[float, tuple]] = [(0.0, ())] + [(float("inf"), ())] * 400
    for c in cost:  # what has been gained, up to 400 units, and how
        step = [(spent, (*how, -1)) for spent, how in best]
        for have, (spent, how) in enumerate(best):
            for t in (0, 1):
                got = min(400, have + worth[t])
                if spent + c[t] < step[got][0]:
                    step[got] = (spent + c[t], (*how, t))
        best = step
    chosen = best[400][1]
    return list(chosen) if chosen else [0] * len(cost)  # out of reach: every part is probed


def _unpack(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def _values(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The value of each part of fingerprints, its number in the bits from 32 up."""
    width = groups.shape[1]
    return _unpack(words)[:, groups].astype(np.int64) @ (1 << np.arange(width)) + (np.arange(len(groups)) << 32)


def _marks(words: int, size: int):
    def run(text: pd.Series) -> pd.DataFrame:
        """A name of the set, its size and its fingerprint."""
        import xxhash

        sets = [shingle_set(t, size) for t in text]
        names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"fp": names, "n": [len(s) for s in sets], "bits": [fingerprint(s, words).view(np.int64) for s in sets]})

    return run


def _mix(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(np.broadcast(*parts).shape or 1, dtype=np.uint64)
    for p in parts:
        x = (x ^ np.asarray(p, dtype=np.int64).view(np.uint64)) * _TIMES[0]
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


_SLOT = "_key long, _fp long, " + ", ".join(f"_c{k} long" for k in range(CHECK // 64))


def _slots(groups: np.ndarray, chosen: list[int], hot: dict[int, tuple[int, list[int], int, int]], most: int):
    """A row for each probed value of each part.

    A hot bucket has a centre. Rows near it are linked through it and needn't be compared among themselves: they go to
    one of ``near`` slices each, with the centre; the others go to all of these and to each pair of their own slices.
    """
    checks, keys_of = CHECK // 64, np.array(sorted(hot), dtype=np.int64)
    parts = [i for i, t in enumerate(chosen) if t >= 0]
    flips = {i: np.concatenate([[0], 1 << np.arange(groups.shape[1])]) if chosen[i] else np.zeros(1, dtype=np.int64) for i in parts}

    def frame(key: np.ndarray, fp: np.ndarray, check: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"_key": key, "_fp": fp, **{f"_c{k}": check[:, k].view(np.int64) for k in range(checks)}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.iloc[at : at + 2048]
                words = np.stack(batch["_bits"].to_numpy()).view(np.uint64)
                fp, check, value = batch["_fp"].to_numpy(), words[:, :checks], _values(words[:, checks:], groups)
                for i in parts:
                    for flip in flips[i].tolist():
                        key = value[:, i] ^ flip
                        heavy = np.isin(key, keys_of) if len(keys_of) else np.zeros(len(key), dtype=bool)
                        yield frame(_mix(key[~heavy]), fp[~heavy], check[~heavy])
                        for k in np.unique(key[heavy]).tolist():
                            name, centre, near, far = hot[k]
                            own = np.flatnonzero(key == k)
                            centre = np.array([centre], dtype=np.int64).view(np.uint64)
                            close = apart_by(check[own], centre) <= most
                            m, o = own[close], own[~close]
                            for j in range(far):
                                slots = _mix(k, j, fp[m] % near)
                                yield frame(slots, fp[m], check[m])
                                for s in np.unique(slots).tolist():
                                    yield frame(np.array([s]), np.array([name]), centre)
                            part = fp[o] % far
                            for j in range(near):
                                yield frame(_mix(k, part, j), fp[o], check[o])
                            for j in range(far):
                                yield frame(_mix(k, np.minimum(part, j), np.maximum(part, j), -1), fp[o], check[o])

    return run


def near(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of ``others`` whether its Jaccard with ``own`` is ``percent`` hundredths or more."""
    sizes = np.array([len(s) for s in others])
    out = 100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))
    some = np.flatnonzero(out)
    if len(some):
        all_ = np.concatenate([others[i] for i in some])
        held = own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_
        both = np.add.reduceat(held, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
        out[some] = 100 * both >= percent * (sizes[some] + len(own) - both)
    return out


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the near copies among distinct ``sets``: each found one is compared with what is left."""
    rest, edges = np.arange(len(sets)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = near(sets[at], [sets[i] for i in rest], percent)
            edges += [(int(at), int(i)) for i in rest[hit]]
            front += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def _sets_of(rows: pd.DataFrame, size: int) -> tuple[list[int], list[np.ndarray]]:
    once = rows.drop_duplicates("_fp")
    return once["_fp"].tolist(), [shingle_set(t, size) for t in once["_text"]]


def _settle(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole candidate groups to the links of their texts."""
        for rows in whole_groups(batches, "_root"):
            out = []
            for _, group in rows.groupby("_root", sort=False):
                names, sets = _sets_of(group, size)
                out += [(names[i], names[j]) for i, j in forest(sets, percent)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _across(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole slots to links between their far and their other texts, as many as connect them."""
        for rows in whole_groups(batches, "_slot"):
            out = []
            for _, group in rows.groupby("_slot", sort=False):
                names, sets = _sets_of(group, size)
                far = set(group.loc[group["_far"], "_fp"])
                left, right = [], []
                for i, name in enumerate(names):
                    if name in far:
                        hit = np.flatnonzero(near(sets[i], sets, percent))
                        left += [i] * len(hit)
                        right += hit.tolist()
                root = connected(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), len(names))
                out += [(names[r], names[i]) for i, r in enumerate(root.tolist()) if r != i]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _compare(size: int, percent: int):
    def run(text: pd.Series, centre: pd.Series) -> pd.Series:
        sets: dict[str, np.ndarray] = {c: shingle_set(c, size) for c in centre.unique()}
        return pd.Series([bool(near(sets[c], [shingle_set(t, size)], percent)[0]) for t, c in zip(text, centre, strict=True)], dtype=bool)

    return run


def _medoids(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(_root, _centre): of each group the member nearest to the bits that most of its members have."""
    words = range(CHECK // 64)
    bits = F.expr("array(" + ", ".join(f"transform(sequence(0, 63), b -> getbit(_c{w}, b))" for w in words) + ")")
    counts = members.select("_root", F.posexplode(F.flatten(bits)).alias("_bit", "_one")).groupBy("_root", "_bit").agg(F.sum(F.col("_one").cast("long")).alias("_ones"))
    set_ = counts.join(roots, "_root").where(F.col("_ones") * 2 > F.col("_n"))
    most = set_.groupBy("_root").agg(*[F.coalesce(F.bit_or(F.when(F.expr(f"_bit div 64 = {w}"), F.expr("shiftleft(1L, _bit % 64)"))), F.lit(0)).alias(f"_m{w}") for w in words])
    apart = sum(F.bit_count(F.col(f"_c{w}").bitwiseXOR(F.coalesce(f"_m{w}", F.lit(0)))) for w in words)
    placed = members.join(F.broadcast(most) if roots.count() * 40 < BROADCAST_BYTES else most, "_root", "left")
    return placed.groupBy("_root").agg(F.min_by("_fp", F.struct(apart.alias("d"), "_fp")).alias("_centre"))


def _verified(groups: DataFrame, texts, fps: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): true links that connect what is linked within each candidate group (node, root)."""
    members = groups.select(F.col("node").alias("_fp"), F.col("root").alias("_root")).join(fps, "_fp")
    members = cut(members.select("_root", "_fp", "_nbytes", *[F.element_at("_bits", k + 1).alias(f"_c{k}") for k in range(CHECK // 64)]))
    large = cut(members.groupBy("_root").agg(F.count("*").alias("_n"), F.sum("_nbytes").alias("_b")).where((F.col("_n") > GROUP) | (F.col("_b") > GROUP_BYTES)))
    small = members.join(large, "_root", "left_anti").select("_root", "_fp")
    small = texts(small)
    out = small.repartition("_root").sortWithinPartitions("_root").mapInPandas(_settle(size, percent), "a long, b long")
    if not large.take(1):
        return out
    members = members.join(large, "_root")
    centres = _medoids(members, large.select("_root", "_n")).withColumnRenamed("_centre", "_fp")
    centres = cut(texts(centres).dropDuplicates(["_root"]).withColumnsRenamed({"_fp": "_centre", "_text": "_centre_text"}))
    weight = centres.agg(F.sum(F.octet_length("_centre_text"))).first()[0] or 0
    salts = partitions(members.sparkSession)
    rows = texts(members.select("_root", "_fp", "_n", "_b", F.pmod(F.xxhash64("_fp"), F.lit(salts)).alias("_salt")))
    if weight < BROADCAST_BYTES:
        met = rows.join(F.broadcast(centres), "_root")
    else:
        met = rows.join(centres.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["_root", "_salt"])
    close = F.pandas_udf(_compare(size, percent), "boolean")("_text", "_centre_text")
    star = cut(met.select("_root", "_fp", "_centre", "_n", "_b", close.alias("_close")).distinct())
    out = out.unionByName(star.where("_close AND _fp <> _centre").select(F.col("_centre").alias("a"), F.col("_fp").alias("b")))
    far = star.where("NOT _close").groupBy("_root").agg(F.count("*").alias("_o"))
    slices = F.greatest(F.ceil(F.col("_n") / (GROUP / 2)), F.ceil(F.col("_b") / (GROUP_BYTES / 2))).cast("int")
    todo = star.join(far, "_root").withColumn("_slices", slices).withColumn("_own", F.pmod(F.xxhash64("_fp"), F.col("_slices")).cast("int"))
    outer = F.greatest(F.lit(1), F.ceil(F.col("_slices") * F.col("_o") / F.col("_n"))).cast("int")  # the far ones' slices
    todo = todo.withColumn("_outer", outer).withColumn("_part", F.pmod(F.xxhash64("_fp", F.lit(1)), F.col("_outer")).cast("int"))
    every = todo.select("_root", "_fp", F.lit(False).alias("_far"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_outer") - 1), lambda j: F.xxhash64("_root", j, "_own"))).alias("_slot"))
    each = todo.where("NOT _close").select("_root", "_fp", F.lit(True).alias("_far"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_slices") - 1), lambda i: F.xxhash64("_root", "_part", i))).alias("_slot"))
    held = texts(every.unionByName(each).groupBy("_slot", "_fp").agg(F.max("_far").alias("_far")))
    return out.unionByName(held.repartition("_slot").sortWithinPartitions("_slot").mapInPandas(_across(size, percent), "a long, b long"))


def links(fps: DataFrame, texts, n: int, groups_width: tuple[int, int], size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): true links of ``fps`` (_fp, _bits, _nbytes), enough to connect all that are linked; ``texts`` adds ``_text`` to rows with ``_fp``."""
    width, parts = groups_width
    checks = CHECK // 64
    got = fps.select("_fp", "_bits").orderBy(F.xxhash64(F.lit(7), "_fp")).limit(SAMPLE).collect()
    words = np.array([r["_bits"] for r in got], dtype=np.int64).reshape(len(got), checks + -(-width * parts // 64)).view(np.uint64)
    bits = _unpack(words[:, checks:])
    groups = np.concatenate([np.array(bit_groups(bits[:, i * width : j * width], j - i)) + i * width for i in range(0, parts, BLOCK) for j in [min(parts, i + BLOCK)]])
    chosen = thresholds(bits, groups, n, percent)
    p = differing(percent)
    most = min(CHECK // 2 - 20, ceil(CHECK * p + DEVIATIONS * (CHECK * p * (1 - p)) ** 0.5))
    hot: dict[int, tuple[int, list[int], int, int]] = {}
    for i, t in enumerate(chosen):
        if t < 0 or not len(got):
            continue
        value = _values(words[:, checks:], groups)[:, i]
        if t:
            value = np.concatenate([value ^ f for f in (0, *(1 << b for b in range(width)))])
        key, first, count = np.unique(value, return_index=True, return_counts=True)
        for k in np.flatnonzero((count >= HOT) & (count * n > BUCKET * len(got))).tolist():
            here = np.flatnonzero(value == key[k]) % len(got)
            check = words[here, :checks]
            apart = apart_by(check[:64, None], check[None, :64])
            centre = int(np.argmax((apart <= most).sum(axis=1)))
            close = int((apart_by(check, check[centre]) <= most).sum())
            slices = [max(1, ceil(c * n / len(got) / BUCKET)) for c in (close, len(here) - close)]
            hot[int(key[k])] = (int(got[here[centre]]["_fp"]), check[centre].view(np.int64).tolist(), *slices)
    slots = fps.select("_fp", "_bits").mapInPandas(_slots(groups, chosen, hot, most), _SLOT)
    met = slots.repartition("_key").sortWithinPartitions("_key").mapInPandas(close_links(most, CHECK), "a long, b long")
    return _verified(components(met), texts, fps, size, percent)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates: one with the group's smallest doc_id (a null doc_id only if it has no other).

    Texts whose sets of ``size``-word shingles (A-Z lower-cased) have a Jaccard of ``percent`` hundredths or more are
    linked; groups are what links connect. Every link counted is true; MISS bounds the chance that one at the limit is
    not found. Null and empty texts are one group; very long texts count whole; of repeated rows one stays; an empty table
    gives none; columns keep their names, whatever they are. Texts of one set are grouped before anything is compared.
    """
    bound_batches(docs.sparkSession)
    width, parts = layout(docs.count(), percent)
    row, mark = fresh_names(docs, "row", "mark")
    words = CHECK // 64 + -(-width * parts // 64)
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    named = docs.withColumn(row, F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), name.alias("name"), F.xxhash64(text).alias("hash")))
    mark_of = F.pandas_udf(_marks(words, size), "fp long, n int, bits array<long>")
    marked = cut(named.select(F.col(row).alias("_row"), mark_of(F.col(text)).alias("_mark")))
    fps = cut(marked.groupBy(F.col("_mark.fp").alias("_fp")).agg(F.min("_row").alias("_row"), F.any_value("_mark.bits").alias("_bits"), (F.any_value("_mark.n") * F.lit(8)).alias("_nbytes")))
    n = fps.count()
    own = fps.select("_fp", F.col("_row.name").alias("_name"), F.col("_row.hash").alias("_hash"))
    bodies = named.select(F.col(f"{row}.name").alias("_name"), F.col(f"{row}.hash").alias("_hash"), F.col(text).alias("_text"))

    def texts(rows: DataFrame) -> DataFrame:
        asked = cut(rows.join(own, "_fp"))
        asked = F.broadcast(asked) if asked.count() * 128 < BROADCAST_BYTES else asked
        return bodies.join(asked, ["_name", "_hash"]).drop("_name", "_hash")

    found = links(fps, texts, n, (width, parts), size, percent)
    rooted = fps.join(components(found).withColumnRenamed("node", "_fp"), "_fp", "left").select("_row", F.coalesce("root", "_fp").alias("_root"))
    best = rooted.groupBy("_root").agg(F.min("_row").alias("_row")).select(F.col("_row.name").alias("_name"), F.col("_row.hash").alias("_hash"))
    keyed = named.withColumn(mark, F.struct(F.col(f"{row}.name").alias("_name"), F.col(f"{row}.hash").alias("_hash"))).drop(row)
    best = best.select(F.struct("_name", "_hash").alias(mark))
    return keyed.join(best, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)

"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each of them leads to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, slices

#: A run of letters; only A to Z are lower-cased.
RUN, LOWER = re.compile("[A-Za-zÀ-ÿ]+"), {c: c + 32 for c in range(65, 91)}
#: Code points and occurrences of a word; how much commoner a form is.
LENGTH, COUNT, FACTOR = 6, 5, 5
#: Different letters of a lower-cased run, so at most SYMBOLS ** 2 bigrams: what is known of each bigram has a fixed bound.
SYMBOLS = 26 + 64
#: Words whose counts a task holds before it passes them on.
HELD = 100_000


def _occurrences(damage: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (_id, text) to (word, n): counts of a task's texts, a part at a time."""
        held: Counter[str] = Counter()
        for batch in batches:
            for piece in slices(batch):
                for key, text in zip(piece["_id"], piece["text"], strict=True):
                    seed = crc32(f"{key}:".encode())
                    for word, n in Counter(RUN.findall(text)).items():
                        word = word.lower() if word.isascii() else word.translate(LOWER)
                        if damage and (h := crc32(word.encode(), seed)) % damage == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        if len(word) >= LENGTH:
                            held[word] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return run


def words(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """(word, n) for runs of at least LENGTH letters that occur COUNT times or more in whole texts; null texts have none.

    ``damage``: a run whose crc32 with its doc_id is a multiple loses one letter, as a typing slip would have it.
    """
    bound_batches(docs.sparkSession)
    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text")
    counted = texts.mapInPandas(_occurrences(damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


def _of_one_length(words: pd.Series, chars: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their letters as numbers under SYMBOLS, a row a word."""
    for length, part in words.groupby(words.str.len(), sort=True):
        step = max(1, chars // int(length))
        for k in range(0, len(part), step):
            own = part.iloc[k : k + step]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), dtype="<u4").reshape(len(own), -1).astype(np.int64)
            yield own.index.to_numpy(), np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)


def _bigrams(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-1] * SYMBOLS + codes[:, 1:]


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SYMBOLS**2, dtype=np.int64)
    for batch in batches:
        for _, codes in _of_one_length(batch["word"]):
            total += np.bincount(_bigrams(codes).ravel(), minlength=len(total))
    held = np.flatnonzero(total)
    yield pd.DataFrame({"gram": held, "n": total[held]})


def cheapest_pair(cost: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of costs by position, two positions at least two apart with the least sum.

    Dynamic programming from left to right: the best single position up to two before, and the best pair so far.
    """
    rows, n = np.arange(len(cost)), cost.shape[1]
    one, pair = np.zeros(len(cost), dtype=np.int64), np.full(len(cost), 2 * none)
    left, right = np.zeros(len(cost), dtype=np.int64), np.full(len(cost), n - 1)
    for p in range(2, n):
        one = np.where(cost[:, p - 2] < cost[rows, one], p - 2, one)
        total = cost[rows, one] + cost[:, p]
        better = total < pair
        pair, left, right = np.where(better, total, pair), np.where(better, one, left), np.where(better, p, right)
    return left, right


def _key(gram: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Gram, length and position in one number. Very long words may share numbers with others; verification tells them apart."""
    return (gram << 48) ^ (length << 24) ^ at


def _signatures(rank: np.ndarray, cost: np.ndarray):
    none = int(cost.sum()) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each word with the rank of its prefix's last gram, a mask of its letters, and the keys of its pivots and its prefix."""
        for batch in batches:
            batch = batch.reset_index(drop=True)
            for at, codes in _of_one_length(batch["word"]):
                grams, length = _bigrams(codes), codes.shape[1]
                ranks = rank[grams]
                last = np.partition(ranks, 2, axis=1)[:, 2]
                prefix = ranks <= last[:, None]  # the three rarest, and every further place of the last of them
                left, right = cheapest_pair(np.where(prefix, cost[grams], none), none)
                rows, pivots = np.arange(len(at)), []
                for p in (left, right):
                    gram = grams[rows, p]
                    pivots += [_key(gram, length + d, p + s) for d, s in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))]
                row, p = np.nonzero(prefix)
                keys = np.split(_key(grams[row, p], length, p), np.flatnonzero(np.diff(row)) + 1)
                mask = np.bitwise_or.reduce(np.int64(1) << (codes % 64), axis=1)
                own = batch.iloc[at]
                yield pd.DataFrame({"word": own["word"].to_numpy(), "n": own["n"].to_numpy(), "last": last, "mask": mask, "pivots": list(np.stack(pivots, axis=1)), "prefix": keys})

    return run


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, for all words that one inserted, deleted or replaced letter turns into each other.

    Grams are ordered by how rare they are. Of two words one edit apart, the one whose prefix (its three rarest grams) ends
    first in that order has two disjoint pivots in it, and one edit leaves one of them, moved by no more than the
    difference of lengths: so it stands in the other's prefix, at that place. Pivots are indexed by gram, length and place
    as the other word would have them; what meets there passes a mask of letters and is verified.
    """
    counts = counted.mapInPandas(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most SYMBOLS ** 2 rows
    cost, rank = np.zeros(SYMBOLS**2, dtype=np.int64), np.zeros(SYMBOLS**2, dtype=np.int64)
    for k, (gram, n) in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"]))):
        rank[gram], cost[gram] = k, n
    schema = "word string, n long, last long, mask long, pivots array<long>, prefix array<long>"
    signed = cut(counted.mapInPandas(_signatures(rank, cost), schema))
    index = signed.select(*[F.col(c).alias(f"_{c}") for c in ("word", "n", "last", "mask")], F.explode("pivots").alias("_at"))
    probes = signed.select("word", "n", "last", "mask", F.explode("prefix").alias("_at"))
    met = probes.join(index, "_at").where((F.col("last") >= F.col("_last")) & (F.col("word") != F.col("_word")))
    met = met.where(F.bit_count(F.col("mask").bitwiseXOR(F.col("_mask"))) <= 2).where(F.levenshtein("word", "_word", 1) == 1)
    both = F.array(F.struct("word", F.col("_word").alias("near"), F.col("_n").alias("near_n")), F.struct(F.col("_word").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return met.select(F.inline(both)).repartition("word").dropDuplicates(["word", "near"])


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where links (word, form) end. A form is FACTOR times commoner, so paths are short and never circular; each round doubles what is known of them."""
    known = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("_open")))
    while known.where("_open").take(1):
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        known = cut(known.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_open")))
    return known.select("word", "root")


def _better(n: Column, of: Column) -> Column:
    return n >= FACTOR * of


def variants(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words``.

    The form is the near word of largest n, the smallest of those in code-point order, if it is FACTOR times as common.
    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each; other columns of
    ``docs`` are ignored; a run of any length is one word. Tables without words give no rows.
    """
    counted = cut(words(docs.select("doc_id", "text"), damage))
    best = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("_best"))
    rows = counted.join(best, "word", "left").withColumn("_form_n", -F.col("_best.n"))
    has = F.coalesce(_better(F.col("_form_n"), F.col("n")), F.lit(False))
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("_best.near")).alias("form"), F.when(has, F.col("_form_n")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Correcting misspelt words against a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corrections(words: DataFrame, word: str, vocabulary: DataFrame, known: str, most: int = 2, least_length: int = 4) -> DataFrame:
    """(word, correction, distance): for each different word that isn't known, the nearest known one within ``most`` edits.

    Of ``most`` + 1 parts of a known word one at least stands in any word within that many edits, moved by no more places. A
    known word is held under its parts, with their number and its length; a word looks up what stands where such a part
    could, for each length near its own: at most (2 k + 1) ** 2 * (k + 1) keys, however long it is. Ties: alphabetical.
    """
    some = words.select(F.lower(word).alias("word")).where(F.length("word") >= least_length).distinct().join(vocabulary.select(F.lower(known).alias("word")), "word", "left_anti")
    vocab = vocabulary.select(F.lower(known).alias("known")).where(F.length("known") >= least_length).distinct()

    parts = most + 1

    def part(length: Column, i: Column) -> tuple[Column, Column]:
        """Where the i-th part of a word of that length begins, and how long it is: the last ones are a letter longer."""
        base, longer = F.floor(length / parts), F.lit(parts) - length % parts
        return 1 + i * base + F.greatest(F.lit(0), i - longer), base + F.when(i >= longer, 1).otherwise(0)

    def key(length: Column, i: Column, text: Column) -> Column:
        return F.concat_ws("|", length.cast("string"), i.cast("string"), text)

    def own(word: Column) -> Column:
        def one(i: Column) -> Column:
            at, n = part(F.length(word), i)
            return key(F.length(word), i, F.substring(word, at.cast("int"), n.cast("int")))

        return F.transform(F.sequence(F.lit(0), F.lit(most)), one)

    def others(word: Column) -> Column:
        def one(length: Column, i: Column, move: Column) -> Column:
            at, n = part(length, i)
            inside = (length >= least_length) & (at + move >= 1) & (at + move + n - 1 <= F.length(word))
            return F.when(inside, key(length, i, F.substring(word, (at + move).cast("int"), n.cast("int"))))

        near = F.sequence(F.lit(-most), F.lit(most))
        every = F.flatten(F.transform(near, lambda d: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.transform(near, lambda m: one(F.length(word) + d, i, m))))))
        return F.array_distinct(F.filter(every, lambda k: k.isNotNull()))

    left = some.select("word", F.explode(others(F.col("word"))).alias("_key"))
    right = vocab.select("known", F.explode(own(F.col("known"))).alias("_key"))
    pairs = left.join(right, "_key").select("word", "known").distinct().withColumn("distance", F.levenshtein("word", "known")).where(F.col("distance") <= most)
    best = pairs.groupBy("word").agg(F.min(F.struct("distance", "known")).alias("_b"))
    return best.select("word", F.col("_b.known").alias("correction"), F.col("_b.distance").alias("distance"))

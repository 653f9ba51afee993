"""Wishes with several slots: which items meet which of them, how many would for every way of relaxing the wish, and the best by weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a wish at most: there are 2 ** SLOTS ways of relaxing it.
SLOTS = 12


def met(slots: dict[str, Column]) -> Column:
    """The slots that an item meets, as bits in their order; a null condition isn't met."""
    if not 0 < len(slots) <= SLOTS:
        raise ValueError(f"a wish has 1 to {SLOTS} slots")
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(slots.values())])


def relaxations(rows: DataFrame, slots: dict[str, Column]) -> DataFrame:
    """(kept, slots, n_slots, items): for every set of slots how many items meet all of it; the empty set is all items.

    Items are read once and counted by the set they meet. Each count is then added to all its subsets: at most 4 ** SLOTS
    small rows, whatever the number of items.
    """
    names, sets = list(slots), 1 << len(slots)
    counts = rows.select(met(slots).alias("_met")).groupBy("_met").agg(F.count("*").alias("_n"))
    spark = rows.sparkSession
    every = spark.range(sets).select(F.col("id").cast("int").alias("kept"))
    sums = counts.select("_n", F.explode(F.filter(F.sequence(F.lit(0), F.lit(sets - 1)), lambda s: s.bitwiseAND(F.col("_met")) == s)).alias("kept")).groupBy("kept").agg(F.sum("_n").alias("_items"))
    said = F.filter(F.array(*[F.when(F.col("kept").bitwiseAND(F.lit(1 << i)) > 0, n) for i, n in enumerate(names)]), lambda n: n.isNotNull())
    return every.join(sums, "kept", "left").select("kept", F.array_join(said, ",").alias("slots"), F.bit_count("kept").alias("n_slots"), F.coalesce("_items", F.lit(0)).cast("long").alias("items"))


def least_relaxed(found: DataFrame, least: int = 1) -> DataFrame:
    """Of the result of ``relaxations`` the largest sets of slots that at least so many items meet."""
    enough = found.where(F.col("items") >= least)
    most = enough.agg(F.max("n_slots").alias("_most"))  # one row
    return enough.crossJoin(F.broadcast(most)).where("n_slots = _most").drop("_most")


def best(rows: DataFrame, slots: dict[str, Column], weights: dict[str, float], order: list[Column], k: int, needed: tuple[str, ...] = ()) -> DataFrame:
    """The k items of the largest sum of the weights of what they meet, ``order`` breaking ties; with ``met``, ``missed`` and ``score``.

    Items that miss a slot of ``needed`` are left out. Only k rows of each task are ever moved.
    """
    rows = rows.withColumn("met", met(slots))
    bit = lambda i: F.col("met").bitwiseAND(F.lit(1 << i)) > 0
    held = [bit(i) for i, n in enumerate(slots) if n in needed]
    rows = rows.where(reduce(lambda a, b: a & b, held)) if held else rows
    score = reduce(lambda a, b: a + b, [F.when(bit(i), float(weights.get(n, 0.0))).otherwise(0.0) for i, n in enumerate(slots)])
    missed = F.filter(F.array(*[F.when(~bit(i), n) for i, n in enumerate(slots)]), lambda n: n.isNotNull())
    return rows.withColumn("score", F.round(score, 6)).withColumn("missed", F.array_join(missed, ",")).orderBy(F.desc("score"), *order).limit(k)

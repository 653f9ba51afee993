"""Funnels, feedback, evaluation and session statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def funnel(events: DataFrame, shown: str, ordered: str, abstained: str, days: int | None = None) -> DataFrame:
    """One row: totals of the three events and their rates, over the last ``days`` before the newest event."""
    if days is not None:
        newest = events.agg(F.max("ts").alias("_newest"))
        events = events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("_newest") - F.expr(f"INTERVAL {days} DAY"))
    n = {name: F.count_if(F.col("event_type") == e) for name, e in (("shown_total", shown), ("ordered_total", ordered), ("abstain_total", abstained))}
    totals = events.agg(*[c.alias(name) for name, c in n.items()])
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 3)
    return totals.select("*", rate(F.col("ordered_total"), F.col("shown_total")).alias("conversion_rate"), rate(F.col("abstain_total"), F.col("shown_total") + F.col("abstain_total")).alias("abstain_rate"))


def drop_off(events: DataFrame, shown: str, ordered: str, least: int = 3, top: int = 20) -> DataFrame:
    """Of the ``top`` products shown most, and at least ``least`` times: sessions that saw and ordered, over times shown.

    One aggregate by (product, session), then one by product: no session sets are gathered.
    """
    pairs = events.where(F.col("event_type").isin(shown, ordered)).groupBy("product", "session").agg(F.count_if(F.col("event_type") == shown).alias("s"), F.count_if(F.col("event_type") == ordered).alias("o"))
    per = pairs.groupBy("product").agg(F.sum("s").alias("shown"), F.count_if(F.col("s") > 0).alias("shown_in_sessions"), F.count_if((F.col("s") > 0) & (F.col("o") > 0)).alias("ordered_in_sessions"))
    best = per.where(F.col("shown") > 0).orderBy(F.desc("shown"), "product").limit(top).where(F.col("shown") >= least)
    return best.withColumn("session_conversion_ratio", F.round(F.col("ordered_in_sessions") / F.col("shown"), 3))


def feedback(rows: DataFrame, up: str, group: str) -> DataFrame:
    """(group, total, up, down, satisfaction): votes by group."""
    return rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col(up)).alias("up"), F.count_if(~F.col(up)).alias("down")).withColumn("satisfaction", F.round(F.col("up") / F.col("total"), 3))


def worst(rows: DataFrame, group: str, count: str, n: int) -> DataFrame:
    return rows.where(F.col(count) > 0).orderBy(F.desc(count), group).limit(n).select(group, count)


def streaks(events: DataFrame, key: str, order: list[str], failed) -> DataFrame:
    """(key, n_streaks, longest): runs of consecutive failed events by key."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.select(key, *order, failed.alias("_f")).withColumn("_run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("_f").groupBy(key, "_run").agg(F.count("*").alias("_n"))
    return runs.groupBy(key).agg(F.count("*").alias("n_streaks"), F.max("_n").alias("longest"))


def over_limit(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """``events`` with ``in_window``, the key's events of the last ``seconds`` with this one, and ``rejected`` where those pass ``limit``."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    rows = events.withColumn("in_window", F.count("*").over(w))
    return rows.withColumn("rejected", F.col("in_window") > limit)


def regression_diff(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, change) of boolean ``passed`` on both sides: improved, regressed, unchanged, new or removed."""
    rows = current.select(key, F.col("passed").alias("_c")).join(baseline.select(key, F.col("passed").alias("_b")), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_c").isNull(), "removed").when(F.col("_c") == F.col("_b"), "unchanged").when(F.col("_c"), "improved").otherwise("regressed")
    return rows.select(key, change.alias("change"))


def preferences(rows: DataFrame, key: str, choice: str, amount: str, least: int, top: int) -> DataFrame:
    """(key, favourites, typical): up to ``top`` choices met at least ``least`` times, most frequent first, and the median amount of two or more."""
    counted = rows.groupBy(key, choice).agg(F.count("*").alias("_n"))
    often = counted.where(F.col("_n") >= least).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(choice).alias("c")))).alias("_l"))
    favourites = often.select(key, F.array_join(F.transform(F.slice("_l", 1, top), lambda x: x["c"]), ",").alias("favourites"))
    typical = rows.groupBy(key).agg(F.when(F.count(amount) >= 2, F.round(F.median(amount), 4)).alias("typical"))
    return typical.join(favourites, key, "left")

"""Catalog maintenance and product relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sync_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, missing): keys on one side only, by one outer join of the distinct keys."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "right").otherwise("left").alias("missing"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): rows of both sides whose named fields differ, null-safe, with the names of those fields."""
    joined = old.select(key, F.struct(*fields).alias("_o")).join(new.select(key, F.struct(*fields).alias("_n")), key)
    names = F.array_compact(F.array(*[F.when(~F.col(f"_o.{f}").eqNullSafe(F.col(f"_n.{f}")), F.lit(f)) for f in fields]))
    return joined.select(key, F.array_join(names, ",").alias("changed")).where("changed <> ''")


def upsert_actions(current: DataFrame, staged: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """``staged`` left-joined to ``current``: (key, action, restocked). Edits outside ``watched`` are skipped; watched[0] is the stock."""
    old = current.select(key, F.lit(True).alias("_known"), F.struct(*watched).alias("_o"))
    rows = staged.select(key, F.struct(*watched).alias("_n")).join(old, key, "left")
    stock = ~F.col(f"_o.{watched[0]}").eqNullSafe(F.col(f"_n.{watched[0]}"))
    other = reduce(lambda a, b: a | b, [~F.col(f"_o.{w}").eqNullSafe(F.col(f"_n.{w}")) for w in watched[1:]], F.lit(False))
    action = F.when(F.col("_known").isNull(), "inserted").when(stock, "stock_changed").when(other, "updated").otherwise("skipped")
    restocked = F.coalesce((F.col(f"_o.{watched[0]}") <= 0) & (F.col(f"_n.{watched[0]}") > 0), F.lit(False))
    return rows.select(key, action.alias("action"), restocked.alias("restocked"))


def upsert(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The table after ``staged`` replaces rows of its keys."""
    return current.join(staged.select(key), key, "left_anti").unionByName(staged)


def patch(current: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``current`` with the non-null ``fields`` of ``changes``; keys it doesn't know are ignored. One row for each key of ``changes``."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    rows = current.join(new, key, "left")
    return rows.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])


def delete(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key), key, "left_anti")


def audit(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, issue): a row for each failed rule, in one pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select(key, F.explode(found).alias("issue"))


def nearest_by(rows: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Each row's nearest other row of its group by ``value``: (key, value, other, distance); ties to the smaller key.

    In the order of the value the nearest is a neighbour, so each row is compared with two rows, not with its group.
    """
    w = Window.partitionBy(group).orderBy(value, key)
    sides = rows.select(group, key, value, F.lag(F.struct(value, key)).over(w).alias("_p"), F.lead(F.struct(value, key)).over(w).alias("_n"))
    gap = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.round(F.abs(F.col(f"{s}.{value}") - F.col(value)), 4).alias("d"), F.col(f"{s}.{key}").alias("k")))
    best = F.array_min(F.array_compact(F.array(gap("_p"), gap("_n"))))
    return sides.select(key, group, value, best.alias("_b")).where("_b IS NOT NULL").select(key, group, value, F.col("_b.k").alias("other"), F.col("_b.d").alias("distance"))


def best_of_each(rows: DataFrame, group: str, order: list[Column], columns: list[str]) -> DataFrame:
    """One row of each group, the least by ``order``: an aggregate, combined before it is moved."""
    return rows.groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(group, "_r.*")


def siblings(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """``rows`` with the number and the smallest key of their variant group, themselves included. Pairs are never made."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n_siblings"), F.min(key).alias("first_sibling"))
    return rows.join(sizes, group)

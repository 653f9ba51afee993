"""Predicates from filter dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPERATORS = {"$eq": lambda c, v: c.eqNullSafe(F.lit(v)), "$in": lambda c, v: c.isin(list(v)), "$gte": lambda c, v: c >= v, "$lte": lambda c, v: c <= v, "$gt": lambda c, v: c > v, "$lt": lambda c, v: c < v}


def predicate(columns: list[str], filters: dict, metadata: str | None = None) -> Column:
    """Scalar: equality, null-safe; list: membership; dictionary: every operator in it. A null never passes a range.

    A field that isn't a column is looked up in the ``metadata`` map. Unknown operators raise.
    """
    parts = []
    for name, wanted in filters.items():
        if name not in columns and metadata is None:
            raise ValueError(f"no such field: {name}")
        value = F.col(name) if name in columns else F.try_element_at(F.col(metadata), F.lit(name))
        tests = wanted if isinstance(wanted, dict) else {"$in" if isinstance(wanted, (list, tuple, set)) else "$eq": wanted}
        for op, operand in tests.items():
            if op not in _OPERATORS:
                raise ValueError(f"unknown operator: {op}")
            parts.append(F.coalesce(_OPERATORS[op](value, operand), F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply(rows: DataFrame, filters: dict, metadata: str | None = None) -> DataFrame:
    return rows.where(predicate(rows.columns, filters, metadata))


def keep_or_all(rows: DataFrame, test: Column) -> DataFrame:
    """The rows that pass; all rows if none does. The count is one row, not a window over all of them."""
    flagged = rows.withColumn("_pass", F.coalesce(test, F.lit(False)))
    some = flagged.agg(F.coalesce(F.bool_or("_pass"), F.lit(False)).alias("_some"))
    return flagged.crossJoin(F.broadcast(some)).where("_pass OR NOT _some").drop("_pass", "_some")


def relaxed(rows: DataFrame, required: Column, soft: list[Column]) -> DataFrame:
    """Rows at the least relaxation that any row meets: level k drops the first k soft tests. Adds ``level``.

    One pass: a row's own level is one past the last soft test it fails; the least level is one aggregate row.
    """
    level = F.lit(0)
    for k, test in enumerate(soft):
        level = F.when(~F.coalesce(test, F.lit(False)), k + 1).otherwise(level)
    own = rows.where(required).withColumn("level", level)
    least = own.agg(F.min("level").alias("_least"))
    return own.crossJoin(F.broadcast(least)).where("level = _least").drop("_least")

"""Order, waitlist and profile records, and the state of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Status: the time that is stamped when it is first reached.
STAMPS = {"confirmed": "confirmed_at", "dispatched": "dispatched_at", "delivered": "delivered_at"}


def advance_orders(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """``orders`` with each change's status; a stamp that is set is never moved. One change for each order_id."""
    new = changes.select("order_id", F.col("status").alias("_status"), F.col("at").alias("_at"))
    rows = orders.join(new, "order_id", "left")
    stamps = {column: F.coalesce(F.col(column), F.when(F.col("_status") == status, F.col("_at"))) for status, column in STAMPS.items()}
    return rows.withColumns({**stamps, "status": F.coalesce("_status", "status")}).select(*orders.columns)


def mark_notified(waitlist: DataFrame, restocked: DataFrame) -> DataFrame:
    """Pending entries of restocked products become notified."""
    known = restocked.select("product_id").distinct().withColumn("_back", F.lit(True))
    rows = waitlist.join(known, "product_id", "left")
    return rows.withColumn("status", F.when(F.col("_back") & (F.col("status") == "pending"), "notified").otherwise(F.col("status"))).select(*waitlist.columns)


def merge_profiles(old: DataFrame, new: DataFrame, key: str, lists: list[str], scalars: list[str], most: int = 5) -> DataFrame:
    """One profile for each key: lists joined new first, each value once and ``most`` at most; scalars overwritten unless null."""
    a, b = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in lists + scalars]), new.select(key, *[F.col(c).alias(f"_n_{c}") for c in lists + scalars])
    rows = a.join(b, key, "full_outer")
    none = F.array().cast("array<string>")
    merged = [F.slice(F.array_distinct(F.concat(F.coalesce(f"_n_{c}", none), F.coalesce(f"_o_{c}", none))), 1, most).alias(c) for c in lists]
    return rows.select(key, *merged, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in scalars])


def domains(signals: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One row: whether each domain has any value in any of its fields."""
    return signals.agg(*[F.coalesce(F.bool_or(F.coalesce(*fs).isNotNull()), F.lit(False)).alias(d) for d, fs in fields.items()])


def newest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the greatest of several columns over all rows; nulls are skipped."""
    return rows.agg(F.max(F.greatest(*columns)).alias("newest"))


def waiting(waitlist: DataFrame, pending: str, product: str) -> DataFrame:
    """One row: entries, pending ones, and products that anyone waits for."""
    return waitlist.agg(F.count("*").alias("total"), F.count_if(F.col(pending)).alias("pending"), F.count_distinct(F.when(F.col(pending), F.col(product))).alias("products"))

"""Registered queries of record and table-state operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources.tables import table


def waiting(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a waitlist: open ones wait."""
    return R.waiting(table(spark, sf, "lineitem").withColumn("open", F.col("l_linestatus") == "O"), "open", "l_partkey")


WAITING = "SELECT count(*) AS total, count(*) FILTER (l_linestatus = 'O') AS pending, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_partkey END) AS products FROM lineitem"


def newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.newest(rows.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("b")), ["a", "b"])


NEWEST = "SELECT max(greatest(strftime(l_shipdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d'))) AS newest FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def domains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("returned"), F.when(F.col("l_tax") < 0, F.col("l_tax")).alias("refund"), "l_discount")
    return R.domains(rows, {"returns": ["returned"], "refunds": ["refund"], "margin": ["refund", "l_discount"]})


DOMAINS = "SELECT coalesce(bool_or(l_returnflag = 'R' AND l_quantity IS NOT NULL), false) AS returns, coalesce(bool_or(l_tax < 0), false) AS refunds, coalesce(bool_or(l_discount IS NOT NULL OR l_tax < 0), false) AS margin FROM lineitem"

QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in ("waiting", "newest", "domains")}

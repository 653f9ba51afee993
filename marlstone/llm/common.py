"""Helpers that the corpus operators share: tables, lineage cuts, global ranks and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import bound_batches  # noqa: F401 - part of this module too

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. A local session that has none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named is None:
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="marlstone-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def file_order(df: DataFrame) -> Column | None:
    """Where a row stands in the files that ``df`` was read from, as a string that sorts so; none if it wasn't read from files."""
    from pyspark.errors import AnalysisException

    place = F.concat_ws("/", F.col("_metadata.file_name"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
    try:
        df.select(place)
    except AnalysisException:
        return None
    return place


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and reread from the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` as a compressed table in the shared folder, reread: like ``cut``, but for rows that hold texts."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(at, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for new columns that ``df`` doesn't have, whatever the case: underscores and the wanted name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def slices(batch: pd.DataFrame, text: str = "text", chars: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """``batch`` in pieces of about so many characters: Spark bounds the bytes of a batch, this what is made of them."""
    ends = batch[text].str.len().fillna(0).cumsum() // chars
    for _, piece in batch.groupby(ends.to_numpy(), sort=False):
        yield piece


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``key``, cut so that every key is whole: the last one of a batch waits for the next."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        ends = np.flatnonzero(k != k[-1])
        last = int(ends[-1]) + 1 if len(ends) else 0
        if held and (last or held[-1][key].iloc[-1] != k[-1]):
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        elif last:
            yield batch.iloc[:last]
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def global_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Range-sorted ``df`` with ``_mid``: ids that rise in that order, the task in the bits from 33 up.

    The result is cut: what uses ``_mid`` twice must see the same numbers.
    """
    placed = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return cut(placed.withColumn("_mid", F.monotonically_increasing_id()))


def dense_rank(ordered: DataFrame, group: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place from 0 of each row within ``group``, for a result of ``global_order`` sorted by ``group`` first.

    Only one row for each task and group is gathered, never the rows of a group.
    """
    ordered = ordered.withColumn("_task", F.shiftright("_mid", 33))
    parts = ordered.groupBy("_task", *group).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = ordered.join(parts, ["_task", *group])
    return joined.withColumn(name, F.col("_before") + F.col("_mid") - F.col("_first")).drop("_task", "_first", "_before", "_mid")


def join_weighted(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``left`` joined to ``right``, which has one row a key and, in ``weight``, the number of rows that ``left`` has of it.

    Keys that hold over a thousandth of ``left`` are at most a thousand: their rows of ``right`` are broadcast, so that
    none of them gathers in one task. The others are joined by shuffling.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) > max(total / 1000, 10_000))
    if not hot.take(1):
        return left.join(right, on)
    met = left.join(F.broadcast(hot), on)
    return met.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of undirected ``edges``: root is the smallest node that can be reached.

    Alternates large-star and small-star steps; every step is a grouped minimum and a join, both of which Spark
    splits when one node has very many neighbours. Each round is cut. Stops when a round changes nothing.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m"))).where("u <> v").distinct()
        pairs = cut(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

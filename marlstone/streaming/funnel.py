"""Event streams: windowed funnels, session state and change batches. Extensions: batch operators state the same results."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import last_wins


#: Folders among which the rows of a table kept by a stream are dealt: at most so many small broadcast rows.
BUCKETS = 256


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a table's files, with ``ts`` as a timestamp."""
    return read_table(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a table that is a folder or one file: as a pattern, since a plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_funnel(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of each event type by window; events later than ``late`` behind the newest are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_state(turns: DataFrame, key: str, failed: str, order: str) -> DataFrame:
    """(key, n_turns, failures): after each batch, every key's turns so far and its failures in a row. Batches by arrival, rows of a batch by ``order``."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns_, run = state.get if state.exists else (0, 0)
        bad = pd.concat(list(batches)).sort_values(order)[failed].fillna(False).to_numpy(dtype=bool)
        good = np.flatnonzero(~bad)
        turns_, run = turns_ + len(bad), len(bad) - 1 - int(good[-1]) if len(good) else run + len(bad)
        state.update((turns_, run))
        yield pd.DataFrame({key: [name[0]], "n_turns": [turns_], "failures": [run]})

    kind = dict(turns.dtypes)[key]
    return turns.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_turns long, failures long", "n_turns long, failures long", "update", GroupStateTimeout.NoTimeout)


def run_updates(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Runs ``stream`` over what is there now, in update mode, and returns the last row of each key.

    A batch overwrites its own folder, so a batch that is run again after a failure changes nothing.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return last_wins(stream.sparkSession.read.parquet(f"{path}/rows").drop("batch"), keys, ["_batch"]).drop("_batch")


def apply_changes(stream: DataFrame, path: str, key: str, order: str) -> None:
    """Keeps a table in step with a change stream: of each key the last row by ``order`` stays, in whatever batch it came.

    Rows are dealt to ``BUCKETS`` folders by a hash of their key; a batch rewrites only the folders that it touches, each as a
    new version named by the batch, so a repeated batch starts from the same versions. ``current_rows`` reads the newest ones;
    versions before the last two are of no more use and may be removed.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = last_wins(batch, [key], [order]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        held = versions(spark, path, number)
        if held is not None:
            touched = new.select("bucket").distinct()
            new = last_wins(held.join(F.broadcast(touched), "bucket", "left_semi").select(*new.columns).unionByName(new), [key], [order])
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/table/version={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def versions(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The newest rows of each bucket among the versions before a batch; none before the first. A file listing decides, no data is read for it."""
    if not before:
        return None
    rows = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table").where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("version")


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``apply_changes`` keeps."""
    return versions(spark, path, 1 << 62).drop("bucket")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    from ..operators.shared import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"

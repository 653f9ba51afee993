"""The folder that all executors see, for checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session that names none gets a temporary folder; one on a cluster is refused."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="marlstone-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() work in this session."""
    shared_folder(spark)


def bound_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Bounds the bytes of the Arrow batches in which texts reach Python. Only ever lowered, to one value, so no plan depends on which operator was built last."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(megabytes << 20))

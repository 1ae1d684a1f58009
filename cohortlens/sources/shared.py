"""The folder that driver and executors share, for tables that cut lineage, and batches on the way to Python."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on the way to a Python worker.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches in bytes: 10,000 rows of long texts, and what Python makes of them, would take gigabytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) not in range(1, BATCH + 1):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def checkpoint_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder, from spark.checkpoint.dir where the context has none.

    A local[*] session without that setting gets a temporary folder; a cluster session without it is an error, as the other
    machines would not see a local folder.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cohortlens-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read from there: later plans see the same rows in the same partitions."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()

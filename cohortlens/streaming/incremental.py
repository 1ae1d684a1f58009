"""Incremental work: what is pending, resume audits, and exactly-once appends from a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.gates import GateError, require_empty, require_unique
from cohortlens.sources import commits


def pending(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that aren't done yet."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def resume_audit(log: DataFrame, key: str, expected: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(ids done, rows to repeat) of a result log: ids outside the plan or repeated valid ids raise, invalid rows are redone."""
    require_empty(log.join(expected.select(key).distinct(), key, "left_anti").select(key), "ids outside the plan")
    good = F.coalesce(valid, F.lit(False))
    done = log.where(good)
    require_unique(done, [key])
    return done.select(key), log.where(~good)


#: Where a stream keeps the keys that it has seen: on disk, so that their number isn't bound by memory.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_once(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], key: str, target: str, checkpoint: str, available: bool = True):
    """A file stream of Parquet rows into a Parquet table, each key once.

    The keys seen so far are the stream's state, dealt by their hash: a micro-batch looks up its own keys and never reads the
    table, however large that is. State and files go back to the last whole batch after a failure; a batch is written to a
    folder of its own number, so a repeat overwrites what it left. A table without the stream's checkpoint raises, as its
    keys aren't known.
    """
    if commits.names(spark, target) and not commits.exists(spark, f"{checkpoint}/metadata"):
        raise GateError(f"{target} holds rows of another stream")

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    stream = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    before = spark.conf.get(STATE[0], None)
    spark.conf.set(*STATE)
    try:
        return (stream.trigger(availableNow=True) if available else stream).start()
    finally:
        spark.conf.set(STATE[0], before) if before else spark.conf.unset(STATE[0])


def windowed_counts(events: DataFrame, time: str, groups: list[str], value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by event-time window; with a stream, windows close when the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))

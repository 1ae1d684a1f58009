"""Sessions, shared tables and Arrow batches: what the operators of this package have in common."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a worker handles at once, and that an Arrow batch on the way to it holds.
CHUNK, BATCH = 1 << 20, 8 << 20
ROOT = str(Path(__file__).resolve().parents[2])
_saved: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the input tables, pruned to `columns` when they are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path (executors elsewhere need it installed or in --py-files).

    Arrow batches are limited in bytes, as 10,000 long texts in one batch would take the memory of several workers.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) not in range(1, BATCH + 1):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    A local[*] session without that setting gets a temporary folder; a cluster session without it is an error, as a
    machine-local folder would not be seen by the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cohortlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not _saved:
        atexit.register(drop_saved)
    _saved.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep a table on the executors' disks while a function uses it several times; what is lost with one is computed again.

    The function releases it with unpersist() once its own result is written.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def save_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Write one small file to the shared folder; its path."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.bin"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    if not _saved:
        atexit.register(drop_saved)
    _saved.append((spark, path))
    return path


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote and that no later plan reads."""
    for entry in [x for x in _saved if any(x[1].rsplit("/", 1)[-1] in f for f in df.inputFiles())]:
        _delete(*entry)
        _saved.remove(entry)


def drop_saved() -> None:
    """Delete every table that save() wrote."""
    while _saved:
        _delete(*_saved.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the cluster's own cleaning takes over
        pass


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about `limit` bytes, or one row if that row alone is larger."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        if batch.nbytes + 2048 * rows <= limit:
            yield batch
            continue
        sizes = [0] * rows
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                lengths = pa.compute.binary_length(column).fill_null(0).to_pylist()
                sizes = [a + b for a, b in zip(sizes, lengths, strict=True)]
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 2048  # rows of little text cost something too
        yield batch.slice(start)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = CHUNK) -> DataFrame:
    """Apply `function` to pieces of bounded size of each partition."""
    ship(df.sparkSession)
    return df.mapInArrow(functools.partial(_mapped, function, limit), schema)


def _mapped(function, limit, batches):
    for piece in chunks(batches, limit):
        out = function(piece)
        if out is not None and out.num_rows:
            yield out


def texts_of(batch: pa.RecordBatch, index: int = 1) -> list[str]:
    """A column of strings, with null as the empty text."""
    return [x or "" for x in batch.column(index).to_pylist()]


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def field_types(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


import pyarrow.compute  # noqa: E402,F401  (pa.compute is a lazy submodule)


def text_column(spark: SparkSession, function: Callable[[list[str | None]], list[pa.Array]], ddl: str, limit: int = CHUNK):
    """A function of one text column that returns a struct: `function` maps a bounded list of texts to the struct's fields.

    It is marked nondeterministic, so that the optimizer doesn't evaluate it once for a filter and again for a projection.
    """
    from pyspark.sql.functions import arrow_udf

    ship(spark)
    names = [f.name for f in field_types(ddl).fields]

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            out = [
                pa.StructArray.from_arrays(function(piece.column(0).to_pylist()), names)
                for piece in chunks([pa.RecordBatch.from_arrays([array], ["text"])], limit)
            ]
            yield pa.concat_arrays(out) if out else pa.StructArray.from_arrays(function([]), names)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, field_types(ddl)).asNondeterministic()

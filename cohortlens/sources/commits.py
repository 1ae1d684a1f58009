"""Rows appended to several Parquet tables at once: all of a commit, or nothing.

The rows of each table are written to a folder that readers don't see (its name begins with `_`). A commit is one small file that
names these folders; once it is there, their files are moved into the tables. What a crash left behind is settled by the next
commit, or by recover(): the files of a named folder are moved on, folders that no commit names are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

NEW, LOG = "_new-", "_commits"


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _system(spark, path)
    system.delete(where, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    system, where = _system(spark, path)
    return [f.getPath().toString() for f in system.listStatus(where)] if system.exists(where) else []


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    return [_name(x) for x in _children(spark, path)]


def _publish(spark: SparkSession, folder: str, table: str) -> None:
    """Move the data files of a folder into the table; a repeat goes on with those that are left."""
    for path in _children(spark, folder):
        if not _name(path).startswith(("_", ".")):
            system, where = _system(spark, path)
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{_name(path)}")
            if not system.rename(where, target):
                raise OSError(f"can't move {path} to {table}")
    delete(spark, folder)


def _finish(spark: SparkSession, record: str) -> None:
    system, where = _system(spark, record)
    stream = system.open(where)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
    for folder, table in json.loads(text):
        _publish(spark, folder, table)
    system.delete(where, False)


def recover(spark: SparkSession, log: str, tables: list[str]) -> None:
    """Finish the commits that `log` names and delete what others began. One writer at a time."""
    for record in _children(spark, f"{log}/{LOG}"):
        if _name(record).startswith(NEW):
            delete(spark, record)  # a record that was never whole
        else:
            _finish(spark, record)
    for table in tables:
        for path in _children(spark, table):
            if _name(path).startswith(NEW):
                delete(spark, path)


def append(log: str, tables: dict[str, DataFrame]) -> None:
    """Append each DataFrame to the Parquet table of its path. `log` is the folder of the commits, one of the tables for
    instance; recover() it with the same tables before reading what to append."""
    spark = next(iter(tables.values())).sparkSession
    number, folders = uuid.uuid4().hex, []
    for table, rows in tables.items():
        folders.append((f"{table.rstrip('/')}/{NEW}{number}", table.rstrip("/")))
        rows.write.parquet(folders[-1][0])
    system, draft = _system(spark, f"{log}/{LOG}/{NEW}{number}")
    stream = system.create(draft)
    try:
        stream.write(bytearray(json.dumps(folders).encode("utf-8")))
    finally:
        stream.close()
    record = f"{log}/{LOG}/{number}"
    if not system.rename(draft, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(record)):  # from here on the commit stands
        raise OSError(f"can't write {record}")
    _finish(spark, record)

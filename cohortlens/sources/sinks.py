"""Sinks: JSON lines, CSV, normalized vector tables, atomic and freeze-once JSON documents."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.gates import GateError
from cohortlens.operators.retrieval import l2_normalize


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False) -> None:
    """`single` writes one file: for reports of a few rows."""
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str, vector: str = "embedding", mode: str = "errorifexists") -> None:
    """A vector table with its metadata, each vector of unit length, in one row: nothing to align by position."""
    df.withColumn(vector, l2_normalize(F.col(vector))).write.mode(mode).parquet(path)


def write_bundle(vectors: DataFrame, metadata: DataFrame, path: str, key: str = "record_id", vector: str = "embedding") -> None:
    """Vectors and metadata of the same keys, each once, as one vector table; keys that only one side has raise."""
    from cohortlens.operators.gates import require_empty, require_unique, set_differences

    require_unique(vectors, [key])
    require_unique(metadata, [key])
    require_empty(set_differences(vectors, metadata, [key]), "vectors and metadata have different rows")
    write_vectors(metadata.join(vectors.select(key, vector), key), path, vector)


def write_records(df: DataFrame, path: str, key: str, files: int = 256, mode: str = "errorifexists") -> None:
    """Records by their key's hash: one is found by reading a single folder (see read_record). A file for each record would be
    millions of files; a folder holds those of one hash bucket."""
    df.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(files))).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def read_record(spark, path: str, key: str, value, files: int = 256) -> DataFrame:
    """The rows of one key; only its bucket's folder is read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(files)).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def write_repaired(df: DataFrame, path: str) -> str:
    """A repaired table beside the one that it was made from, which stays as it was: the path of the new version."""
    from pathlib import PurePosixPath

    spark = df.sparkSession
    at = PurePosixPath(path)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    for version in range(2, 10_000):
        target = f"{path.rstrip('/')}-v{version}" if "://" in path else str(at.with_name(f"{at.name}-v{version}"))
        where = jvm.Path(target)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            df.write.parquet(target)
            return target
    raise GateError(f"{path} has too many versions")


def write_forms(forms: list[DataFrame], crosswalk: DataFrame, folder: str, labels: tuple[str, ...], fingerprint: str) -> dict:
    """Blinded forms with empty cells for each label as CSV, and the crosswalk apart. A folder that holds forms already must be
    of the same cohort (its fingerprint); then nothing is written again."""
    manifest = Path(folder) / "forms.json"
    if manifest.exists():
        made = json.loads(manifest.read_text(encoding="utf-8"))
        if made["fingerprint"] != fingerprint:
            raise GateError(f"{folder} holds the forms of another cohort")
        return made
    paths = {}
    for k, form in enumerate(forms, 1):
        cells = [F.lit("").alias(c) for c in [*[f"human_{x.replace(' ', '_')}" for x in labels], "annotator_id", "notes"]]
        paths[f"annotator{k}"] = f"{folder}/annotator{k}"
        write_csv(form.drop("position").select("*", *cells), paths[f"annotator{k}"], single=True)
    paths["crosswalk"] = f"{folder}/crosswalk"
    write_csv(crosswalk, paths["crosswalk"], single=True)
    made = {"fingerprint": fingerprint, "paths": paths}
    write_document(made, str(manifest))
    return made


def write_document(value: dict, path: str) -> None:
    """A small JSON file, replaced at once; NaN is refused."""
    text = json.dumps(value, indent=2, sort_keys=True, allow_nan=False)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)


def freeze_document(value: dict, path: str) -> None:
    """Write a JSON file once; a later value must be the same."""
    if Path(path).exists():
        if json.loads(Path(path).read_text(encoding="utf-8")) != json.loads(json.dumps(value, allow_nan=False)):
            raise GateError(f"{path} is frozen with another value")
        return
    write_document(value, path)

"""Readers: tables by suffix, strict and pruned JSON lines, embedding tables, annotation forms, file inventories, asset pairs."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.labels import LABELS
from cohortlens.operators.gates import GateError, require_binary_vectors, require_columns, require_empty, require_unique, set_differences
from cohortlens.operators.ordering import numbered

# Fixed value: fields under which a JSON object may wrap its rows.
WRAPPERS = ("records", "data", "metadata", "items")
CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. `strict` raises for a line that isn't a JSON object, with the line."""
    if not strict:
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if schema is None:
        schema = spark.read.json(path).schema
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    schema = T.StructType([f for f in schema.fields if f.name != CORRUPT])
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull() | ~F.ltrim("value").startswith("{")
    first = parsed.where(bad).select("value", F.input_file_name().alias("file")).limit(1).collect()
    if first:  # only now are lines counted, in the file at fault
        numbered = spark.sparkContext.textFile(first[0]["file"]).zipWithIndex()
        line = min((k for _, k in numbered.filter(lambda x, text=first[0]["value"]: x[0] == text).take(1)), default=-1) + 1
        raise GateError(f"not a JSON object: {first[0]['file']}:{line}: {first[0]['value'][:200]}")
    return parsed.select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields])


def read_fields(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """Only the listed fields of JSON lines: each must be there (not null) in every row, and the key must be unique."""
    df = read_jsonl(spark, path, schema)
    missing = F.lit(False)
    for f in df.columns:
        missing = missing | F.col(f).isNull()
    require_empty(df.where(missing), "a row lacks a field")
    require_unique(df, key)
    return df


STATISTICS = "generation_record_id string, query_record_id string, model_key string, bundle string, source_dataset string, condition string, patient_key string, reference_vector array<int>, prediction_vector array<int>, runtime_seconds double, score string"


def read_statistics(spark: SparkSession, path: str, conditions: tuple[str, ...], schema: str = STATISTICS) -> DataFrame:
    """The pruned frame of paired statistics: `score` as a number or null, exactly the given conditions, whole binary vectors,
    unique record ids; anything else raises."""
    df = read_jsonl(spark, path, schema).withColumn("score", F.expr("try_cast(score as double)"))
    require_unique(df, ["generation_record_id"])
    require_binary_vectors(df, ["reference_vector", "prediction_vector"], len(LABELS))
    wanted = spark.createDataFrame([(c,) for c in conditions], "condition string")
    require_empty(set_differences(df, wanted, ["condition"]), "conditions differ from the plan's")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: .jsonl, .json (an array, or an object that wraps its rows), .csv, .tsv or .txt, .parquet."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".jsonl":
        return read_jsonl(spark, path)
    if suffix == ".json":
        df = spark.read.option("multiLine", True).json(path)
        for name in WRAPPERS:
            if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
                return df.select(F.inline(name))
        return df
    if suffix in (".csv", ".tsv", ".txt"):
        return spark.read.option("header", True).option("sep", "," if suffix == ".csv" else "\t").option("multiLine", True).option("escape", '"').csv(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported table type: {path}")


def read_document(path: str) -> dict:
    """A small JSON configuration on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_embeddings(spark: SparkSession, path: str, key: str, vector: str = "embedding") -> DataFrame:
    """A vector table: unique ids and vectors of one length; names that contain `text` are refused, as these hold text vectors."""
    if "text" in os.path.basename(path.rstrip("/")).lower():
        raise GateError(f"{path} looks like text embeddings")
    df = spark.read.parquet(path)
    require_columns(df, [key, vector])
    require_unique(df, [key])
    require_empty(df.select(F.size(vector).alias("d")).distinct().orderBy("d").offset(1), "vectors of several lengths")
    return df


def ingest_vectors(spark: SparkSession, vectors: str, metadata: DataFrame, order: str, key: str, block: int = 100_000) -> DataFrame:
    """(key, embedding) of a two-dimensional .npy file whose i-th row belongs to the i-th metadata row by `order`, for writing a
    vector table once. Other shapes and numbers of rows raise; the file is read block by block, through a memory map."""
    import numpy as np

    if "text" in os.path.basename(vectors).lower():
        raise GateError(f"{vectors} looks like text embeddings")
    array = np.load(vectors, mmap_mode="r")
    if array.ndim != 2 or len(array) != metadata.count():
        raise GateError(f"{vectors} has the shape {array.shape}, the metadata {metadata.count()} rows")
    starts = spark.createDataFrame([(k,) for k in range(0, len(array), block)], "start long").repartition(max(1, -(-len(array) // block)))

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for start in batch["start"]:
                some = np.load(vectors, mmap_mode="r")[start : start + block]
                yield pd.DataFrame({"__at": np.arange(start, start + len(some)), "embedding": list(np.asarray(some, dtype="float32"))})

    read = starts.mapInPandas(rows, "__at long, embedding array<float>")
    return numbered(metadata.select(key, order), [order, key], "__at").join(read, "__at").select(key, "embedding")


def read_bundle(spark: SparkSession, gallery: str, queries: str, key: str = "record_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The vector tables of a gallery and its queries: vectors of one length in both."""
    both = read_embeddings(spark, gallery, key, vector), read_embeddings(spark, queries, key, vector)
    sizes = [df.select(F.size(vector).alias("d")).limit(1).collect() for df in both]
    if not all(sizes) or sizes[0] != sizes[1]:
        raise GateError("gallery and queries have no vectors or vectors of different lengths")
    return both


def read_form(spark: SparkSession, path: str, key: str, prefix: str, annotator: str = "annotator_id") -> DataFrame:
    """(key, annotator, ratings) of an annotation CSV: unique keys, one annotator, all 13 cells 0 or 1."""
    df = spark.read.option("header", True).csv(path)
    cells = [prefix + x.replace(" ", "_") for x in LABELS]
    require_columns(df, [key, annotator, *cells])
    require_unique(df, [key])
    require_empty(df.where(~F.forall(F.array(*[F.trim(c) for c in cells]), lambda x: F.coalesce(x.isin("0", "1"), F.lit(False)))).select(key), "a cell isn't 0 or 1")
    require_empty(df.select(annotator).distinct().orderBy(annotator).offset(1), "several annotators in one form")
    return df.select(key, annotator, F.array(*[F.trim(c).cast("int") for c in cells]).alias("ratings"))


def inventory(spark: SparkSession, path: str, name_pattern: str = ".*", hash_limit: int = 50 << 20, depth: int | None = None) -> DataFrame:
    """(path, length, modified, sha256) of the files below a folder, at most `depth` folders down, hidden folders left out; files
    above `hash_limit` bytes get no hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), os.path.abspath(path).rstrip("/") + "/", -1)
    named = files.where(F.element_at(F.split("path", "/"), -1).rlike(name_pattern) & ~below.rlike(r"(^|/)\.[^/]+/"))
    if depth is not None:
        named = named.where(F.size(F.split(below, "/")) <= depth + 1)
    return named.select("path", "length", F.col("modificationTime").alias("modified"), F.when(F.col("length") <= hash_limit, F.sha2("content", 256)).alias("sha256"))


def asset_pairs(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png"), strict: bool = True) -> DataFrame:
    """(record, image_path, json_path, image_sha256, metadata) of images and the JSON file of the same stem beside each.

    `strict` raises for an image without JSON. The binary source lists no empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    stem, ending = F.regexp_replace("path", r"\.[^./]*$", ""), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    images = files.where(ending.isin(*suffixes)).select(stem.alias("stem"), F.col("path").alias("image_path"), F.sha2("content", 256).alias("image_sha256"))
    metadata = files.where(ending == ".json").select(stem.alias("stem"), F.col("path").alias("json_path"), F.col("content").cast("string").alias("metadata"))
    pairs = images.join(metadata, "stem", "left")
    if strict:
        require_empty(pairs.where("json_path is null").select("image_path"), "images without JSON")
    return pairs.select(F.regexp_extract("stem", r"([^/]+)$", 1).alias("record"), "image_path", "json_path", "image_sha256", "metadata")


def choose_file(candidates: list[str], preferred: tuple[str, ...], kind: str) -> str:
    """The first preferred name that is there, else the only candidate; anything else raises."""
    by_name = {os.path.basename(c): c for c in candidates}
    for name in preferred:
        if name in by_name:
            return by_name[name]
    if len(candidates) == 1:
        return candidates[0]
    raise GateError(f"can't choose the {kind} among {sorted(candidates)}")


def labels_key_present(metadata: Column) -> Column:
    """True if a JSON text has a `labels` key, even if it is empty: absent is an error, empty means none."""
    return F.array_contains(F.json_object_keys(metadata), "labels")

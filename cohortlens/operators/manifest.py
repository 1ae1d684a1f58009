"""Manifests from image and JSON pairs: identifiers, report fields, labels and hashes, one row for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.hashing import halves
from cohortlens.functions.images import perceptual_hash
from cohortlens.functions.labels import negation_flags, normalize_labels
from cohortlens.functions.text import clean, normalize, report_of, text_hash
from cohortlens.operators.ordering import numbered
from cohortlens.operators.records import first_field, identifiers
from cohortlens.sources.readers import asset_pairs


def _labels(raw: Column) -> Column:
    """The labels of a JSON text: a list, a single text, or none."""
    value = F.get_json_object(raw, "$.labels")
    listed = F.from_json(value, "array<string>")
    found = F.when(F.ltrim(value).startswith("["), listed).otherwise(F.array(value))
    return F.coalesce(F.filter(F.transform(found, clean), lambda x: x != ""), F.array().cast("array<string>"))


def describe(pairs: DataFrame, dataset: str, split: str) -> DataFrame:
    """The manifest of pairs (record, image_path, json_path, image_sha256, metadata and perhaps image_phash).

    Metadata that isn't a JSON object raises when the result is read. record_id holds the row's number by image path.
    """
    raw, spot = F.col("__raw"), F.col("record")
    valid = F.when(F.json_object_keys(F.col("metadata")).isNotNull(), F.col("metadata")).otherwise(F.raise_error(F.concat(F.lit("can't parse "), F.col("json_path"))).cast("string"))
    rows = pairs.withColumn("__raw", valid)
    who = identifiers(raw, F.lit(dataset))
    finding, impression, caption, stated = (first_field(raw, names) for names in (("FINDINGS", "findings"), ("IMPRESSION", "impression"), ("Caption", "caption"), ("report", "REPORT", "report_text")))
    rows = rows.select("*", who.alias("__who"), _labels(raw).alias("labels_raw"), report_of(stated, finding, impression, caption).alias("report_text"))
    rows = rows.withColumn("labels", normalize_labels(F.col("labels_raw")))
    said = F.lower(clean(F.get_json_object(raw, "$.normal")))
    phash = F.col("image_phash") if "image_phash" in pairs.columns else F.lit(None).cast("string")
    patient = F.col("__who.patient_id")
    found = rows.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("source_split"), patient.alias("patient_id"), F.concat(F.lit(f"{dataset}:"), patient).alias("patient_key"),
        F.col("__who.patient_id_source").alias("patient_id_source"), F.col("__who.reliable").alias("patient_reliable"), F.coalesce("__who.study_id", spot).alias("study_id"),
        F.coalesce(first_field(raw, ("image_id", "image_name", "file_name")), spot).alias("image_id"), "image_path", "json_path", first_field(raw, ("view_position", "ViewPosition", "view")).alias("view_position"),
        F.when(said.isin("yes", "no"), said).when(F.size("labels") == 0, "yes").otherwise("no").alias("normal"), "labels_raw", "labels", finding.alias("findings"), impression.alias("impression"), caption.alias("caption"),
        "report_text", "image_sha256", phash.alias("image_phash"), halves(phash)[0].alias("hi"), halves(phash)[1].alias("lo"), text_hash(F.col("report_text")).alias("report_sha256"),
        negation_flags(normalize(F.col("report_text")), F.col("labels")).alias("negated_flags"),
    )
    return numbered(found, ["image_path"], "__at").select(F.format_string(f"{dataset}:{split}:%08d", F.col("__at")).alias("record_id"), *found.columns)


def build(spark: SparkSession, path: str, dataset: str, split: str, phash: bool = True, strict: bool = True) -> DataFrame:
    """The manifest of the images and their JSON files below a folder; `phash` decodes the images."""
    pairs = asset_pairs(spark, path, strict=strict).where("json_path is not null")
    if phash:
        decoded = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path)
        hashes = decoded.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("__at"), perceptual_hash(F.col("image")).alias("image_phash"))
        pairs = pairs.join(hashes, F.regexp_replace("image_path", "^file:/+", "/") == F.col("__at"), "left").drop("__at")
    return describe(pairs, dataset, split)


def relocated(path: Column, old: str, new: str) -> Column:
    """A path with its exact beginning `old` replaced; other paths stay as they are."""
    old, new = old.rstrip("/") + "/", new.rstrip("/") + "/"
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.char_length(path)))).otherwise(path)


def smoke_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of the smallest digests of seed and key: the same few whatever else there is."""
    place = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("__place", place).orderBy("__place", key).limit(n).drop("__place")


def split_summary(df: DataFrame, split: str, group: str, verdict: str, level: str) -> DataFrame:
    """(split, n_examples, n_groups, positive, negative, grouping_levels): the levels as a sorted map of counts."""
    levels = df.groupBy(split, level).agg(F.count(F.lit(1)).alias("n")).groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(level, "n")))).alias("grouping_levels"))
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_examples"), F.count_distinct(group).alias("n_groups"), F.count_if(F.col(verdict)).alias("positive"), F.count_if(~F.col(verdict)).alias("negative"))
    return counts.join(levels, split)


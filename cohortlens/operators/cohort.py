"""Leakage-free cohorts: overlap audits, anti-joins that keep their reasons, the banded near-hash join, unique alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import blocks, hamming
from cohortlens.operators.gates import GateError, require_empty
from cohortlens.operators.ordering import numbered

EXACT_FIELDS = ("study_id", "image_id", "image_sha256", "report_sha256")


def present(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def distinct_keys(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.select(present(column).alias("k")).where("k is not null").distinct()


def near_hashes(left: DataFrame, right: DataFrame, threshold: int = 4) -> DataFrame:
    """(hi_a, lo_a, hi_b, lo_b, distance): all pairs of distinct hashes of two tables (id, hi, lo) that differ in `threshold`
    bits or fewer, exactly.

    The join is on combinations of blocks of bits (see blocks()): two near hashes agree in one of them at least. It is over
    distinct hashes, so a hash that many rows share counts once. It is a merge join: Spark's size of a side is that before
    each hash becomes one row for each of its keys, so a side would be broadcast that the driver can't hold.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        hashes = df.where("hi is not null and lo is not null").select(F.col("hi").alias(f"hi_{tag}"), F.col("lo").alias(f"lo_{tag}")).distinct()
        return hashes.select("*", F.explode(blocks(F.col(f"hi_{tag}"), F.col(f"lo_{tag}"), threshold)).alias("key"))

    distance = hamming(F.col("hi_a"), F.col("lo_a"), F.col("hi_b"), F.col("lo_b"))
    both = side(left, "a").join(side(right, "b").hint("merge"), "key")
    return both.where(distance <= threshold).select("hi_a", "lo_a", "hi_b", "lo_b", distance.alias("distance")).distinct()


def near_hash_pairs(left: DataFrame, right: DataFrame, threshold: int = 4) -> DataFrame:
    """(id_a, id_b, distance): the rows behind all near hashes, pair by pair. For the rows of one side only, see near_rows."""
    rows = lambda df, tag: df.where("hi is not null and lo is not null").select(F.col("id").alias(f"id_{tag}"), F.col("hi").alias(f"hi_{tag}"), F.col("lo").alias(f"lo_{tag}"))
    near = near_hashes(left, right, threshold)
    return near.join(rows(left, "a"), ["hi_a", "lo_a"]).join(rows(right, "b"), ["hi_b", "lo_b"]).select("id_a", "id_b", "distance")


def near_rows(left: DataFrame, right: DataFrame, threshold: int = 4) -> DataFrame:
    """(id): the rows of `left` with a near hash in `right`; a hash that many rows share makes no pairs."""
    near = near_hashes(left, right, threshold).select(F.col("hi_a").alias("hi"), F.col("lo_a").alias("lo")).distinct()
    return left.join(near, ["hi", "lo"], "left_semi").select("id").distinct()


def _keys(df: DataFrame, tag: str) -> DataFrame:
    """(field, k, reliable): the manifest's keys, one row for each distinct one, in one pass over it."""
    fields = [F.struct(F.lit(f).alias("field"), present(f).alias("k"), (F.col("patient_reliable") if f == "patient_key" else F.lit(True)).alias("r")) for f in (*EXACT_FIELDS, "patient_key")]
    rows = df.select(F.explode(F.array(*fields)).alias("x")).select("x.*").where("k is not null")
    return rows.groupBy("field", "k").agg(F.max(F.coalesce("r", F.lit(False))).alias(f"reliable_{tag}"))


def overlap_audit(gallery: DataFrame, queries: DataFrame, threshold: int = 4, examples: int = 20) -> DataFrame:
    """(field, n_overlap, examples): shared keys of two manifests by field, and gallery rows with a near query hash."""
    shared = _keys(gallery, "a").join(_keys(queries, "b"), ["field", "k"]).where("field <> 'patient_key' or (reliable_a and reliable_b)").select("field", "k")
    near = near_rows(gallery.select(F.col("record_id").alias("id"), "hi", "lo"), queries.select(F.col("record_id").alias("id"), "hi", "lo"), threshold)
    found = shared.unionByName(near.select(F.lit("image_phash").alias("field"), F.col("id").alias("k")))
    fields = gallery.sparkSession.createDataFrame([(f,) for f in (*EXACT_FIELDS, "patient_key", "image_phash")], "field string")
    # a bounded number of examples: the smallest ones, by rank
    ranked = found.withColumn("r", F.row_number().over(_by("field", "k")))
    counted = found.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    shown = ranked.where(F.col("r") <= examples).groupBy("field").agg(F.array_sort(F.collect_list("k")).alias("examples"))
    joined = fields.join(counted, "field", "left").join(shown, "field", "left")
    return joined.select("field", F.coalesce("n", F.lit(0)).alias("n_overlap"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _by(partition: str, *order: str):
    return Window.partitionBy(partition).orderBy(*order)


def conflicts(gallery: DataFrame, queries: DataFrame, threshold: int = 4, assumed_groups: bool = True) -> DataFrame:
    """The gallery with `reasons`: a sorted array of why a row must not be used with these queries, empty if it may.

    All keys of both sides meet in one join on (field, key), near hashes in another; a row's reasons are then gathered by
    its record id. A reliable patient key that reliable query keys hold gives `reliable_patient_overlap`; otherwise a key
    that any query holds gives `assumed_patient_group_overlap`.
    """
    fields = [F.struct(F.lit(f).alias("field"), present(f).alias("k")) for f in (*EXACT_FIELDS, "patient_key")]
    own = gallery.select("record_id", F.coalesce("patient_reliable", F.lit(False)).alias("own"), F.explode(F.array(*fields)).alias("x")).select("record_id", "own", "x.*").where("k is not null")
    met = own.join(_keys(queries, "b"), ["field", "k"])
    patient = F.when(F.col("own") & F.col("reliable_b"), "reliable_patient_overlap")
    if assumed_groups:
        patient = patient.otherwise("assumed_patient_group_overlap")
    marks = met.select("record_id", F.when(F.col("field") == "patient_key", patient).otherwise(F.concat("field", F.lit("_overlap"))).alias("reason")).where("reason is not null")
    near = near_rows(gallery.select(F.col("record_id").alias("id"), "hi", "lo"), queries.select(F.col("record_id").alias("id"), "hi", "lo"), threshold)
    marks = marks.unionByName(near.select(F.col("id").alias("record_id"), F.lit(f"image_phash_distance<={threshold}").alias("reason")))
    found = marks.groupBy(F.col("record_id").alias("__id")).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # six reasons at most
    out = gallery.join(found, gallery["record_id"] == F.col("__id"), "left")
    return out.select(*[gallery[c] for c in gallery.columns], F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def clean_gallery(gallery: DataFrame, queries: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed rows with their reasons)."""
    marked = conflicts(gallery, queries, **options)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def reason_counts(removed: DataFrame) -> DataFrame:
    return removed.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def require_leakage_free(gallery: DataFrame, queries: DataFrame, threshold: int = 4) -> None:
    """Raise if the two manifests share anything that overlap_audit counts."""
    require_empty(overlap_audit(gallery, queries, threshold, 3).where("n_overlap > 0"), "overlap between gallery and queries")


def evaluation_overlap(rows: DataFrame, evaluation: DataFrame) -> DataFrame:
    """`rows` with `reasons` for exclusion: its group or patient, its source id, or its report occurs in the evaluation set.

    An evaluation patient's key and id count with and without a dataset prefix. Columns that the evaluation set lacks count
    as empty.
    """

    def keys(columns: tuple[str, ...], prefixed: bool = False) -> DataFrame:
        values = [present(c) for c in columns if c in evaluation.columns]
        values += [F.nullif(F.trim(F.regexp_extract(v, r"^[^:]*:(.*)$", 1)), F.lit("")) for v in values if prefixed]
        return evaluation.select(F.explode(F.array(*values) if values else F.array().cast("array<string>")).alias("k")).where("k is not null").distinct()

    people = keys(("patient_key", "patient_id"), prefixed=True)
    rules = (
        (people, "patient_or_source_group", "evaluation_patient_or_group"), (people, "patient_id", "evaluation_patient_or_group"),
        (keys(("record_id", "study_id", "image_id")), "source_record_id", "evaluation_source_id"), (keys(("report_sha256",)), "report_sha256", "evaluation_report_hash"),
    )
    marks, out = [], rows
    for n, (found, of, reason) in enumerate(rules):
        out = out.join(found.toDF(f"__k{n}"), present(of) == F.col(f"__k{n}"), "left")
        marks.append(F.when(F.col(f"__k{n}").isNotNull(), reason))
    return out.select(*[rows[c] for c in rows.columns], F.array_distinct(F.array_compact(F.array(*marks))).alias("reasons"))


def align_by_position(manifest: DataFrame, vectors: DataFrame, order: str, position: str) -> DataFrame:
    """(record_id, vector_id): the i-th manifest row by `order` with the i-th vector by `position`, for tables without a common
    key; tables of different lengths raise when the result is read. To be asked for: positions prove nothing.
    """
    left = numbered(manifest.select("record_id", order), [order, "record_id"] if order != "record_id" else [order], "__at")
    right = numbered(vectors.select("vector_id", position), [position, "vector_id"] if position != "vector_id" else [position], "__at")
    both = left.select("__at", "record_id").join(right.select("__at", "vector_id"), "__at", "full_outer")
    whole = F.when(F.col("record_id").isNotNull() & F.col("vector_id").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("manifest and vectors have different lengths")).cast("boolean"))
    return both.where(whole).select("record_id", "vector_id")


def reordered(df: DataFrame, key: str, positions: DataFrame) -> DataFrame:
    """`df` with `position`, for each (key, position) of an expected list; a missing or repeated key raises when the result is read."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*[c for c in df.columns if c != key])).alias("__row"))
    both = positions.select(key, "position").join(counted, key, "left")
    one = F.when(F.coalesce("__n", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not exactly one row for "), F.col(key).cast("string"))).cast("boolean"))
    return both.where(one).select(key, "position", "__row.*")


def align_unique(manifest: DataFrame, vectors: DataFrame, tokens: list[str], paths: list[str]) -> DataFrame:
    """(record_id, vector_id): each manifest row with the one vector row that shares a token with it.

    Tokens are `column:value`, for paths also their base name and stem. A row without exactly one match, or a vector that
    two rows match, raises when the result is read.
    """

    def exploded(df: DataFrame, key: str) -> DataFrame:
        made = [F.concat(F.lit(f"{c}:"), present(c)) for c in tokens if c in df.columns]
        for c in paths:
            if c in df.columns:
                base = F.element_at(F.split(present(c), "/"), -1)
                made += [F.concat(F.lit(f"{c}:"), present(c)), F.concat(F.lit("basename:"), base), F.concat(F.lit("stem:"), F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))]
        return df.select(key, F.explode(F.array_distinct(F.array_compact(F.array(*made)))).alias("token"))

    pairs = exploded(manifest, "record_id").join(exploded(vectors, "vector_id"), "token").select("record_id", "vector_id").distinct()
    per_row = pairs.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.min("vector_id").alias("vector_id"))
    matched = manifest.select("record_id").join(per_row, "record_id", "left")
    one = F.when(F.coalesce("n", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("can't uniquely align "), F.col("record_id"))).cast("boolean"))
    aligned = matched.where(one).select("record_id", "vector_id")
    shared = aligned.groupBy("vector_id").agg(F.count(F.lit(1)).alias("m"), F.min("record_id").alias("record_id"))
    single = F.when(F.col("m") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("several rows aligned to vector "), F.col("vector_id").cast("string"))).cast("boolean"))
    return shared.where(single).select("record_id", "vector_id")


def combined_gallery(galleries: list[DataFrame], queries: DataFrame, **options) -> DataFrame:
    """The union of several galleries, cleaned against the union of all queries."""
    if not galleries:
        raise GateError("no gallery")
    whole = galleries[0]
    for g in galleries[1:]:
        whole = whole.unionByName(g, allowMissingColumns=True)
    return clean_gallery(whole, queries, **options)[0]


def cohort_summary(manifest: DataFrame) -> DataFrame:
    """One row of counts, with a map of label prevalences sorted by label."""
    labels = manifest.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    n = manifest.agg(
        F.count(F.lit(1)).alias("n_images"), F.count_distinct(present("image_id")).alias("n_unique_image_ids"), F.count_distinct(present("study_id")).alias("n_unique_studies"),
        F.count_distinct(present("patient_id")).alias("n_patients_or_groups"), F.count_distinct(F.when(F.col("patient_reliable"), present("patient_id"))).alias("n_unique_reliable_patients"),
        F.count_if(present("patient_id").isNull()).alias("n_missing_patient_id"), F.count_if(F.col("patient_reliable")).alias("n_reliable"),
        F.count_if(F.size("labels") == 0).alias("n_normal"), F.count_if(F.size("labels") > 0).alias("n_abnormal"), F.count_if(F.size("negated_flags") > 0).alias("n_label_quality_flags"),
    )
    return n.crossJoin(labels)


def composition(manifest: DataFrame, group: str, labels: tuple[str, ...]) -> DataFrame:
    """Rows, normal rows and rows with each label, by group."""
    return manifest.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("labels") == 0).alias("n_normal"), *[F.count_if(F.array_contains("labels", x)).alias("n_" + x.replace(" ", "_")) for x in labels])

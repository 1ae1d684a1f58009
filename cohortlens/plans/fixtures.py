"""The engine's entities built from the plain tables: manifests, vectors of labels, verdicts, messages.

`documents` stands for a manifest of reports, `source` for clusters, hashes of ids for what a corpus of images would add.
The same definitions are given in SQL (see oracles.py), so that results can be checked by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.hashing import draw
from cohortlens.functions.labels import LABELS, negation_flags, normalize_labels
from cohortlens.functions.text import clean, text_hash
from cohortlens.functions.text import normalize as normalize_text

MODELS = ("m1", "m2", "m3")
CONDITIONS = ("A", "B", "C", "D")
FLIPS = {"A": 20, "B": 17, "C": 15, "D": 10}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_labels(doc: Column) -> Column:
    """Upper-case labels with underscores, about a quarter of the 13, and one that isn't known."""
    chosen = F.filter(F.array(*[F.when(draw("r", doc, F.lit(i)) % 100 < 25, x.upper().replace(" ", "_")) for i, x in enumerate(LABELS)]), lambda x: x.isNotNull())
    return F.concat(chosen, F.array(F.lit("OTHER")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, with ids of patients, studies and images, two halves of a hash, and labels."""
    d = F.col("doc_id")
    block = F.floor(d / 4).cast("bigint")
    near = F.pmod(draw("n", block), F.lit(10)) == 0
    base = F.when(near, F.md5(F.concat_ws("|", F.lit("b"), block.cast("string")))).otherwise(F.md5(F.concat_ws("|", F.lit("u"), d.cast("string"))))
    hi = F.conv(F.substring(base, 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(base, 9, 8), 16, 10).cast("bigint")
    flip = F.when(near, F.call_function("shiftleft", F.lit(1).cast("bigint"), (d % 4 * 3).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    dataset = F.when(F.col("lang") == "en", "alpha").otherwise("beta")
    patient = F.when(draw("pm", d) % 50 == 0, None).otherwise(F.concat(F.lit("p"), (draw("p", d) % 5000).cast("string")))
    labels = normalize_labels(raw_labels(d))
    return table(spark, sf_dir, "documents").select(
        d, F.format_string("%s:%08d", dataset, d).alias("record_id"), dataset.alias("dataset"), "source", patient.alias("patient_id"), F.concat(dataset, F.lit(":"), patient).alias("patient_key"),
        (patient.isNotNull() & (draw("rel", d) % 3 != 0)).alias("patient_reliable"), F.concat(F.lit("s"), (draw("s", d) % 4000).cast("string")).alias("study_id"),
        F.concat(F.lit("i"), d.cast("string")).alias("image_id"), F.when(draw("im", d) % 20 == 0, None).otherwise(F.sha2(F.concat(F.lit("img"), (draw("i", d) % 20000).cast("string")), 256)).alias("image_sha256"),
        text_hash(F.col("text")).alias("report_sha256"), hi.alias("hi"), lo.bitwiseXOR(flip).alias("lo"), raw_labels(d).alias("labels_raw"), labels.alias("labels"), clean(F.col("text")).alias("report_text"),
    ).withColumn("negated_flags", negation_flags(normalize_text(findings(d)), F.col("labels")))


def findings(doc: Column) -> Column:
    """A sentence for each label of a document, some of them negated, some too far from the negating word."""
    cues = F.array(F.lit("No evidence of "), F.lit("Free of "), F.lit("There is "), F.lit("Not one two three four five six seven eight "))
    parts = [F.when(draw("r", doc, F.lit(i)) % 100 < 25, F.concat(F.element_at(cues, (draw("c", doc, F.lit(i)) % 4 + 1).cast("int")), F.lit(x))) for i, x in enumerate(LABELS)]
    return F.concat_ws(". And then, after all of this was seen again and once more today: ", *parts)


def gallery_and_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every fifth document is a query, all others are the gallery."""
    rows = manifest(spark, sf_dir)
    return rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, cluster, lang, model, condition, reference, prediction): label vectors of three models in four conditions."""
    d = F.col("doc_id")
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition"), F.lit(FLIPS[c]).alias("flip")) for m in MODELS for c in CONDITIONS]))
    rows = table(spark, sf_dir, "documents").select(d, F.col("source").alias("cluster"), "lang", reference(d).alias("reference"), grid.alias("g"))
    wrong = [(draw("p", F.col("g.model"), F.col("g.condition"), d, F.lit(i)) % 100 < F.col("g.flip")).cast("int") for i in range(len(LABELS))]
    prediction = F.array(*[F.col("reference")[i].bitwiseXOR(w) for i, w in enumerate(wrong)])
    return rows.select(d, "cluster", "lang", "g.model", "g.condition", "reference", prediction.alias("prediction"))


#: Optional metrics of a record: some have no value, a NaN or an infinite one, and whole clusters have none.
MEANS = ("overlap", "similarity")


def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors() with optional metrics: shares of 1024, which any engine adds up alike."""
    value = lambda seed: draw(seed, F.col("model"), F.col("condition"), F.col("doc_id"))
    drawn = vectors(spark, sf_dir).withColumns({"__ov": value("ov"), "__sx": value("sx"), "__sc": draw("sc", F.col("cluster"))})
    overlap = F.when(F.col("__ov") % 10 > 0, F.col("__ov") % 1024 / F.lit(1024.0))
    odd = F.when(F.col("__sx") % 9 == 0, F.lit(float("nan"))).when(F.col("__sx") % 9 == 1, F.lit(float("-inf"))).otherwise(F.col("__sx") % 1024 / F.lit(1024.0))
    return drawn.withColumns({"overlap": overlap, "similarity": F.when(F.col("__sc") % 3 == 0, odd)}).drop("__ov", "__sx", "__sc")


def reference(doc: Column) -> Column:
    return F.array(*[(draw("r", doc, F.lit(i)) % 100 < 25).cast("int") for i in range(len(LABELS))])


def states(doc: Column) -> Column:
    """A map label -> 1, 0, -1 or null, and the state without findings."""
    entries = []
    for i, x in enumerate([*LABELS, "no finding"]):
        k = draw("st", doc, F.lit(i)) % 4
        entries += [F.lit(x), F.when(k == 0, 1).when(k == 1, 0).when(k == 2, -1)]
    return F.create_map(*entries)

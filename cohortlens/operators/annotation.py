"""Two annotators: agreement, chance-corrected agreement, adjudication, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.labels import LABELS
from cohortlens.operators import metrics
from cohortlens.operators.gates import GateError, one_to_one, require_binary_vectors, require_empty, require_unique, set_differences


def kappa(n: Column, both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Cohen's kappa of two binary ratings from counts; null where chance agreement is 1."""
    n = n.cast("double")
    agreed = (both + neither) / n
    chance = (first / n) * (second / n) + (1 - first / n) * (1 - second / n)
    return F.try_divide(agreed - chance, F.when(F.abs(1 - chance) > 1e-12, 1 - chance).otherwise(F.lit(0.0)))


def agreement(pairs: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups..., label, n, agreement, kappa) from rows with vectors `ratings_a` and `ratings_b`."""
    sums = []
    for i in range(len(LABELS)):
        a, b = F.col("ratings_a")[i], F.col("ratings_b")[i]
        sums.append(F.struct(F.sum(a * b).alias("both"), F.sum(a).alias("first"), F.sum(b).alias("second"), F.sum((1 - a) * (1 - b)).alias("neither")).alias(f"x{i}"))
    wide = pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"x{i}").alias("c")) for i, x in enumerate(LABELS)])
    flat = wide.select(*groups, "n", F.explode(rows).alias("r"))
    c = lambda k: F.col(f"r.c.{k}")
    return flat.select(*groups, F.col("r.label").alias("label"), "n", ((c("both") + c("neither")) / F.col("n")).alias("agreement"), kappa(F.col("n"), c("both"), c("first"), c("second"), c("neither")).alias("kappa"))


def joined_forms(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two forms (key, ratings) row by row, both complete and valid; anything else raises."""
    for form in (first, second):
        require_binary_vectors(form, ["ratings"], len(LABELS))
    return one_to_one(first.select(key, "ratings"), second.select(key, "ratings"), [key])


def adjudication_template(pairs: DataFrame, key: str) -> DataFrame:
    """(key, agreed, n_disagreements): the agreed value or null for each label."""
    agreed = F.zip_with("ratings_a", "ratings_b", lambda a, b: F.when(a == b, a))
    return pairs.select(key, agreed.alias("agreed"), F.size(F.filter(agreed, lambda x: x.isNull())).alias("n_disagreements"))


def consensus(template: DataFrame, adjudicated: DataFrame, key: str) -> DataFrame:
    """(key, ratings): agreed cells as they are, the others from the adjudication (key, ratings with nulls allowed).

    An adjudication that changes an agreed cell, or a disagreement that it leaves open, raises when the result is read.
    """
    both = template.join(adjudicated.select(key, F.col("ratings").alias("__decided")), key, "left")
    size = len(LABELS)
    decided = F.coalesce("__decided", F.array_repeat(F.lit(None).cast("int"), size))
    cell = F.zip_with("agreed", decided, lambda a, d: F.when(a.isNotNull() & d.isNotNull() & (a != d), F.lit(-1)).otherwise(F.coalesce(a, d)))
    good = F.forall(cell, lambda x: x.isNotNull() & (x >= 0))
    checked = F.when(F.coalesce(good, F.lit(False)), cell).otherwise(F.raise_error(F.concat(F.lit("open or changed cells in "), F.col(key).cast("string"))).cast("array<int>"))
    return both.select(key, checked.alias("ratings"))


def validate_annotators(first: DataFrame, second: DataFrame, crosswalk: DataFrame, predicted: DataFrame, adjudicated: DataFrame | None = None, key: str = "blinded_id", record: str = "generation_record_id") -> tuple[DataFrame, DataFrame]:
    """(summary, per label) of two annotators' forms (key, annotator_id, ratings and perhaps final_report) and the predictions.

    The summary row has the cells' agreement, the mean kappa of the labels that have one, disagreements, macro F1, sensitivity
    and specificity against the consensus, and the number of labels with an F1. Forms that don't hold exactly the crosswalk's
    ids, equal annotators, a report that isn't the crosswalk's, an adjudicator who is one of the annotators, open disagreements
    and missing predictions raise.
    """
    require_unique(crosswalk, [key])
    require_unique(crosswalk, [record])
    people = []
    for form in (first, second, adjudicated):
        if form is None:
            continue
        require_empty(set_differences(form, crosswalk, [key]), "a form's ids aren't the crosswalk's")
        people.append([r["annotator_id"] for r in form.select("annotator_id").distinct().limit(2).collect()])
        if "final_report" in form.columns and "report_sha256" in crosswalk.columns:
            both = form.select(key, F.sha2(F.coalesce("final_report", F.lit("")), 256).alias("__h")).join(crosswalk.select(key, "report_sha256"), key)
            require_empty(both.where(~F.col("__h").eqNullSafe(F.col("report_sha256"))).select(key), "a report isn't the crosswalk's")
    if any(len(p) != 1 for p in people) or len({p[0] for p in people}) != len(people):
        raise GateError(f"annotators and adjudicator must be different people, one for each form: {people}")
    pairs = joined_forms(first, second, key)
    template = adjudication_template(pairs, key)
    if adjudicated is None:
        require_empty(template.where("n_disagreements > 0").select(key), "disagreements need an adjudication")
        adjudicated = template.select(key, F.lit(None).cast("array<int>").alias("ratings")).limit(0)
    final = consensus(template, adjudicated, key)
    linked = one_to_one(final.join(crosswalk.select(key, record), key).select(record, F.col("ratings").alias("reference")), predicted.select(record, "prediction").join(crosswalk.select(record), record, "left_semi"), [record])
    labels = metrics.per_label(linked.select(F.col("reference_a").alias("reference"), F.col("prediction_b").alias("prediction")), [])
    rated = agreement(pairs)
    labels = labels.join(rated.select("label", "agreement", "kappa"), "label")
    cells = rated.agg((F.sum(F.col("agreement") * F.col("n")) / F.sum("n")).alias("cell_agreement"), F.avg("kappa").alias("macro_kappa"), F.sum(F.round((1 - F.col("agreement")) * F.col("n"))).cast("long").alias("n_disagreements"), F.max("n").alias("n"))
    scores = labels.agg(F.avg("f1").alias("macro_f1"), F.avg("sensitivity").alias("macro_sensitivity"), F.avg("specificity").alias("macro_specificity"), F.count("f1").alias("n_defined_f1"))
    return cells.crossJoin(scores), labels


def validate_single(human: DataFrame, predicted: DataFrame, record: str = "generation_record_id") -> DataFrame:
    """Per-label validation against one complete form (record, ratings); a missing prediction raises."""
    require_binary_vectors(human, ["ratings"], len(LABELS))
    linked = one_to_one(human.select(record, "ratings"), predicted.select(record, "prediction").join(human.select(record), record, "left_semi"), [record])
    return metrics.per_label(linked.select(F.col("ratings_a").alias("reference"), F.col("prediction_b").alias("prediction")), [])


def validation_gate(per_label: DataFrame, n: int, least_n: int = 200, least_f1: float = 0.8, annotators: int = 2) -> float:
    """The macro F1 over the 13 labels, which must all be defined; too few records or annotators or too low a value raises."""
    found = per_label.agg(F.avg("f1").alias("macro"), F.count("f1").alias("defined")).first()
    if n < least_n or annotators < 2 or found["defined"] != len(LABELS) or found["macro"] < least_f1:
        raise GateError(f"{n} records, {annotators} annotators, {found['defined']} labels, macro F1 {found['macro']}")
    return found["macro"]


def merged_ratings(first: DataFrame, second: DataFrame, keys: list[str], fields: list[str], adjudicated: DataFrame | None = None) -> DataFrame:
    """(keys..., fields...) of two reviewers' numeric ratings: equal ones as they are, others from the adjudication, else null.
    Forms must hold the same keys, each once."""
    pairs = one_to_one(first.select(*keys, *fields), second.select(*keys, *fields), keys)
    if adjudicated is not None:
        pairs = pairs.join(adjudicated.select(*keys, *[F.col(f).alias(f"{f}_c") for f in fields]), keys, "left")
    value = lambda f: F.when(F.col(f"{f}_a") == F.col(f"{f}_b"), F.col(f"{f}_a")).otherwise(F.col(f"{f}_c") if adjudicated is not None else F.lit(None))
    return pairs.select(*keys, *[value(f).alias(f) for f in fields])


def rating_means(ratings: DataFrame, crosswalk: DataFrame, keys: list[str], condition: str, fields: list[str]) -> DataFrame:
    """Mean ratings by condition, as the crosswalk unblinds them; an open rating raises."""
    require_empty(ratings.where(" or ".join(f"`{f}` is null" for f in fields)), "ratings are still open")
    return one_to_one(ratings, crosswalk.select(*keys, condition), keys).groupBy(F.col(f"{condition}_b").alias(condition)).agg(*[F.avg(f"{f}_a").alias(f) for f in fields])


def labeled_export(crosswalk: DataFrame, predicted: DataFrame, keys: list[str], record: str) -> DataFrame:
    """The crosswalk's rows with their labels, a column each, for a CSV; a record without exactly one prediction raises."""
    found = one_to_one(crosswalk, predicted.select(record, "prediction").join(crosswalk.select(record), record, "left_semi"), [record])
    return found.select(*[F.col(c if c == record else f"{c}_a").alias(c) for c in [*keys, record]], *[F.col("prediction_b")[i].alias(x.replace(" ", "_")) for i, x in enumerate(LABELS)])

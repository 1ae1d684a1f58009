"""Audits of result logs against what was planned: each returns the rows in question with their problems, or raises for them.

A log is compared with its plan by joins on keys; nothing but a few examples reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.labels import label_vector, total
from cohortlens.functions.nested import dropped
from cohortlens.operators.gates import require_empty

# Fixed value: where reference labels must come from.
LABEL_SOURCE = "paired_json.labels"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def marked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`rows` with `problems`: the names of the rules that they meet, in the order of the rules."""
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(met, F.lit(False)), name) for name, met in rules.items()])))


def generation_id(*parts: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


IDENTITY = ("model_key", "bundle", "query_record_id", "condition")


def _planned(queries: DataFrame, models: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every (model_key, bundle, query_record_id, condition): what a plan asks for."""
    return queries.select("bundle", "query_record_id").crossJoin(models.select("model_key")).crossJoin(conditions.select("condition"))


def checked_generations(log: DataFrame, queries: DataFrame, runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """The rows of a generation log with `problems` and their reference vectors.

    queries: (bundle, query_record_id, dataset, labels), the labels as the source states them; runs: (model_key, bundle,
    run_id); conditions: (condition). The log has the identity columns, generation_record_id, run_id, source_dataset,
    final_report, empty_output, ground_truth_source, reference_labels_json and perhaps reference_labels_13_manifest_check.
    Null labels are missing ones, empty labels mean none.
    """
    source = queries.select("bundle", "query_record_id", F.col("dataset").alias("__dataset"), label_vector(F.col("labels")).alias("reference_vector"))
    both = log.join(source, ["bundle", "query_record_id"], "left").join(runs.select("model_key", "bundle", F.col("run_id").alias("__run")), ["model_key", "bundle"], "left")
    both = both.join(conditions.select(F.col("condition").alias("__condition")), F.col("condition") == F.col("__condition"), "left")
    known = F.col("reference_vector").isNotNull() & F.col("__dataset").isNotNull()
    rules = {
        "unknown_run": blank(F.col("__run")), "unknown_query": ~known, "unknown_condition": F.col("__condition").isNull(),
        "id_mismatch": differs(F.col("generation_record_id"), generation_id(*IDENTITY)), "run_mismatch": differs(F.col("run_id"), F.col("__run")),
        "dataset_mismatch": known & differs(F.col("source_dataset"), F.col("__dataset")), "empty_report": blank(F.col("final_report")) | F.coalesce("empty_output", F.lit(False)),
        "label_source": differs(F.col("ground_truth_source"), F.lit(LABEL_SOURCE)), "labels_missing": F.col("reference_labels_json").isNull(),
        "labels_differ": known & F.col("reference_labels_json").isNotNull() & differs(label_vector(F.col("reference_labels_json")), F.col("reference_vector")),
    }
    if "reference_labels_13_manifest_check" in log.columns:
        own = F.col("reference_labels_13_manifest_check")
        rules["manifest_labels_differ"] = known & own.isNotNull() & differs(label_vector(own), F.col("reference_vector"))
    kept = [c for c in log.columns if c != "final_report"]
    return marked(both, rules).select(*kept, F.trim("final_report").alias("final_report"), "reference_vector", (total(F.col("reference_vector")) > 0).alias("reference_abnormal"), "problems")


# Fields of timing, in which equivalent rows may differ.
RUNTIME_FIELDS = ("generation_seconds_by_pass", "total_generation_seconds", "total_verifier_seconds", "seconds", "attempt_seconds")


def without_runtime(raw: Column) -> Column:
    """JSON text without the fields of timing, at any depth."""
    return dropped(raw, RUNTIME_FIELDS)


def _content(log: DataFrame) -> Column:
    """A row as JSON text without fields of timing; only columns of nested types are parsed again."""
    kept = [c for c in sorted(log.columns) if c not in RUNTIME_FIELDS]
    nested = any(t.startswith(("struct", "array", "map", "variant")) for c, t in log.dtypes if c in kept)
    text = F.to_json(F.struct(*kept))
    return without_runtime(text) if nested else text


def generation_problems(log: DataFrame, queries: DataFrame, models: DataFrame, runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """(generation_record_id, problem): everything that keeps a log from being the complete experiment. Rows that repeat an id
    are a problem (`conflicting`) unless they are equal but for timing."""
    checked = checked_generations(log, queries, runs, conditions)
    wrong = checked.select("generation_record_id", F.explode("problems").alias("problem")).distinct()
    planned = _planned(queries, models, conditions).select(generation_id(*IDENTITY).alias("generation_record_id"))
    missing = planned.join(log.select("generation_record_id").distinct(), "generation_record_id", "left_anti").withColumn("problem", F.lit("missing"))
    extra = log.select("generation_record_id").distinct().join(planned, "generation_record_id", "left_anti").withColumn("problem", F.lit("unexpected"))
    content = log.select("generation_record_id", F.xxhash64(_content(log)).alias("content"))
    repeated = content.groupBy("generation_record_id").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("generation_record_id", F.lit("conflicting").alias("problem"))
    return reduce(DataFrame.unionByName, (wrong, missing, extra, repeated))


def complete_generations(log: DataFrame, queries: DataFrame, models: DataFrame, runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """The log with reference vectors, each id once (of rows that differ in timing alone always the same one); any problem raises."""
    require_empty(generation_problems(log, queries, models, runs, conditions), "the experiment isn't complete")
    once = log.groupBy("generation_record_id").agg(F.min_by(F.struct(*log.columns), F.to_json(F.struct(*log.columns))).alias("row")).select("row.*")
    return checked_generations(once, queries, runs, conditions).drop("problems")


def resumable(log: DataFrame, model: str, bundle: str, run_id: str, queries: DataFrame, conditions: DataFrame, repair: bool = False) -> tuple[DataFrame, DataFrame]:
    """(generation_record_id of what is done, rows of failed ones) of one run's log.

    Rows of another model, bundle or run, unknown queries or conditions, wrong ids and repeated valid ids raise. Failed rows
    (no report, or flagged as empty) raise too unless they are to be repeated.
    """
    both = log.join(queries.select("query_record_id", F.lit(True).alias("__q")).distinct(), "query_record_id", "left").join(conditions.select("condition", F.lit(True).alias("__c")).distinct(), "condition", "left")
    wanted = F.concat_ws("|", F.lit(model), F.lit(bundle), "query_record_id", "condition")
    rules = {
        "another_model": differs(F.col("model_key"), F.lit(model)), "another_bundle": differs(F.col("bundle"), F.lit(bundle)), "another_run": differs(F.col("run_id"), F.lit(run_id)),
        "unknown_query": F.col("__q").isNull(), "unknown_condition": F.col("__c").isNull(), "id_mismatch": differs(F.col("generation_record_id"), wanted),
    }
    rows = marked(both, rules)
    require_empty(rows.where("size(problems) > 0").select("generation_record_id", "problems"), "the log holds other rows")
    failed = blank(F.col("final_report")) | F.coalesce("empty_output", F.lit(False))
    lost = rows.where(failed).select(*log.columns, F.when(blank(F.col("final_report")), "empty_final_report").otherwise("empty_output_flag").alias("reason"))
    if not repair:
        require_empty(lost.select("generation_record_id", "reason"), "failed rows aren't done")
    done = rows.where(~failed).select("generation_record_id")
    require_empty(done.groupBy("generation_record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated ids")
    return done, lost


def prediction_problems(saved: DataFrame, expected: DataFrame) -> DataFrame:
    """(verifier_record_id, problem) of saved predictions (verifier_record_id, truth, patient_or_source_group, verdict) against
    the test records (verifier_record_id, verdict, patient_or_source_group)."""
    own = expected.select("verifier_record_id", F.col("verdict").alias("__truth"), F.col("patient_or_source_group").alias("__group"), F.lit(True).alias("__known"))
    known = F.col("__known").isNotNull()
    rules = {"unknown": ~known, "truth": known & differs(F.col("truth"), F.col("__truth")), "group": known & differs(F.col("patient_or_source_group"), F.col("__group")), "unparseable": F.col("verdict").isNull()}
    rows = marked(saved.join(own, "verifier_record_id", "left"), rules).select("verifier_record_id", F.explode("problems").alias("problem")).distinct()
    repeated = saved.groupBy("verifier_record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("verifier_record_id", F.lit("repeated").alias("problem"))
    return rows.unionByName(repeated)


FROZEN = ("reference_vector", "evidence_sha256", "runtime_sha256")


def frame_problems(rows: DataFrame, expected: DataFrame, key: str = "generation_record_id", frozen: tuple[str, ...] = FROZEN) -> DataFrame:
    """(key, problem): ids that are missing, unexpected or repeated, and rows that differ from the frozen columns of `expected`."""
    own = expected.select(key, F.lit(True).alias("__planned"), *[F.col(c).alias(f"__{c}") for c in frozen])
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    both = rows.join(counted, key).withColumn("__there", F.lit(True)).join(own, key, "full_outer")
    planned, there = F.col("__planned").isNotNull(), F.col("__there").isNotNull()
    rules = {"missing": ~there, "unexpected": ~planned, "repeated": F.col("__n") > 1} | {f"{c}_differs": planned & there & differs(F.col(c), F.col(f"__{c}")) for c in frozen}
    return marked(both, rules).select(key, F.explode("problems").alias("problem")).distinct()


def recovery_counts(rows: DataFrame, strata: list[str], retries: Column) -> DataFrame:
    """(strata..., n_records, records_retried, passes_retried) from the number of retried passes of each record."""
    counted = rows.withColumn("__retries", F.coalesce(retries.cast("long"), F.lit(0)))
    return counted.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("__retries") > 0).alias("records_retried"), F.sum("__retries").alias("passes_retried"))


def selected_cases(rows: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """The rows of the listed cases; a case without a row, or with several, raises."""
    found = rows.join(cases.select(key).distinct(), key, "left_semi")
    counted = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    require_empty(cases.select(key).distinct().join(counted, key, "left").where(F.coalesce("n", F.lit(0)) != 1), "cases without exactly one row")
    return found


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of some columns of few values occurs."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(rows).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))

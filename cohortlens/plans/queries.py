"""The registered queries: each composes the engine's operators over the plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import labels as L
from cohortlens.functions import prompts as P
from cohortlens.functions import text as X
from cohortlens.functions.hashing import draw
from cohortlens.operators import annotation, audits, cohort, experiment, gates, inference, manifest as M, metrics, multiplicity, records, resampling, retrieval, revision, sampling, scoring, text_metrics, transitions
from cohortlens.plans.fixtures import CONDITIONS, MEANS, MODELS, findings, gallery_and_queries, manifest, raw_labels, scored_vectors, states, table, vectors
from cohortlens.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
REPLICATES = 10_000
STRATUM = ["model", "condition"]
SUMS = metrics.sums(MEANS)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: sums in another order differ in the last ones, and 0 has one sign."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(column: str) -> Column:
    return F.array_join(column, ",")


def every(of) -> dict[str, Column]:
    """All metrics, the optional ones included."""
    return metrics.metrics(of, MEANS)


# Scalar functions


@query
def norm_text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.char_length(X.normalize(F.col("text"))).alias("n_normal"), X.text_hash(F.col("text")).alias("report_hash"), F.sha2("text", 256).alias("raw_hash"))


@query
def label_vector(spark, sf):
    known = L.normalize_labels(raw_labels(F.col("doc_id")))
    return table(spark, sf, "documents").select("doc_id", joined(known).alias("known"), F.array_join(F.transform(L.label_vector(known, strict=True), lambda x: x.cast("string")), "").alias("vector"))


@query
def negation_flags(spark, sf):
    flags = L.negation_flags(X.normalize(findings(F.col("doc_id"))), L.normalize_labels(raw_labels(F.col("doc_id"))))
    return table(spark, sf, "documents").select("doc_id", joined(flags).alias("flags"))


@query
def state_mapping(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(L.vector_of_states(states(F.col("doc_id"))), lambda x: x.cast("string")), "").alias("vector"))


@query
def chat_normalize(spark, sf):
    c = table(spark, sf, "conversations")
    role = F.when(F.col("role") == "user", " Human").when(F.col("role") == "assistant", "GPT").otherwise(F.col("role"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content")))).alias("m"))
    messages = rows.select("conv_id", X.chat_messages(F.col("m")).alias("m"))
    count = lambda r: F.size(F.filter("m", lambda x: x["role"] == r))
    return messages.select("conv_id", F.size("m").alias("n"), count("user").alias("n_user"), count("assistant").alias("n_assistant"), F.md5(X.last_content(F.col("m"), "assistant")).alias("last_answer"))


@query
def verdict_words(spark, sf):
    d = F.col("doc_id")
    words = F.array(*[F.lit(x) for x in ("TRUE", "answer: false", "Supported", "0", "label = true", "false, then true", "untrue")])
    word = F.element_at(words, (draw("v", d) % 7 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", X.parse_target(word, strict=False).alias("target"), X.parse_verdict(word).alias("verdict"))


@query
def stable_key(spark, sf):
    d = F.col("doc_id")
    cols = {"record_id": F.when(draw("k", d) % 3 == 0, F.concat(F.lit("r"), d.cast("string"))).otherwise(F.lit(" ")), "image_path": F.when(draw("k", d) % 3 == 1, F.concat(F.lit("/x/"), d.cast("string"))), "study_id": F.col("source")}
    return table(spark, sf, "documents").select("doc_id", X.stable_key(cols).alias("key"))


@query
def verifier_records(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    k, doc = draw("rec", F.col("doc_id")) % 4, F.col("doc_id").cast("string")
    words = F.when(F.col("quality") == 1, "TRUE").otherwise("answer: false")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    shape = [
        F.to_json(F.struct(F.concat(F.lit("id"), doc).alias("id"), F.col("text").alias("report"), F.col("source").alias("patient_id"), F.col("quality").alias("label"))),
        F.to_json(F.struct(F.col("text").alias("input"), F.struct(F.col("source").alias("subject_id")).alias("meta"), F.struct(words.alias("answer")).alias("ground_truth"))),
        F.to_json(F.struct(F.concat(F.lit("f"), doc).alias("file_name"), F.array(message("Human", part.cast("string")), message("gpt", words)).alias("messages"))),
        F.to_json(F.struct(F.concat(F.lit("u"), doc).alias("uid"), F.to_json(F.array(F.struct(F.lit("user").alias("role"), part.alias("content")), )).alias("harmony_prompt"), words.alias("verdict"))),
    ]
    raw = F.when(k == 0, shape[0]).when(k == 1, shape[1]).when(k == 2, shape[2]).otherwise(shape[3])
    found = records.standardize(d.select(raw.alias("raw")))
    return found.groupBy("grouping_level", "verdict_source", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_or_source_group").alias("n_groups"))


# Retrieval: every vector whose id is divisible by 20, against all vectors


METADATA = ("record_id", "study_id", "image_id", "image_sha256", "report_sha256", "patient_id", "patient_key", "hi", "lo")


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    v = retrieval.l2_normalize(F.col("embedding"))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), v.alias("q")), e.select(F.col("vec_id").alias("gallery_id"), v.alias("g"))


def _described(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Both sides with the manifest's fields of the document of the same number."""
    named = manifest(spark, sf).select("doc_id", *METADATA)
    of = lambda df, t: df.join(named.toDF(f"{t}_id", *[f"{t}_{c}" for c in METADATA]), f"{t}_id", "left")
    queries, gallery = _sides(spark, sf)
    return of(queries, "query"), of(gallery, "gallery")


@query
def safe_topk_retrieval(spark, sf):
    return rounded(retrieval.safe_top_k(*_described(spark, sf), 10))


@query
def raw_topk(spark, sf):
    queries, gallery = _sides(spark, sf)
    return rounded(retrieval.top_k(queries, gallery, 10))


@query
def rank1_review(spark, sf):
    queries, gallery = _sides(spark, sf)
    return rounded(retrieval.for_review(retrieval.top_k(queries, gallery, 1)))


@query
def retrieval_bundles(spark, sf):
    """Three galleries in one search: the vectors of even and of odd numbers, and all of them."""
    queries, gallery = _described(spark, sf)
    bundle = lambda k: F.explode(F.array(F.when(F.col(k) % 2 == 0, "even").otherwise("odd"), F.lit("all")))
    queries = queries.withColumn("query_bundle", F.explode(F.array(F.lit("even"), F.lit("odd"), F.lit("all")))).withColumn("query_id", F.concat_ws("|", "query_bundle", "query_id"))
    return rounded(retrieval.safe_top_k(queries, gallery.withColumn("gallery_bundle", bundle("gallery_id")), 5, within="bundle"))


@query
def neighbor_audit(spark, sf):
    """The unfiltered neighbours, one of which is the query itself, against the rules."""
    queries, gallery = _described(spark, sf)
    found = retrieval.top_k(queries, gallery, 10)
    return retrieval.neighbor_audit(queries, found, gallery, 10).select("query_id", "n_neighbors", joined("reasons").alias("reasons"))


@query
def neighbor_content(spark, sf):
    d = manifest(spark, sf).select("record_id", "doc_id", "study_id", "report_sha256")
    saved = d.where("doc_id % 3 = 0").withColumn("study_id", F.when(draw("nc", F.col("doc_id")) % 10 == 0, F.lit("s")).otherwise(F.col("study_id")))
    found = retrieval.content_differences(saved, d.where("doc_id % 50 <> 0"), "record_id")
    return found.select("record_id", joined("differing").alias("differing"))


def _evidence(spark, sf) -> DataFrame:
    """(query_id, n_neighbors, evidence): the whole reports of ten neighbours."""
    names = table(spark, sf, "documents").select(F.col("doc_id").alias("gallery_id"), X.clean(F.col("text")).alias("report_text"))
    near = retrieval.safe_top_k(*_described(spark, sf), 10).join(names, "gallery_id", "left")
    rows = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 3).alias("score"), "report_text", F.lit("").alias("report"), F.lit("").alias("caption")))).alias("n"))
    return rows.select("query_id", F.size("n").alias("n_neighbors"), X.evidence_block(F.col("n")).alias("evidence"))


@query
def evidence_prompt(spark, sf):
    return _evidence(spark, sf).select("query_id", "n_neighbors", F.sha2("evidence", 256).alias("prompt_hash"))


@query
def prompts(spark, sf):
    """The six prompts over each document's text as evidence and its source as the report."""
    text, report, k = X.clean(F.col("text")), F.col("source"), (F.col("doc_id") % 4 + 1)
    made = {
        "first": P.first_prompt(text), "first_neutral": P.first_prompt(text, True), "revision": P.revision_prompt(report, text, k), "revision_neutral": P.revision_prompt(report, text, k, True),
        "verifier": P.verifier_prompt(report, F.when(F.col("doc_id") % 2 == 0, text)), "recovery": X.shortened(P.first_prompt(text), 1200, P.RECOVERY, P.OMISSION),
    }
    return table(spark, sf, "documents").select("doc_id", *[F.md5(c).alias(n) for n, c in made.items()])


# Cohorts


@query
def overlap_audit_counts(spark, sf):
    return cohort.overlap_audit(*gallery_and_queries(spark, sf)).select("field", "n_overlap", joined("examples").alias("examples"))


@query
def gallery_clean(spark, sf):
    return cohort.clean_gallery(*gallery_and_queries(spark, sf))[0].select("record_id", "report_sha256")


@query
def gallery_removed(spark, sf):
    return cohort.clean_gallery(*gallery_and_queries(spark, sf))[1].select("record_id", joined("reasons").alias("reasons"))


@query
def removal_reason_counts(spark, sf):
    return cohort.reason_counts(cohort.clean_gallery(*gallery_and_queries(spark, sf))[1])


@query
def near_hash_pairs(spark, sf):
    rows = manifest(spark, sf).select(F.col("doc_id").alias("id"), "hi", "lo")
    return cohort.near_hash_pairs(rows, rows).where("id_a < id_b")


@query
def cohort_summary(spark, sf):
    found = cohort.cohort_summary(manifest(spark, sf))
    text = F.array_join(F.transform(F.map_entries("label_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select(*[c for c in found.columns if c != "label_counts"], text.alias("label_counts"))


@query
def eval_overlap(spark, sf):
    rows = manifest(spark, sf)
    training = rows.where("doc_id % 5 <> 0").select("record_id", F.coalesce("patient_id", "study_id").alias("patient_or_source_group"), "patient_id", F.col("study_id").alias("source_record_id"), "report_sha256")
    return cohort.evaluation_overlap(training, rows.where("doc_id % 5 = 0")).where("size(reasons) > 0").select("record_id", joined("reasons").alias("reasons"))


@query
def align_unique(spark, sf):
    d = table(spark, sf, "documents")
    left = d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    right = d.select(F.col("doc_id").alias("vector_id"), F.concat(F.lit("/other/place/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return cohort.align_unique(left, right, [], ["path"])


@query
def align_by_position(spark, sf):
    d = table(spark, sf, "documents")
    left = d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), "doc_id")
    right = d.select((-F.col("doc_id")).alias("vector_id"), "doc_id")
    return cohort.align_by_position(left, right, "doc_id", "doc_id")


@query
def reordered_gallery(spark, sf):
    rows = manifest(spark, sf).select("record_id", "doc_id", "study_id")
    return cohort.reordered(rows.select("record_id", "study_id"), "record_id", rows.where("doc_id % 3 = 0").select("record_id", (F.lit(10**9) - F.col("doc_id")).alias("position")))


@query
def combined_gallery(spark, sf):
    g, q = gallery_and_queries(spark, sf)
    return cohort.combined_gallery([g.where("dataset = 'alpha'"), g.where("dataset = 'beta'")], q).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("study_id").alias("n_studies"))


# Metrics


@query
def label_metrics_by_group(spark, sf):
    return rounded(metrics.grouped_metrics(scored_vectors(spark, sf), STRATUM, MEANS))


@query
def per_label_confusion(spark, sf):
    return rounded(metrics.per_label(vectors(spark, sf), ["model"]))


@query
def verifier_confusion(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("truth"), F.when(draw("vm", F.col("doc_id")) % 20 > 0, (draw("v", F.col("doc_id")) % 10 < 8) == (F.col("quality") == 1)).alias("verdict"))
    return rounded(metrics.binary_confusion(rows, "truth", "verdict", ["lang"]))


@query
def runtime_summary(spark, sf):
    return rounded(metrics.runtime_summary(table(spark, sf, "events"), "value", ["event_type"]))


@query
def timing_quantiles(spark, sf):
    return rounded(metrics.timing_quantiles(table(spark, sf, "events"), "value", ["event_type"]))


@query
def cohort_composition(spark, sf):
    return cohort.composition(manifest(spark, sf), "dataset", L.LABELS)


# Pairs and transitions


def _pairs(spark, sf) -> DataFrame:
    return transitions.paired(vectors(spark, sf), "condition", "A", "D", ["model", "doc_id"], ["reference", "cluster", "lang"])


def _joint(spark, sf) -> DataFrame:
    return transitions.joint_rows(vectors(spark, sf), ["model", "lang", "cluster", "doc_id"], "condition", ("B", "C", "D"))


@query
def paired_arms(spark, sf):
    p = _pairs(spark, sf).withColumn("ea", L.errors(F.col("reference"), F.col("prediction_a"))).withColumn("eb", L.errors(F.col("reference"), F.col("prediction_b")))
    return p.groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("ea").alias("errors_a"), F.sum("eb").alias("errors_b"))


@query
def error_transitions(spark, sf):
    return transitions.error_transitions(vectors(spark, sf), ["model", "lang"], "doc_id", "condition", "A")


@query
def resolved_introduced(spark, sf):
    return transitions.resolved_introduced(_pairs(spark, sf), ["model", "lang"])


@query
def ensemble_vote(spark, sf):
    voted = transitions.majority_vote(vectors(spark, sf), ["doc_id", "condition"], "model", list(MODELS))
    return rounded(metrics.grouped_metrics(voted, ["condition"]))


@query
def best_single(spark, sf):
    return rounded(transitions.best_single(metrics.grouped_metrics(vectors(spark, sf), STRATUM), ["condition"], "model", "macro_f1"))


@query
def joint_rescue_counts(spark, sf):
    counts = transitions.joint_counts(_joint(spark, sf), ["model", "lang"])
    sums = counts.groupBy("model", "lang").agg(*[F.sum(c).cast("long").alias(c) for c in transitions.JOINT_COUNTS])
    return rounded(sums.select("*", *[c.alias(k) for k, c in transitions.joint_rates().items()]))


@query
def joint_rescue_by_label(spark, sf):
    return transitions.joint_by_label(_joint(spark, sf), ["model"]).groupBy("model", "label").agg(F.sum("rescue").alias("rescue"), F.sum("harm").alias("harm"))


# Inference


def _clusters(spark, sf) -> DataFrame:
    return metrics.totals(scored_vectors(spark, sf), [*STRATUM, "cluster"], means=MEANS)


def _arms(spark, sf, first: str = "A", second: str = "D") -> DataFrame:
    """Cluster totals of two conditions side by side: a_* and b_*."""
    stats = _clusters(spark, sf).where(F.col("condition").isin(first, second))
    side = [F.max(F.when(F.col("condition") == c, F.col(n))).alias(f"{t}_{n}") for t, c in (("a", first), ("b", second)) for n in SUMS]
    return stats.groupBy("model", "cluster").agg(*side)


def _joint_clusters(spark, sf, groups: list[str]) -> DataFrame:
    return transitions.cluster_counts(transitions.joint_counts(_joint(spark, sf), ["model", "lang", "cluster"]), groups, "cluster")


@query
def cluster_stats(spark, sf):
    return _clusters(spark, sf)


@query
def cluster_bootstrap_ci(spark, sf):
    return rounded(resampling.bootstrap(_clusters(spark, sf), STRATUM, "cluster", SUMS, every, REPLICATES))


@query
def paired_bootstrap_diff(spark, sf):
    return rounded(resampling.paired_bootstrap(_arms(spark, sf), ["model"], "cluster", SUMS, every, REPLICATES))


@query
def paired_permutation_p(spark, sf):
    return rounded(resampling.paired_permutation(_arms(spark, sf), ["model"], "cluster", SUMS, every, REPLICATES))


@query
def sign_flip_p(spark, sf):
    nets = _joint_clusters(spark, sf, ["model"]).select("model", "cluster", (F.col("event_rescue") - F.col("event_harm")).alias("event_net"), (F.col("strict_rescue") - F.col("strict_harm")).alias("strict_net"))
    return rounded(resampling.sign_flip(nets, ["model"], "cluster", ["event_net", "strict_net"], REPLICATES))


@query
def joint_rates_ci(spark, sf):
    return rounded(resampling.bootstrap(_joint_clusters(spark, sf, ["model"]), ["model"], "cluster", list(transitions.JOINT_COUNTS), transitions.joint_rates, REPLICATES))


@query
def joint_label_ci(spark, sf):
    counts = transitions.joint_by_label(_joint(spark, sf), ["cluster"]).groupBy("label", "cluster").agg(F.sum("rescue").alias("rescue"), F.sum("harm").alias("harm"), F.count(F.lit(1)).alias("n_records"))
    rates = lambda of: {"rescue_rate": metrics.ratio(of("rescue"), of("n_records")), "harm_rate": metrics.ratio(of("harm"), of("n_records")), "net_rate": metrics.ratio(of("rescue") - of("harm"), of("n_records"))}
    ci = resampling.bootstrap(counts, ["label"], "cluster", ["rescue", "harm", "n_records"], rates, REPLICATES)
    flips = resampling.sign_flip(counts.withColumn("net", F.col("rescue") - F.col("harm")), ["label"], "cluster", ["net"], REPLICATES)
    adjusted = multiplicity.holm(flips.withColumn("family", F.lit("labels")), "p_value", ["family"], ["label"])
    return rounded(ci.join(adjusted.select("label", "p_value", "p_holm"), "label"))


@query
def between_model_tests(spark, sf):
    stats = _clusters(spark, sf).where("condition = 'D'")
    a, b = (stats.select(F.col("model").alias(m), "cluster", *[F.col(c).alias(f"{t}_{c}") for c in SUMS]) for t, m in (("a", "first"), ("b", "second")))
    pairs = a.join(b, "cluster").where("first < second")
    tests = resampling.paired_permutation(pairs, ["first", "second"], "cluster", SUMS, every, REPLICATES)
    return rounded(multiplicity.holm(tests, "p_value", ["metric"], ["first", "second"]))


@query
def pooled_joint(spark, sf):
    pooled = _joint_clusters(spark, sf, []).withColumn("scope", F.lit("all models"))
    return rounded(resampling.bootstrap(pooled, ["scope"], "cluster", list(transitions.JOINT_COUNTS), transitions.joint_rates, REPLICATES))


def _p_values(spark, sf) -> DataFrame:
    """A list of tests: one for each source, language and event kind, with a p-value drawn by hash; one in ten is missing."""
    d = table(spark, sf, "documents").select("source", "lang").distinct()
    u = (draw("pv", F.col("source"), F.col("lang")) % 10_000 + 1) / F.lit(10_000.0)
    return d.select("source", "lang", F.when(draw("pm", F.col("source"), F.col("lang")) % 10 > 0, F.round(u * u * u, 6)).alias("p_value"))


@query
def holm_within(spark, sf):
    return rounded(multiplicity.holm(_p_values(spark, sf), "p_value", ["lang"], ["source"]))


@query
def holm_between(spark, sf):
    """Holm over contrasts and models together, by metric."""
    arms = inference.contrast_arms(_clusters(spark, sf), ["model"], "cluster", "condition", inference.CONTRASTS, SUMS)
    tests = resampling.paired_permutation(arms, ["contrast", "model"], "cluster", SUMS, every, REPLICATES)
    return rounded(multiplicity.holm(tests.select("contrast", "model", "metric", "p_value"), "p_value", ["metric"], ["contrast", "model"]))


@query
def within_model_tests(spark, sf):
    return rounded(inference.within_model(_clusters(spark, sf), ["model"], "cluster", "condition", every, n=REPLICATES, sums=SUMS))


@query
def five_contrast_family(spark, sf):
    return rounded(inference.five_contrasts(_clusters(spark, sf), ["model"], "cluster", "condition", every, REPLICATES, sums=SUMS))


@query
def added_contrast_summary(spark, sf):
    return rounded(inference.contrast_summary(inference.five_contrasts(_clusters(spark, sf), ["model"], "cluster", "condition", every, REPLICATES, sums=SUMS), "B-C", ["metric"]))


@query
def ensemble_tests(spark, sf):
    v = vectors(spark, sf)
    voted = transitions.majority_vote(v, ["doc_id", "condition", "cluster"], "model", list(MODELS))
    singles = metrics.totals(v, ["condition", "model", "cluster"])
    return rounded(inference.ensemble_tests(singles, metrics.totals(voted, ["condition", "cluster"]), ["condition"], "model", "cluster", metrics.metrics, REPLICATES))


@query
def joint_stratum_summary(spark, sf):
    counts = transitions.joint_counts(_joint(spark, sf), ["model", "lang", "cluster"])
    clusters = transitions.cluster_counts(counts, ["model", "lang"], "cluster").withColumn("family", F.lit("strata"))
    return rounded(inference.joint_summary(clusters, ["family", "model", "lang"], "cluster", ["family"], REPLICATES).drop("family"))


@query
def pooled_joint_summary(spark, sf):
    counts = transitions.joint_counts(_joint(spark, sf), ["model", "cluster"])
    return rounded(inference.pooled_summary(counts, "model", "cluster", REPLICATES))


def _analysis(spark, sf) -> inference.Analysis:
    """Arms: conditions A and B without, C and D with the image; strategies: A and C in one pass, B and D revised."""
    arm, strategy = F.when(F.col("condition").isin("A", "B"), "text").otherwise("image"), F.when(F.col("condition").isin("A", "C"), "single").otherwise("revised")
    rows = scored_vectors(spark, sf).select("model", strategy.alias("strategy"), arm.alias("arm"), "doc_id", "cluster", "reference", "prediction", *MEANS)
    return inference.analyze(rows, ["model", "strategy"], "arm", "text", "image", "doc_id", "cluster", every, F.col("strategy") == "single", REPLICATES, means=MEANS)


@query
def analysis_estimates(spark, sf):
    return rounded(_analysis(spark, sf).estimates)


@query
def analysis_effects(spark, sf):
    return rounded(_analysis(spark, sf).effects)


@query
def analysis_transitions(spark, sf):
    return _analysis(spark, sf).transitions


@query
def analysis_cases(spark, sf):
    return _analysis(spark, sf).cases


@query
def holm_with_missing(spark, sf):
    return rounded(multiplicity.holm(_p_values(spark, sf), "p_value", ["lang"], ["source"], count_missing=True))


@query
def contrast_summary(spark, sf):
    tests = multiplicity.holm(_p_values(spark, sf), "p_value", ["lang"], ["source"]).withColumn("difference", F.round(draw("df", F.col("source"), F.col("lang")) % 2001 / F.lit(1000.0) - 1, 3))
    summary = tests.groupBy("lang").agg(F.count(F.lit(1)).alias("n_strata"), F.count_if(F.col("p_holm") < 0.05).alias("n_significant"), F.count_if(F.col("difference") > 0).alias("n_better"), F.count_if(F.col("difference") < 0).alias("n_worse"), F.median("difference").alias("median_difference"), F.min("difference").alias("min_difference"), F.max("difference").alias("max_difference"))
    return rounded(summary)


@query
def model_pairs(spark, sf):
    rows = metrics.grouped_metrics(vectors(spark, sf), ["model"]).select("model", "macro_f1")
    a, b = rows.toDF("first", "f"), rows.toDF("second", "s")
    return rounded(a.join(b, F.col("first") < F.col("second")).select("first", "second", (F.col("s") - F.col("f")).alias("difference")))


# Sampling and annotation


@query
def grouped_split(spark, sf):
    done = sampling.grouped_split(manifest(spark, sf).select("doc_id", "study_id"), "study_id")
    gates.group_disjoint(done, "study_id", "split")
    return done.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("study_id").alias("n_groups"))


@query
def hash_split(spark, sf):
    split = sampling.hash_split(F.col("source"), ("train", "validation", "test"), (0.8, 0.1, 0.1), 20260831)
    return table(spark, sf, "documents").select("source", split.alias("split")).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def dhondt_sample(spark, sf):
    return sampling.proportional_sample(vectors(spark, sf).select("doc_id", "lang", "model", "condition").withColumn("id", F.concat_ws("|", "model", "condition", "doc_id")), ["lang", "model", "condition"], "id", 200).select("id", "lang", "model", "condition")


@query
def blinded_forms(spark, sf):
    _, forms = sampling.blinded_forms(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("shown")), "doc_id", ["shown"])
    return forms[0].join(forms[1].select("blinded_id", F.col("position").alias("second_position")), "blinded_id")


def _cases(spark, sf) -> DataFrame:
    counts = transitions.joint_counts(_joint(spark, sf), ["model", "lang", "doc_id"])
    tags = F.concat_ws(";", F.when(F.col("strict_rescue") == 1, "strict_rescue"), F.when(F.col("strict_harm") == 1, "strict_harm"), F.when(F.col("dominant_rescue") == 1, "dominant_rescue"), F.when(F.col("dominant_harm") == 1, "dominant_harm"))
    return counts.select(F.concat_ws("|", "model", "doc_id").alias("case_key"), "model", "lang", tags.alias("tags")).where("tags <> ''")


@query
def case_sample(spark, sf):
    return sampling.case_sample(_cases(spark, sf), "case_key", "tags", ["model", "lang"], 60)


@query
def abc_shuffle(spark, sf):
    cases = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("B"), F.lit("C"), F.lit("D"))).alias("arm"))
    return sampling.arm_letters(cases, "doc_id", "arm")


def _forms(spark, sf) -> DataFrame:
    v = vectors(spark, sf).where("model = 'm1' and condition in ('A', 'D')")
    a, b = (v.where(F.col("condition") == c).select("doc_id", F.col("prediction").alias("ratings")) for c in "AD")
    return annotation.joined_forms(a, b, "doc_id")


@query
def interrater_kappa(spark, sf):
    return rounded(annotation.agreement(_forms(spark, sf)))


@query
def adjudication_merge(spark, sf):
    template = annotation.adjudication_template(_forms(spark, sf), "doc_id")
    truth = vectors(spark, sf).where("model = 'm1' and condition = 'A'").select("doc_id", "reference")
    decided = template.join(truth, "doc_id").select("doc_id", F.zip_with("agreed", "reference", lambda a, r: F.when(a.isNull(), r)).alias("ratings"))
    done = annotation.consensus(template, decided, "doc_id")
    return done.join(template.select("doc_id", "n_disagreements"), "doc_id").select("doc_id", "n_disagreements", F.array_join(F.transform("ratings", lambda x: x.cast("string")), "").alias("ratings"))


# Gates and incremental work


def _log(spark, sf) -> DataFrame:
    """A result log with missing and repeated rows."""
    v = vectors(spark, sf).select("doc_id", "model", "condition")
    h = draw("log", F.col("doc_id"), F.col("model"), F.col("condition"))
    some = v.where(h % 50 != 0)
    return some.unionByName(some.where(h % 50 == 1))


@query
def completeness_audit(spark, sf):
    dimension = lambda name, values: spark.createDataFrame([(x,) for x in values], f"{name} string")
    docs = table(spark, sf, "documents").select("doc_id")
    audit = gates.completeness(_log(spark, sf), ["doc_id", "model", "condition"], docs, F.broadcast(dimension("model", MODELS)), F.broadcast(dimension("condition", CONDITIONS[:3])))
    return audit.groupBy("model", "condition", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def equivalent_dedup(spark, sf):
    log = _log(spark, sf).select(F.concat_ws("|", "model", "condition", "doc_id").alias("id"), "doc_id", F.md5(F.col("doc_id").cast("string")).alias("payload"))
    return gates.equivalent_duplicates(log, "id", "id", ["id", "doc_id", "payload"])


@query
def pending_ids(spark, sf):
    return incremental.pending(vectors(spark, sf).select("doc_id", "model", "condition"), _log(spark, sf), ["doc_id", "model", "condition"])


@query
def record_digest_check(spark, sf):
    d = table(spark, sf, "documents")
    stored = F.when(draw("tamper", F.col("doc_id")) % 25 == 0, F.lit("changed")).otherwise(F.sha2(F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"source":"'), F.col("source"), F.lit('"}')), 256))
    rows = d.select("doc_id", "source", stored.alias("digest"))
    return gates.digest_mismatches(rows, "digest", F.col("doc_id"), F.col("source")).select("doc_id", "digest")


@query
def pairing_audit(spark, sf):
    return gates.pairing_audit(_log(spark, sf), ["model"], "doc_id", "condition", len(CONDITIONS))


@query
def stage_digest(spark, sf):
    return gates.group_digest(table(spark, sf, "documents"), ["source"], "text")


def _generations(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(log, queries, models, runs, conditions): a generation log with faults of every kind, drawn by hash."""
    d = F.col("doc_id")
    queries = table(spark, sf, "documents").select(F.when(d % 2 == 0, "even").otherwise("odd").alias("bundle"), d.cast("string").alias("query_record_id"), F.col("lang").alias("dataset"), L.normalize_labels(raw_labels(d)).alias("labels"), F.col("source"))
    lists = lambda name, values: spark.createDataFrame([(x,) for x in values], f"{name} string")
    models, conditions = lists("model_key", MODELS), lists("condition", CONDITIONS[:2])
    runs = models.crossJoin(lists("bundle", ("even", "odd"))).withColumn("run_id", F.concat_ws("-", F.lit("run"), "model_key", "bundle"))
    rows = queries.crossJoin(F.broadcast(runs.withColumnRenamed("bundle", "b"))).where("bundle = b").drop("b").crossJoin(F.broadcast(conditions))
    h = draw("gen", F.col("query_record_id"), F.col("model_key"), F.col("condition")) % 200
    rows = rows.withColumn("h", h).where("h <> 0")
    fault = lambda k, wrong, right: F.when(F.col("h") == k, wrong).otherwise(right)
    log = rows.select(
        "model_key", "bundle", "query_record_id", "condition", fault(1, F.lit("x"), audits.generation_id(*audits.IDENTITY)).alias("generation_record_id"), fault(2, F.lit("old"), F.col("run_id")).alias("run_id"),
        fault(3, F.lit("xx"), F.col("dataset")).alias("source_dataset"), fault(4, F.lit(" "), F.concat(F.lit(" report of "), "source")).alias("final_report"), (F.col("h") == 5).alias("empty_output"),
        fault(6, F.lit("other"), F.lit(audits.LABEL_SOURCE)).alias("ground_truth_source"), F.when(F.col("h") != 7, fault(8, F.array(F.lit("fracture"), F.lit("edema")), F.col("labels"))).alias("reference_labels_json"),
        F.rand(7).alias("total_generation_seconds"), F.col("h"),
    )
    again = log.where("h in (9, 10)").withColumn("final_report", F.when(F.col("h") == 9, F.lit("another")).otherwise(F.col("final_report")))
    return log.unionByName(again).drop("h"), queries, models, runs, conditions


@query
def generation_audit(spark, sf):
    log, queries, models, runs, conditions = _generations(spark, sf)
    return audits.generation_problems(log, queries, models, runs, conditions).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("generation_record_id").alias("n_ids"))


@query
def resume_audit(spark, sf):
    log, queries, _, _, conditions = _generations(spark, sf)
    good = "model_key = 'm1' and bundle = 'even' and generation_record_id <> 'x' and run_id <> 'old'"
    done, lost = audits.resumable(log.where(good).dropDuplicates(["generation_record_id"]), "m1", "even", "run-m1-even", queries.where("bundle = 'even'"), conditions, repair=True)
    return done.select("generation_record_id", F.lit("done").alias("state")).unionByName(lost.select("generation_record_id", F.col("reason").alias("state")))


@query
def prediction_audit(spark, sf):
    d = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("verifier_record_id"), (F.col("quality") == 1).alias("verdict"), F.concat(F.lit("g"), F.col("doc_id") % 7).alias("patient_or_source_group"))
    h = draw("pa", F.col("verifier_record_id")) % 20
    saved = d.select(F.when(h == 0, F.concat(F.lit("u"), "verifier_record_id")).otherwise(F.col("verifier_record_id")).alias("verifier_record_id"), F.when(h == 1, ~F.col("verdict")).otherwise(F.col("verdict")).alias("truth"), F.when(h == 2, "g9").otherwise(F.col("patient_or_source_group")).alias("patient_or_source_group"), F.when(h != 3, True).alias("verdict"), h.alias("h"))
    return audits.prediction_problems(saved.unionByName(saved.where("h = 4")).drop("h"), d)


@query
def frame_audit(spark, sf):
    v = vectors(spark, sf).where("condition = 'A'").select(F.concat_ws("|", "model", "doc_id").alias("generation_record_id"), joined("reference").alias("reference_vector"), F.md5("cluster").alias("evidence_sha256"), F.lit("r").alias("runtime_sha256"))
    h = draw("fa", F.col("generation_record_id")) % 40
    rows = v.withColumn("h", h).where("h <> 0").withColumn("reference_vector", F.when(F.col("h") == 1, "changed").otherwise(F.col("reference_vector"))).withColumn("runtime_sha256", F.when(F.col("h") == 2, "s").otherwise("r"))
    extra = rows.where("h = 3").withColumn("generation_record_id", F.concat(F.lit("new|"), "generation_record_id"))
    return audits.frame_problems(rows.unionByName(rows.where("h = 4")).unionByName(extra).drop("h"), v)


@query
def recovery_summary(spark, sf):
    retried = F.when(draw("rs", F.col("doc_id"), F.col("model"), F.col("condition")) % 10 == 0, F.col("doc_id") % 3 + 1)
    return audits.recovery_counts(vectors(spark, sf), STRATUM, retried)


@query
def selected_cases(spark, sf):
    cases = table(spark, sf, "documents").where("doc_id % 20 = 0").select(F.concat(F.lit("m1|"), "doc_id").alias("case_key"))
    rows = vectors(spark, sf).where("condition = 'A'").select(F.concat_ws("|", "model", "doc_id").alias("case_key"), joined("prediction").alias("prediction"))
    return audits.selected_cases(rows, cases, "case_key")


@query
def value_counts(spark, sf):
    return audits.value_counts(table(spark, sf, "documents"), ["lang", "source"])


@query
def split_summary(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    split = sampling.hash_split(F.col("source"), ("train", "validation", "test"), (0.8, 0.1, 0.1), 20260831)
    found = M.split_summary(d.select("source", split.alias("split"), (F.col("quality") == 1).alias("verdict"), "lang"), "split", "source", "verdict", "lang")
    text = F.array_join(F.transform(F.map_entries("grouping_levels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumn("grouping_levels", text)


@query
def smoke_subset(spark, sf):
    return M.smoke_subset(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 25, 7)


@query
def annotation_strata(spark, sf):
    strata = ["lang", "model", "condition"]
    rows = vectors(spark, sf).select("doc_id", *strata).withColumn("id", F.concat_ws("|", "model", "condition", "doc_id"))
    return sampling.proportional_sample(rows, strata, "id", 200).groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


@query
def work_list(spark, sf):
    queries = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("bundle"), F.col("doc_id").cast("string").alias("query_record_id"))
    return experiment.work_list(queries, ["m1", "m2"], ["A"], ["text", "image"], 7)


def _ratings(spark, sf, model: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(d, F.explode(F.array(F.lit("X"), F.lit("Y"))).alias("letter")).select("doc_id", "letter", *[(draw("q", F.lit(f), d, F.col("letter")) % 5 + F.when(draw("q", F.lit(f), F.lit(model), d) % 4 == 0, 1).otherwise(0)).alias(f) for f in ("accuracy", "harm")])


@query
def qualitative_means(spark, sf):
    keys, fields = ["doc_id", "letter"], ["accuracy", "harm"]
    first, second = _ratings(spark, sf, "r1"), _ratings(spark, sf, "r2")
    final = annotation.merged_ratings(first, second, keys, fields, first.select(*keys, *[F.lit(2).cast("bigint").alias(f) for f in fields]))
    crosswalk = first.select(*keys, F.when((F.col("doc_id") % 2 == 0) == (F.col("letter") == "X"), "B").otherwise("C").alias("condition"))
    return rounded(annotation.rating_means(final, crosswalk, keys, "condition", fields))


def _annotators(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    v = vectors(spark, sf).where("model = 'm1'")
    blinded = F.concat(F.lit("b"), "doc_id").alias("blinded_id")
    form = lambda c, who: v.where(F.col("condition") == c).select(blinded, F.lit(who).alias("annotator_id"), F.col("prediction").alias("ratings"))
    truth = v.where("condition = 'A'").select(blinded, "reference")
    both = annotation.joined_forms(form("A", "p"), form("D", "q"), "blinded_id").join(truth, "blinded_id")
    decided = F.zip_with(F.zip_with("ratings_a", "ratings_b", lambda a, b: F.when(a == b, a)), "reference", lambda agreed, r: F.coalesce(agreed, r))
    adjudicated = both.select("blinded_id", F.lit("r").alias("annotator_id"), decided.alias("ratings"))
    crosswalk = v.where("condition = 'A'").select(blinded, F.col("doc_id").cast("string").alias("generation_record_id"))
    predicted = v.where("condition = 'C'").select(F.col("doc_id").cast("string").alias("generation_record_id"), "prediction")
    return form("A", "p"), form("D", "q"), crosswalk, predicted, adjudicated


@query
def annotator_validation(spark, sf):
    first, second, crosswalk, predicted, adjudicated = _annotators(spark, sf)
    return rounded(annotation.validate_annotators(first, second, crosswalk, predicted, adjudicated)[0])


@query
def annotator_validation_by_label(spark, sf):
    first, second, crosswalk, predicted, adjudicated = _annotators(spark, sf)
    return rounded(annotation.validate_annotators(first, second, crosswalk, predicted, adjudicated)[1])


@query
def single_validation(spark, sf):
    first, _, crosswalk, predicted, _ = _annotators(spark, sf)
    human = first.join(crosswalk, "blinded_id").select("generation_record_id", "ratings")
    return rounded(annotation.validate_single(human, predicted))


@query
def labeled_export(spark, sf):
    _, _, crosswalk, predicted, _ = _annotators(spark, sf)
    return annotation.labeled_export(crosswalk, predicted, ["blinded_id"], "generation_record_id")


@query
def end_to_end_timing(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 3).alias("repeat"), F.col("value").alias("search_ms"))
    encoding = e.select("event_id", "repeat", (F.col("search_ms") * 2).alias("encoding_ms"))
    timed = scoring.end_to_end(e.unionByName(e.withColumn("search_ms", F.col("search_ms") + 1)), encoding, ["event_id", "repeat"], "search_ms", "encoding_ms", "total_ms")
    return rounded(metrics.timing_quantiles(timed, "total_ms", ["repeat"]))


@query
def hook_scores(spark, sf):
    """A score from a plain callable, as model metrics are plugged in: the share of common first letters."""
    found = scoring.scored(_edited(spark, sf), _first_letters, "reference", "hypothesis", "score")
    return rounded(found.select("doc_id", "score"))


def _first_letters(refs: list[str], hyps: list[str]) -> list[float]:
    return [len(set(r[:1]) & set(h[:1])) / max(len(set(r[:1] + h[:1])), 1) for r, h in zip(refs, hyps, strict=True)]


# Text metrics and hooks


def _edited(spark, sf) -> DataFrame:
    """Normalized texts and these with every fifth word replaced; a text is normalized in a projection of its own, once."""
    rows = table(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("reference"))
    other = F.transform(F.split("reference", " "), lambda w, i: F.when(i % 5 == 4, F.lit("x")).otherwise(w))
    return rows.select("doc_id", "reference", F.array_join(other, " ").alias("hypothesis"))


@query
def rouge_l(spark, sf):
    return rounded(_edited(spark, sf).select("doc_id", text_metrics.rouge_l(F.col("reference"), F.col("hypothesis")).alias("rouge_l")))


@query
def cider(spark, sf):
    return rounded(text_metrics.cider(_edited(spark, sf), "doc_id", "reference", "hypothesis"))


def _fake_generate(prompt: str) -> str:
    return "" if len(prompt) % 11 in (0, 6) else f"report {len(prompt)}"


def _fake_verify(report: str, evidence: str, condition: str) -> bool | None:
    return (len(report) + len(evidence) + 2 * (condition == revision.CONDITIONS[3])) % 3 == 0


def _first(evidence: str) -> str:
    return f"evidence {evidence} report"


def _revise(report: str, evidence: str, k: int) -> str:
    return f"pass {k} of {report} with {evidence}"


@query
def revision_state_machine(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.explode(F.array(*[F.lit(c) for c in revision.CONDITIONS])).alias("condition"), X.clean(F.col("text")).alias("evidence"))
    return revision.run_all(rows, revision.Models(_fake_generate, _fake_verify, _first, _revise, lambda p: p + "again"))


def _image_generate(prompt: str, image: str | None) -> str:
    return "" if len(prompt) % 13 == 0 else f"report {len(prompt)}{'+' if image else ''}"


def _image_verify(report: str, evidence: str, condition: str, image: str | None) -> bool | None:
    return None if len(report) % 11 == 10 else (len(report) + len(evidence)) % 3 == 0


@query
def matched_runs(spark, sf):
    arms = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(a).alias("arm")) for c in revision.CONDITIONS for a in revision.ARMS]))
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("record_id"), arms.alias("x"), X.clean(F.col("text")).alias("evidence"), F.lit("i.png").alias("image_path")).select("record_id", "x.*", "evidence", "image_path")
    found = revision.run_matched_all(rows, _image_generate, _image_verify, _first, _revise)
    return found.groupBy("condition", "arm", "stop_reason", F.col("error").isNotNull().alias("failed")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_reports"), F.lit(0)).alias("n_reports"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safe_topk_retrieval(spark, sf_dir)

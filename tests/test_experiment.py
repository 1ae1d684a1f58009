import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import prompts
from cohortlens.functions.labels import LABELS, NO_FINDING
from cohortlens.operators import annotation, audits, experiment, inference, manifest, metrics, scoring
from cohortlens.operators.gates import GateError
from cohortlens.sources import readers, sinks

LOG = "model_key string, bundle string, query_record_id string, condition string, generation_record_id string, run_id string, source_dataset string, final_report string, empty_output boolean, ground_truth_source string, reference_labels_json array<string>, seconds double"


def log_row(query="q1", condition="A", **changes):
    row = dict(model_key="m", bundle="b", query_record_id=query, condition=condition, generation_record_id=f"m|b|{query}|{condition}", run_id="r", source_dataset="d", final_report="text", empty_output=False, ground_truth_source=audits.LABEL_SOURCE, reference_labels_json=["edema"], seconds=1.0)
    return tuple((row | changes).values())


@pytest.fixture
def plan(spark):
    queries = spark.createDataFrame([("b", "q1", "d", ["edema"]), ("b", "q2", "d", ["edema"])], "bundle string, query_record_id string, dataset string, labels array<string>")
    return queries, spark.createDataFrame([("m",)], "model_key string"), spark.createDataFrame([("m", "b", "r")], "model_key string, bundle string, run_id string"), spark.createDataFrame([("A",), ("B",)], "condition string")


def whole():
    return [log_row(q, c) for q in ("q1", "q2") for c in "AB"]


def test_a_complete_log(spark, plan):
    queries, models, runs, conditions = plan
    rows = [*whole(), log_row(seconds=9.0)]  # an equal row but for timing
    got = audits.complete_generations(spark.createDataFrame(rows, LOG), queries, models, runs, conditions)
    assert got.count() == 4 and got.first()["reference_abnormal"] is True and got.first()["reference_vector"][3] == 1


@pytest.mark.parametrize(
    ("row", "problem"),
    [
        (None, "missing"), (log_row(condition="C", generation_record_id="m|b|q1|C"), "unknown_condition"), (log_row("q9"), "unexpected"), (log_row(generation_record_id="z"), "id_mismatch"), (log_row(run_id="old"), "run_mismatch"),
        (log_row(source_dataset="e"), "dataset_mismatch"), (log_row(final_report="  "), "empty_report"), (log_row(empty_output=True), "empty_report"), (log_row(ground_truth_source="x"), "label_source"),
        (log_row(reference_labels_json=None), "labels_missing"), (log_row(reference_labels_json=[]), "labels_differ"), (log_row(final_report="other"), "conflicting"),
    ],
)
def test_every_fault_of_a_log_is_found(spark, plan, row, problem):
    queries, models, runs, conditions = plan
    rows = whole()[:3] if row is None else [*whole(), row]
    found = {r["problem"] for r in audits.generation_problems(spark.createDataFrame(rows, LOG), queries, models, runs, conditions).collect()}
    assert problem in found
    with pytest.raises(GateError, match="isn't complete"):
        audits.complete_generations(spark.createDataFrame(rows, LOG), queries, models, runs, conditions)


def test_resuming(spark, plan):
    queries, _, _, conditions = plan
    resume = lambda rows, **o: audits.resumable(spark.createDataFrame(rows, LOG), "m", "b", "r", queries, conditions, **o)
    failed = [log_row(), log_row("q2", final_report=""), log_row("q2", "B", empty_output=True)]
    with pytest.raises(GateError, match="failed rows"):
        resume(failed)
    done, lost = resume(failed, repair=True)
    assert [r[0] for r in done.collect()] == ["m|b|q1|A"] and {r["reason"] for r in lost.collect()} == {"empty_final_report", "empty_output_flag"}
    for bad in (dict(model_key="x"), dict(bundle="x"), dict(run_id="x"), dict(query="q7"), dict(condition="Z"), dict(generation_record_id="x")):
        with pytest.raises(GateError, match="other rows"):
            resume([log_row(**bad)])
    with pytest.raises(GateError, match="repeated"):
        resume([log_row(), log_row()])


def test_predictions_and_frames(spark):
    expected = spark.createDataFrame([("a", True, "g"), ("b", False, "h")], "verifier_record_id string, verdict boolean, patient_or_source_group string")
    saved = spark.createDataFrame([("a", False, "g", True), ("b", False, "x", None), ("c", True, "g", True), ("a", True, "g", True)], "verifier_record_id string, truth boolean, patient_or_source_group string, verdict boolean")
    assert {tuple(r) for r in audits.prediction_problems(saved, expected).collect()} == {("a", "truth"), ("a", "repeated"), ("b", "group"), ("b", "unparseable"), ("c", "unknown")}
    ddl = "generation_record_id string, reference_vector array<int>, evidence_sha256 string, runtime_sha256 string"
    plan = spark.createDataFrame([(k, [1], "e", "r") for k in "abc"], ddl)
    rows = spark.createDataFrame([("a", [0], "e", "r"), ("b", [1], "e", "s"), ("d", [1], "e", "r"), ("b", [1], "e", "r")], ddl)
    assert {tuple(r) for r in audits.frame_problems(rows, plan).collect()} == {("a", "reference_vector_differs"), ("b", "runtime_sha256_differs"), ("b", "repeated"), ("c", "missing"), ("d", "unexpected")}
    with pytest.raises(GateError, match="without exactly one"):
        audits.selected_cases(rows, plan.select("generation_record_id"), "generation_record_id")


def test_runtime_fields_are_left_out(spark):
    raw = '{"a": 1, "seconds": 1.5, "v": [{"seconds": 2e-3, "x": "seconds"}], "generation_seconds_by_pass": [1.0, 2], "total_generation_seconds": null}'
    got = spark.range(1).select(audits.without_runtime(F.lit(raw)).alias("x")).first()["x"]
    assert got == '{"a":1,"v":[{"x":"seconds"}]}'


def test_plans_amendments_and_locks(spark, tmp_path, monkeypatch):
    queries = spark.createDataFrame([("b", "q1"), ("b", "q2")], "bundle string, query_id string")
    source = tmp_path / "code.py"
    source.write_text("one")
    path, note = str(tmp_path / "plan.json"), str(tmp_path / "note.json")
    plan = {"run_name": "smoke_1", "models": ["m"], "conditions": ["A"], "smoke_n": 2}
    experiment.require_parameters(plan, {"models": {"m", "n"}}, {"conditions": "A"})
    for bad in (plan | {"run_name": "a b"}, plan | {"models": ["m", "m"]}, plan | {"models": []}, plan | {"models": ["z"]}, plan | {"conditions": ["B"]}, plan | {"run_name": "full"}):
        with pytest.raises(GateError):
            experiment.require_parameters(bad, {"models": {"m", "n"}}, {"conditions": "A"})
    freeze = lambda p=plan, n=queries, size=2: experiment.freeze(p, path, queries, n, {"b": size}, [str(source)])
    frozen = freeze()
    assert freeze() == frozen == experiment.load(path, queries.orderBy(F.desc("query_id")), queries, [str(source)])
    for bad in (dict(p=plan | {"models": ["n"]}), dict(n=queries.limit(1)), dict(size=3)):
        with pytest.raises(GateError):
            freeze(**bad)
    with pytest.raises(GateError, match="inputs changed"):
        experiment.load(path, queries.limit(1), queries, [str(source)])
    source.write_text("two")
    with pytest.raises(GateError, match="sources changed"):
        experiment.load(path, queries, queries, [str(source)], note)
    records = spark.createDataFrame([("a", "report"), ("b", "")], "id string, report string")
    with pytest.raises(GateError, match="can't be kept"):
        experiment.amend(path, note, [str(source)], records, "retry", F.col("report") != "")
    experiment.amend(path, note, [str(source)], records.limit(1), "retry", F.col("report") != "")
    assert experiment.load(path, queries, queries, [str(source)], note)["plan_id"] == frozen["plan_id"]
    source.write_text("three")
    with pytest.raises(GateError, match="another plan"):
        experiment.load(path, queries, queries, [str(source)], note)
    with experiment.run_lock(str(tmp_path), "m"), pytest.raises(GateError, match="locked"), experiment.run_lock(str(tmp_path), "m"):
        pass
    with experiment.run_lock(str(tmp_path), "m"):
        pass
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "conf.json").write_text('{"root": "x", "k": 1}')
    folder = experiment.project_dir(str(tmp_path / "deep" / "er"), "conf.json", "SOME_DIR")
    monkeypatch.setenv("SOME_ROOT", "y")
    assert experiment.load_config(folder, "conf.json", {"SOME_ROOT": "root", "NONE": "k"}) == {"root": "y", "k": 1}
    experiment.require_identity("Gemma", "org/medgemma-4b")
    with pytest.raises(GateError):
        experiment.require_identity("phi", "org/medgemma-4b")
    assert experiment.every({"a": lambda: 1, "b": lambda: 1 / 0}) == {"b": "ZeroDivisionError: division by zero"}
    with pytest.raises(GateError):
        experiment.require_all({"b": "x"})
    assert experiment.review_status(3, {"a": 3, "b": None, "c": 2}) == {"ready": False, "status": "pending", "waiting_for": ["b", "c"], "expected": 3}


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    queries = spark.createDataFrame([("b", str(k)) for k in range(10)], "bundle string, query_record_id string")
    work = experiment.work_list(queries, ["m"], ["A"], ["text", "image"], 3)
    assert work.count() == 20 and work.groupBy("query_record_id").agg(F.count_distinct("pair_seed").alias("s"), F.sum("turn").alias("t")).where("s = 1 and t = 1").count() == 10
    target, failures = str(tmp_path / "done"), str(tmp_path / "failed")
    run = lambda bad: experiment.run_pending(work, "generation_record_id", lambda df: df.select("generation_record_id", F.lit("x").alias("final_report"), F.when(F.col("query_record_id").isin(bad), "broken").alias("error")), target, failures)
    assert run(["3", "4"]) == 4 and spark.read.parquet(target).count() == 16
    assert run([]) == 0
    done = spark.read.parquet(target)
    assert done.count() == 20 and experiment.changed_records(done, "generation_record_id").count() == 0
    assert experiment.changed_records(done.withColumn("final_report", F.lit("y")), "generation_record_id").count() == 20


def test_scores_and_labels_by_hooks(spark, tmp_path):
    df = spark.createDataFrame([(str(k), f"a{k}", "b") for k in range(300)], "id string, r string, h string")
    assert scoring.scored(df, None, "r", "h", "s").where("s is not null").count() == 0
    assert scoring.scored(df, lambda r, h: [0.5] * len(r), "r", "h", "s").agg(F.sum("s")).first()[0] == 150
    for bad in (lambda r, h: [0.5], lambda r, h: [2.0] * len(r), lambda r, h: [float("nan")] * len(r)):
        with pytest.raises(Exception, match="missing or impossible"):
            scoring.scored(df, bad, "r", "h", "s").collect()
    state = lambda t: {x: (-1 if "edema" in t and x == "edema" else 1 if "PICC" in t and x == "support devices" else None) for x in [*LABELS, NO_FINDING]}
    got = scoring.labeled_with_sentinels(df.withColumnRenamed("r", "report"), lambda texts: [state(t) for t in texts], "id", "report")
    assert got.count() == 300 and sum(got.first()["prediction"]) == 0
    with pytest.raises(GateError, match="sentinel"):
        scoring.labeled_with_sentinels(df, lambda texts: [dict.fromkeys([*LABELS, NO_FINDING], 1) for _ in texts], "id", "r")
    with pytest.raises(Exception, match="left out rows"):
        scoring.labeled(df, lambda texts: [], "r").collect()
    calls = spark.sparkContext.accumulator(0)

    def score(some):
        calls.add(1)
        return some.select("id", F.lit(1.0).alias("s"))

    for _ in range(2):
        assert scoring.scored_in_chunks(df, "id", {"v": 1}, score, str(tmp_path / "chunks"), 4).count() == 300
    assert calls.value == 4
    scoring.scored_in_chunks(df.limit(299), "id", {"v": 1}, score, str(tmp_path / "chunks"), 4)
    assert calls.value == 5
    with pytest.raises(GateError, match="aren't the chunk's"):
        scoring.scored_in_chunks(df, "id", {"v": 2}, lambda some: some.select("id").limit(1), str(tmp_path / "chunks"), 1)


def test_annotators(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(2) for _ in LABELS] for _ in range(30)]
    flip = lambda v, n: [x ^ (rng.randrange(n) == 0) for x in v]
    second, predicted = [flip(v, 8) for v in rows], [flip(v, 5) for v in rows]
    form = lambda values, who: spark.createDataFrame([(f"b{k}", who, [int(x) for x in v]) for k, v in enumerate(values)], "blinded_id string, annotator_id string, ratings array<int>")
    crosswalk = spark.createDataFrame([(f"b{k}", f"g{k}") for k in range(30)], "blinded_id string, generation_record_id string")
    guesses = spark.createDataFrame([(f"g{k}", [int(x) for x in v]) for k, v in enumerate(predicted)], "generation_record_id string, prediction array<int>")
    args = form(rows, "a"), form(second, "b"), crosswalk, guesses
    summary, labels = annotation.validate_annotators(*args, form(rows, "c"))
    s = summary.first()
    cells = [(x, y) for v, w in zip(rows, second, strict=True) for x, y in zip(v, w, strict=True)]
    assert s["n_disagreements"] == sum(x != y for x, y in cells) and abs(s["cell_agreement"] - sum(x == y for x, y in cells) / len(cells)) < 1e-12
    f1 = []
    for i in range(len(LABELS)):
        tp, fp, fn = (sum((v[i], p[i]) == t for v, p in zip(rows, predicted, strict=True)) for t in ((1, 1), (0, 1), (1, 0)))
        f1.append(2 * tp / (2 * tp + fp + fn))
    assert abs(s["macro_f1"] - sum(f1) / 13) < 1e-12 and {r["label"]: round(r["f1"], 9) for r in labels.collect()} == {x: round(f, 9) for x, f in zip(LABELS, f1, strict=True)}
    assert {r["label"]: round(r["f1"], 9) for r in annotation.validate_single(form(rows, "a").join(crosswalk, "blinded_id"), guesses).collect()} == {x: round(f, 9) for x, f in zip(LABELS, f1, strict=True)}
    with pytest.raises(GateError, match="different people"):
        annotation.validate_annotators(*args, form(rows, "a"))
    with pytest.raises(GateError, match="need an adjudication"):
        annotation.validate_annotators(*args)
    with pytest.raises(GateError, match="crosswalk's"):
        annotation.validate_annotators(form(rows[:-1], "a"), *args[1:])
    with pytest.raises(Exception, match="open or changed"):
        annotation.validate_annotators(*args, form([[1 - x for x in v] for v in rows], "c"))[0].collect()
    with pytest.raises(Exception, match="no one-to-one"):
        annotation.validate_annotators(*args[:3], guesses.limit(3), form(rows, "c"))[0].collect()
    with pytest.raises(GateError):
        annotation.validation_gate(labels, 200, annotators=1)
    export = annotation.labeled_export(crosswalk, guesses, ["blinded_id"], "generation_record_id")
    assert export.columns[:3] == ["blinded_id", "generation_record_id", "atelectasis"] and export.count() == 30


def test_manifests_of_folders(spark, tmp_path):
    import json

    import numpy as np
    from test_records import png

    rng = np.random.default_rng(2)
    for k in range(3):
        (tmp_path / f"p{k}").mkdir()
        (tmp_path / f"p{k}" / f"i{k}.png").write_bytes(png(rng.integers(0, 255, (40, 50)).astype(np.uint8)))
    metadata = [{"subject_id": 7, "study_id": "s", "FINDINGS": "No edema.", "impression": "Clear.", "labels": ["Edema", " ", "odd"]}, {"uid": "u", "caption": "c", "labels": "FRACTURE", "normal": "YES"}, {"patient_id": "p", "report": "r", "view": "PA"}]
    for k, row in enumerate(metadata):
        (tmp_path / f"p{k}" / f"i{k}.json").write_text(json.dumps(row))
    a, b, c = manifest.build(spark, str(tmp_path), "mimic", "test").orderBy("record_id").collect()
    assert [r["record_id"] for r in (a, b, c)] == [f"mimic:test:{k:08d}" for k in range(3)] and [r["image_id"] for r in (a, b, c)] == ["i0", "i1", "i2"]
    assert (a["patient_key"], a["patient_reliable"], a["study_id"], a["report_text"], a["labels"], a["negated_flags"], a["normal"]) == ("mimic:7", True, "s", "No edema. Clear.", ["edema"], ["edema"], "no")
    assert (b["patient_key"], b["report_text"], b["labels"], b["normal"], b["study_id"]) == (None, "c", ["fracture"], "yes", "i1") and (c["patient_id_source"], c["view_position"], c["normal"], c["labels_raw"]) == ("patient_id", "PA", "yes", [])
    assert all(len(r["image_phash"]) == 16 and len(r["image_sha256"]) == 64 for r in (a, b, c))
    (tmp_path / "p1" / "i1.json").write_text("no json")
    with pytest.raises(Exception, match="can't parse"):
        manifest.build(spark, str(tmp_path), "other", "test", phash=False).collect()
    moved = spark.createDataFrame([("/old/x/y",), ("/older/x",)], "p string").select(manifest.relocated(F.col("p"), "/old", "/new/").alias("p")).collect()
    assert [r["p"] for r in moved] == ["/new/x/y", "/older/x"]


def test_vectors_bundles_and_forms(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "v.npy", np.arange(250 * 3, dtype="float32").reshape(250, 3))
    metadata = spark.createDataFrame([(f"r{k:03d}", k) for k in range(250)], "record_id string, position long").repartition(5)
    found = readers.ingest_vectors(spark, str(tmp_path / "v.npy"), metadata, "position", "record_id", block=70)
    assert {r["record_id"]: r["embedding"][0] for r in found.collect()} == {f"r{k:03d}": 3.0 * k for k in range(250)}
    with pytest.raises(GateError, match="rows"):
        readers.ingest_vectors(spark, str(tmp_path / "v.npy"), metadata.limit(3), "position", "record_id")
    for name in ("g", "q"):
        sinks.write_bundle(found, metadata, str(tmp_path / name))
    gallery, queries = readers.read_bundle(spark, str(tmp_path / "g"), str(tmp_path / "q"))
    assert gallery.count() == queries.count() == 250
    with pytest.raises(GateError, match="different rows"):
        sinks.write_bundle(found.limit(7), metadata, str(tmp_path / "x"))
    sinks.write_records(metadata, str(tmp_path / "records"), "record_id", 8)
    assert sinks.read_record(spark, str(tmp_path / "records"), "record_id", "r007", 8).collect()[0]["position"] == 7
    assert sinks.write_repaired(metadata.limit(1), str(tmp_path / "records")).endswith("records-v2")
    assert sinks.write_repaired(metadata.limit(1), str(tmp_path / "records")).endswith("records-v3")
    forms = [spark.createDataFrame([("b1", "text", 3)], "blinded_id string, final_report string, position int")] * 2
    made = sinks.write_forms(forms, metadata.limit(1), str(tmp_path / "forms"), LABELS, "print")
    assert sinks.write_forms(forms, metadata, str(tmp_path / "forms"), LABELS, "print") == made
    assert spark.read.option("header", True).csv(made["paths"]["annotator2"]).columns[:3] == ["blinded_id", "final_report", "human_atelectasis"]
    with pytest.raises(GateError, match="another cohort"):
        sinks.write_forms(forms, metadata, str(tmp_path / "forms"), LABELS, "other")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": 2\n')
    with pytest.raises(GateError, match=r"bad\.jsonl:3"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")
    (tmp_path / "d1" / "d2").mkdir(parents=True)
    for name in ("t1.x", "d1/t2.x", "d1/d2/t3.x"):
        (tmp_path / name).write_text("z")
    assert {len(r["path"].split("/d")) for r in readers.inventory(spark, str(tmp_path), r"t\d\.x", depth=1).collect()} == {1, 2}


def test_five_contrasts_and_directions(spark):
    rng = random.Random(4)
    rows = [(f"c{k % 9}", c, [int(x) for x in v], [int(x ^ (rng.random() < p)) for x in v]) for k in range(90) for v in [[rng.randrange(2) for _ in LABELS]] for c, p in zip("ABCD", (0.3, 0.25, 0.1, 0.05), strict=True)]
    stats = metrics.totals(spark.createDataFrame(rows, "cluster string, condition string, reference array<int>, prediction array<int>"), ["condition", "cluster"]).withColumn("model", F.lit("m"))
    values = lambda of: {k: metrics.metrics(of)[k] for k in ("fer", "macro_f1")}
    five = inference.five_contrasts(stats, ["model"], "cluster", "condition", values, 300)
    got = {(r["contrast"], r["metric"]): r for r in five.collect()}
    assert len(got) == 10 and {k for k, r in got.items() if r["ci_low"] is not None} == {("B-C", "fer"), ("B-C", "macro_f1")}
    assert got["B-C", "fer"]["direction"] == got["B-C", "macro_f1"]["direction"] == "better" and got["B-C", "fer"]["difference"] < 0 < got["B-C", "macro_f1"]["difference"]
    for metric in ("fer", "macro_f1"):  # Holm by hand over the five
        p = sorted((r["p_value"], k[0]) for k, r in got.items() if k[1] == metric)
        high = 0.0
        for i, (value, contrast) in enumerate(p):
            high = max(high, min(1.0, (5 - i) * value))
            assert abs(got[contrast, metric]["p_holm"] - high) < 1e-12
    summary = {r["metric"]: r for r in inference.contrast_summary(five, "B-C", ["metric"]).collect()}
    assert summary["fer"]["n_strata"] == 1 and summary["fer"]["n_worse"] == 0


def test_verifier_prompt(spark):
    both = spark.createDataFrame([(" s ", " e "), ("EVIDENCE x\nStatement: y", None), ("s", None)], "r string, e string").select(prompts.verifier_prompt(F.col("r"), F.col("e")).alias("p")).collect()
    assert [r["p"].removeprefix(prompts.VERIFIER).removesuffix(prompts.VERIFIER_END) for r in both] == ["EVIDENCE\ne\n\nSTATEMENT:\ns", "EVIDENCE x\nStatement: y", "STATEMENT:\ns"]

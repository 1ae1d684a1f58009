import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.labels import LABELS
from cohortlens.operators import annotation, cohort, gates, metrics, multiplicity, resampling, retrieval, revision, sampling, text_metrics, transitions
from cohortlens.operators.gates import GateError

MANIFEST = "record_id string, patient_id string, patient_key string, patient_reliable boolean, study_id string, image_id string, image_sha256 string, report_sha256 string, hi long, lo long"


def manifest(spark, rows):
    return spark.createDataFrame(rows, MANIFEST)


def row(name, patient=None, reliable=False, study=None, report=None, lo=None):
    return (name, patient, f"d:{patient}" if patient else None, reliable, study or f"s-{name}", f"i-{name}", None, report, None if lo is None else 5, lo)


def test_gallery_cleaning_keeps_reasons(spark):
    queries = manifest(spark, [row("q1", "p1", True, lo=0b1111 << 8), row("q2", "p2", False, study="S", report="R")])
    gallery = manifest(spark, [
        row("same_patient", "p1", True), row("assumed", "p1", False), row("assumed2", "p2", True), row("study", study="S"), row("report", report="R", study="S"),
        row("near4", lo=0), row("near5", lo=0b1 << 20), row("clean", "p9", True),
    ])
    kept, removed = cohort.clean_gallery(gallery, queries)
    assert {r["record_id"] for r in kept.collect()} == {"near5", "clean"}
    assert {r["record_id"]: r["reasons"] for r in removed.collect()} == {
        "same_patient": ["reliable_patient_overlap"], "assumed": ["assumed_patient_group_overlap"], "assumed2": ["assumed_patient_group_overlap"], "study": ["study_id_overlap"],
        "report": ["report_sha256_overlap", "study_id_overlap"], "near4": ["image_phash_distance<=4"],
    }
    counts = {r["field"]: r["n_overlap"] for r in cohort.overlap_audit(gallery, queries).collect()}
    assert counts == {"study_id": 1, "image_id": 0, "image_sha256": 0, "report_sha256": 1, "patient_key": 1, "image_phash": 1}
    with pytest.raises(GateError):
        cohort.require_leakage_free(gallery, queries)
    cohort.require_leakage_free(kept, queries)
    assert cohort.clean_gallery(gallery.limit(0), queries)[0].count() == 0
    assert cohort.clean_gallery(gallery, queries.limit(0))[0].count() == 8


def test_alignment(spark):
    m = spark.createDataFrame([("a", "x/a.jpg"), ("b", "x/b.jpg")], "record_id string, path string")
    v = spark.createDataFrame([(0, "y/b.jpg"), (1, "y/a.jpg")], "vector_id int, path string")
    assert {(r[0], r[1]) for r in cohort.align_unique(m, v, [], ["path"]).collect()} == {("a", 1), ("b", 0)}
    twice = spark.createDataFrame([(0, "y/a.jpg"), (1, "z/a.jpg"), (2, "z/b.jpg")], "vector_id int, path string")
    with pytest.raises(Exception, match="uniquely align"):
        cohort.align_unique(m, twice, [], ["path"]).collect()
    same = spark.createDataFrame([("a", "x/a.jpg"), ("b", "z/a.png")], "record_id string, path string")
    with pytest.raises(Exception, match="several rows aligned"):
        cohort.align_unique(same, spark.createDataFrame([(1, "y/a.gif")], "vector_id int, path string"), [], ["path"]).collect()


def test_evaluation_overlap(spark):
    rows = spark.createDataFrame([("r1", "p1", "p1", "s1", "h1"), ("r2", "g2", None, "s2", "h2")], "record_id string, patient_or_source_group string, patient_id string, source_record_id string, report_sha256 string")
    evaluation = spark.createDataFrame([("d:p1", "x", None, None, "h1")], "patient_key string, record_id string, study_id string, image_id string, report_sha256 string")
    assert {r["record_id"]: r["reasons"] for r in cohort.evaluation_overlap(rows, evaluation).collect()} == {"r1": ["evaluation_patient_or_group", "evaluation_report_hash"], "r2": []}


def test_top_k_matches_brute_force_in_blocks(spark):
    rng = random.Random(3)
    vectors = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    e = spark.createDataFrame([(k, k % 3, v) for k, v in enumerate(vectors)], "id int, label int, v array<double>")
    queries = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("ql"), F.col("v").alias("q"))
    gallery = e.select(F.col("id").alias("gallery_id"), F.col("label").alias("gl"), F.col("v").alias("g"))
    eligible = (F.col("ql") != F.col("gl")) & (F.col("query_id") != F.col("gallery_id"))
    for block in (1 << 20, 300):
        found = retrieval.top_k(queries, gallery, 4, eligible, block)
        got = {(r["query_id"], r["rank"]): r["gallery_id"] for r in found.collect()}
        for q in (0, 20, 40):
            order = sorted((k for k in range(60) if k % 3 != q % 3), key=lambda k, q=q: (-sum(a * b for a, b in zip(vectors[q], vectors[k], strict=True)), k))[:4]
            assert [got[q, r] for r in range(1, 5)] == order
        retrieval.require_full(found, queries, 4)
    with pytest.raises(GateError):
        retrieval.require_full(found.where("rank < 4"), queries, 4)
    with pytest.raises(GateError):
        retrieval.top_k(queries, gallery, 0)


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"id string, cluster string, arm string, reference array<int>, prediction array<int>{extra}")


def vec(*ones):
    return [int(i in ones) for i in range(13)]


def test_metrics(spark):
    df = vectors(spark, [("1", "a", "A", vec(0), vec(0, 1)), ("2", "b", "A", vec(1), vec())])
    r = metrics.grouped_metrics(df, ["arm"]).first()
    assert (r["fer"], r["fer_abnormal"], r["omission"], r["micro_f1"]) == (0.5, 0.5, 0.5, 0.5)
    assert r["macro_f1"] == 0.5 and r["n_defined_labels"] == 2 and r["f1_atelectasis"] == 1.0 and r["f1_edema"] is None
    empty = metrics.grouped_metrics(vectors(spark, [("1", "a", "A", vec(), vec())]), ["arm"]).first()
    assert empty["fer"] is None and empty["macro_f1"] is None and empty["hamming_accuracy"] == 1.0
    assert metrics.grouped_metrics(df.limit(0), ["arm"]).count() == 0


def perfect_and_wrong(spark):
    rows = []
    for q in range(12):
        truth = vec(q % 13, (q + 3) % 13)
        rows += [(str(q), f"p{q // 2}", "A", truth, truth), (str(q), f"p{q // 2}", "B", truth, vec())]
    return vectors(spark, rows)


def arms(spark, first, second):
    stats = metrics.totals(perfect_and_wrong(spark), ["arm", "cluster"]).withColumn("s", F.lit("s"))
    a, b = (stats.where(F.col("arm") == x).select("s", "cluster", *[F.col(c).alias(f"{t}_{c}") for c in metrics.TOTALS]) for t, x in (("a", first), ("b", second)))
    return a.join(b, ["s", "cluster"])


def test_resampling(spark):
    values = metrics.metrics
    same = resampling.paired_permutation(arms(spark, "A", "A"), ["s"], "cluster", metrics.TOTALS, values, 50).where("difference is not null").collect()
    assert same and all(r["difference"] == 0 and r["p_value"] == 1 for r in same)
    flip = {r["metric"]: r for r in resampling.paired_permutation(arms(spark, "A", "B"), ["s"], "cluster", metrics.TOTALS, values, 200).collect()}
    assert flip["macro_f1"]["difference"] == -1 and flip["omission"]["difference"] == 1 and flip["omission"]["p_value"] < 0.2
    ci = {r["metric"]: r for r in resampling.paired_bootstrap(arms(spark, "A", "B"), ["s"], "cluster", metrics.TOTALS, values, 50).collect()}
    assert (ci["macro_f1"]["ci_low"], ci["omission"]["ci_high"]) == (-1, 1)
    stats = metrics.totals(perfect_and_wrong(spark), ["arm", "cluster"])
    direct = {r["arm"]: r for r in metrics.grouped_metrics(perfect_and_wrong(spark), ["arm"]).collect()}
    for r in resampling.bootstrap(stats, ["arm"], "cluster", metrics.TOTALS, values, 31).collect():
        assert r["estimate"] == direct[r["arm"]][r["metric"]]
        assert r["n_valid"] <= 31 and (r["ci_low"] is None or r["ci_low"] <= r["estimate"] + 1e-12 or r["metric"].startswith("f1"))
    weights, _ = resampling.draws(7)
    assert (weights(0, 20, 6).sum(axis=1) == 6).all()


def test_sign_flip(spark):
    nets = spark.createDataFrame([("s", f"c{k}", 0, 3) for k in range(8)], "s string, cluster string, zero int, same int")
    p = {r["metric"]: r["p_value"] for r in resampling.sign_flip(nets, ["s"], "cluster", ["zero", "same"], 300).collect()}
    assert p["zero"] == 1 and p["same"] < 0.05


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", None), ("g", "b", 0.5)], "family string, name string, p double")
    got = {(r["family"], r["name"]): r["p_holm"] for r in multiplicity.holm(df, "p", ["family"], ["name"]).collect()}
    assert got["f", "a"] == pytest.approx(0.03) and got["f", "b"] == pytest.approx(0.06) and got["f", "c"] == pytest.approx(0.06)
    assert got["g", "a"] is None and got["g", "b"] == 0.5
    counted = {(r["family"], r["name"]): r["p_holm"] for r in multiplicity.holm(df, "p", ["family"], ["name"], count_missing=True).collect()}
    assert counted["g", "b"] == 1.0 and counted["g", "a"] is None


def test_pairs_and_transitions(spark):
    df = vectors(spark, [("1", "a", "A", vec(0), vec(1)), ("1", "a", "B", vec(0), vec(0)), ("2", "a", "A", vec(0), vec(0)), ("2", "a", "B", vec(0), vec())])
    pairs = transitions.paired(df, "arm", "A", "B", ["id"], ["reference", "cluster"])
    r = transitions.resolved_introduced(pairs, ["cluster"]).first()
    assert (r["n_pairs"], r["rescued"], r["harmed"], r["errors_resolved"], r["errors_introduced"]) == (2, 1, 1, 2, 1)
    e = {x["arm"]: (x["rescued"], x["harmed"], x["unchanged"]) for x in transitions.error_transitions(df, ["cluster"], "id", "arm", "A").collect()}
    assert e == {"A": (0, 0, 2), "B": (1, 1, 0)}
    for bad in (df.where("not (id = '2' and arm = 'B')"), df.unionByName(df.where("id = '1'")), df.withColumn("cluster", F.when((F.col("id") == "1") & (F.col("arm") == "B"), "z").otherwise(F.col("cluster")))):
        with pytest.raises(Exception, match="no one-to-one match"):
            transitions.paired(bad, "arm", "A", "B", ["id"], ["reference", "cluster"]).collect()


def test_joint_rescue_and_harm(spark):
    right, wrong = vec(0), vec(1)
    rows = [(str(n), "c", arm, right, p) for n, ps in enumerate(itertools.product([right, wrong], repeat=3)) for arm, p in zip("BCD", ps, strict=True)]
    counts = transitions.joint_counts(transitions.joint_rows(vectors(spark, rows), ["id"], "arm", ("B", "C", "D")), ["id"])
    got = {r["id"]: (r["strict_rescue"], r["strict_harm"], r["event_rescue"], r["event_harm"]) for r in counts.collect()}
    assert got["6"] == (1, 0, 2, 0) and got["1"] == (0, 1, 0, 2)
    assert all(v == (0, 0, 0, 0) for k, v in got.items() if k not in "16")
    with pytest.raises(Exception, match="the arms don't match"):
        transitions.joint_rows(vectors(spark, rows[:-1]), ["id"], "arm", ("B", "C", "D")).collect()


def test_ensemble(spark):
    rows = [("1", "c", m, vec(0), p) for m, p in zip("xyz", (vec(0), vec(0, 1), vec(1)), strict=True)] + [("2", "c", "x", vec(0), vec(0))]
    got = transitions.majority_vote(vectors(spark, rows), ["id"], "arm", ["x", "y", "z"]).collect()
    assert [(r["id"], r["prediction"]) for r in got] == [("1", vec(0, 1))]
    with pytest.raises(ValueError):
        transitions.majority_vote(vectors(spark, rows), ["id"], "arm", ["x", "y"])


def test_grouped_split(spark):
    df = spark.createDataFrame([(f"g{k}", i) for k in range(90) for i in range(2)], "g string, i int")
    done = sampling.grouped_split(df, "g")
    gates.group_disjoint(done, "g", "split")
    n = {r["split"]: r["count"] / 180 for r in done.groupBy("split").count().collect()}
    assert all(abs(n[k] - f) <= 0.03 for k, f in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    hashed = sampling.grouped_split(df, "g", broadcast_bytes=10)
    gates.group_disjoint(hashed, "g", "split")
    with pytest.raises(GateError):
        gates.group_disjoint(df.withColumn("split", F.col("i").cast("string")), "g", "split")


def test_proportional_sample(spark):
    sizes = {"a": 50, "b": 7, "c": 1, "d": 31, "e": 31}
    df = spark.createDataFrame([(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)], "s string, id string")
    got = {r["s"]: r["count"] for r in sampling.proportional_sample(df, ["s"], "id", 40).groupBy("s").count().collect()}
    assert got == {"a": 17, "b": 2, "c": 1, "d": 10, "e": 10}


def test_case_sample_and_forms(spark):
    cases = spark.createDataFrame([(f"k{i}", "strict_rescue;dominant_harm" if i % 3 == 0 else "dominant_harm", f"m{i % 2}") for i in range(30)], "k string, t string, m string")
    got = sampling.case_sample(cases, "k", "t", ["m"], 12).collect()
    assert len(got) == 12 and sum(r["direction"] == "rescue" for r in got) == 6 and {r["case_number"] for r in got} == {f"QR-{i:04d}" for i in range(1, 13)}
    assert sampling.case_sample(cases, "k", "t", ["m"], 100).count() == 30
    crosswalk, forms = sampling.blinded_forms(cases, "k", ["t"])
    assert crosswalk.select("blinded_id").distinct().count() == 30 and all("k" not in f.columns for f in forms)
    letters = sampling.arm_letters(cases.select("k").crossJoin(spark.createDataFrame([("B",), ("C",), ("D",)], "arm string")), "k", "arm")
    assert letters.groupBy("k").agg(F.count_distinct("letter").alias("n")).where("n <> 3").count() == 0


def test_annotation(spark):
    a = spark.createDataFrame([("1", vec()), ("2", vec(*range(13)))], "id string, ratings array<int>")
    pairs = annotation.joined_forms(a, a, "id")
    assert all(r["agreement"] == 1 and r["kappa"] == 1 for r in annotation.agreement(pairs).collect())
    b = spark.createDataFrame([("1", vec(3)), ("2", vec(*range(13)))], "id string, ratings array<int>")
    template = annotation.adjudication_template(annotation.joined_forms(a, b, "id"), "id")
    decide = lambda cells: spark.createDataFrame([("1", cells), ("2", [None] * 13)], "id string, ratings array<int>")
    done = {r["id"]: r["ratings"] for r in annotation.consensus(template, decide([1 if i == 3 else None for i in range(13)]), "id").collect()}
    assert done == {"1": vec(3), "2": [1] * 13}
    for cells in ([None] * 13, [1] * 13):
        with pytest.raises(Exception, match="open or changed cells"):
            annotation.consensus(template, decide(cells), "id").collect()
    with pytest.raises(GateError):
        annotation.joined_forms(a, spark.createDataFrame([("1", [2] * 13), ("2", vec())], "id string, ratings array<int>"), "id")
    one = annotation.agreement(annotation.joined_forms(a.limit(1), a.limit(1), "id")).first()
    assert one["kappa"] is None


def test_gates(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    assert {(r["id"], r["n_rows"]) for r in gates.equivalent_duplicates(df, "id", "n", ["n", "t"]).collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(Exception, match="conflicting rows"):
        gates.equivalent_duplicates(df.unionByName(spark.createDataFrame([("b", 3, "z")], df.schema)), "id", "n", ["n", "t"]).collect()
    wanted = spark.createDataFrame([("a",), ("c",)], "id string")
    assert {(r["id"], r["problem"]) for r in gates.completeness(df, ["id"], wanted).collect()} == {("a", "repeated"), ("b", "unexpected"), ("c", "missing")}
    d = gates.table_digest(df, ["id"]).first()
    assert d == gates.table_digest(df.orderBy(F.desc("id")).repartition(3), ["id"]).first() and d != gates.table_digest(df.limit(2), ["id"]).first()
    with pytest.raises(GateError):
        gates.require_unique(df, ["id"])


def test_revision():
    def run(condition, generate, verify=lambda r, e, c: None, passes=4):
        models = revision.Models(generate, verify, lambda e: f"write {e}", lambda r, e, k: f"{k} {r}", lambda p: p + " again", passes)
        return revision.run_condition(condition, "ev", models)

    a, b, c, d = revision.CONDITIONS
    assert run(a, lambda p: "r").stop_reason == "single_pass"
    assert (len(run(b, lambda p: "r").reports), run(b, lambda p: "r").stop_reason) == (5, "max_passes")
    assert run(b, lambda p: "r", passes=0).stop_reason == "max_passes" and run(a, lambda p: "r", passes=0).stop_reason == "single_pass"
    accepted = run(c, lambda p: "r", lambda r, e, k: True)
    assert (len(accepted.reports), accepted.stop_reason) == (1, "verifier_true")
    assert len(run(d, lambda p: "r").verdicts) == 4
    assert run(c, lambda p: "r", lambda r, e, k: k == d).stop_reason == "max_passes" and run(d, lambda p: "r", lambda r, e, k: k == d).stop_reason == "verifier_true"
    assert run(b, lambda p: " ").stop_reason == "empty_initial_after_recovery"
    empty = run(b, lambda p: "r" if p.startswith("write") else "")
    assert empty.stop_reason == "empty_revision_fallback" and empty.report == "r" and empty.recovered == 1
    again = run(a, lambda p: "r" if p.endswith("again") else "")
    assert again.stop_reason == "single_pass" and again.recovered == 1
    with pytest.raises(ValueError):
        run("Z", lambda p: "r")


def test_matched_runs():
    seen = []

    def generate(prompt, image):
        seen.append((prompt, image))
        return "" if len(seen) == 1 else f"r{len(seen)}"

    def run(condition, arm, verify=lambda r, e, c, i: False, generate=generate):
        seen.clear()
        return revision.run_matched(condition, arm, {"evidence": "ev", "image_path": "x.png"}, generate, verify, lambda e: f"write {e}", lambda r, e, k: f"{k} {r} {e}")

    a, b, c, d = revision.CONDITIONS
    text, image = revision.ARMS
    first = run(b, text)
    prompts = [p for p, _ in seen]
    assert first.recovered == 1 and prompts[0] == prompts[1] and {i for _, i in seen} == {None}  # the retry has the same prompt
    run(b, image)
    assert [p for p, _ in seen] == prompts and {i for _, i in seen} == {"x.png"}
    assert run(c, image, lambda r, e, k, i: i == "x.png").stop_reason == "verifier_true" and run(c, text, lambda r, e, k, i: i == "x.png").stop_reason == "max_passes"
    for bad in (dict(verify=lambda r, e, k, i: None), dict(generate=lambda p, i: " ")):
        with pytest.raises(revision.Unusable):
            run(d, text, **bad)
    with pytest.raises(ValueError):
        run(a, "other")


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge(spark):
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert text_metrics.lcs_length(a, b) == lcs(a, b)
    df = spark.createDataFrame([("the cat", "the cat sat"), (None, "x")], "r string, h string")
    assert [round(r[0], 6) for r in df.select(text_metrics.rouge_l(F.col("r"), F.col("h"))).collect()] == [0.8, 0.0]


def test_cider(spark):
    rows = [(0, "a b c d e", "a b c d e"), (1, "x y z", "a q"), (2, None, "a"), (3, "k l m n", "k l m n")]
    got = {r["id"]: r["cider"] for r in text_metrics.cider(spark.createDataFrame(rows, "id int, r string, h string"), "id", "r", "h").collect()}
    assert got[0] == pytest.approx(10.0) and got[1] == 0 and got[2] == 0 and math.isclose(got[3], 10.0) and len(LABELS) == 13


def test_registered_inference_has_the_production_replicates(spark):
    import inspect

    from cohortlens.plans import queries

    for f in (resampling.bootstrap, resampling.paired_bootstrap, resampling.paired_permutation, resampling.sign_flip):
        assert inspect.signature(f).parameters["n"].default == queries.REPLICATES
    # 13 labels and 12 contrasts can be significant after Holm
    assert 13 / (queries.REPLICATES + 1) < 0.05
    nets = spark.createDataFrame([("s", c, 1) for c in range(40)], "s string, c int, net int")
    assert resampling.sign_flip(nets, ["s"], "c", ["net"], queries.REPLICATES).first()["p_value"] < 1 / 201


def test_every_replicate_occurs_once(spark):
    df = spark.createDataFrame([("x",), (None,)], "k string")
    for n in (1, 250, 251, 10_000):
        got = resampling.weighted_totals(df.withColumn("c", F.lit("c")).withColumn("one", F.lit(1)), ["k"], "c", ["one"], n)
        assert got.columns == ["k", "b", "one"]
        assert sorted(r["b"] for r in got.where("k is null and one = 1").collect()) == list(range(n)) and got.count() == 2 * n


def brute_reasons(q, g, threshold=4):
    out = [f"same_{f}" for f in ("record_id", "study_id", "image_id", "image_sha256", "report_sha256") if q[f] and q[f] == g[f]]
    f = "patient_key" if q["patient_key"] or g["patient_key"] else "patient_id"
    out += ["same_patient_or_group"] if q[f] and q[f] == g[f] else []
    near = None not in (q["hi"], q["lo"], g["hi"], g["lo"]) and (q["hi"] ^ g["hi"]).bit_count() + (q["lo"] ^ g["lo"]).bit_count() <= threshold
    return out + ([f"image_phash_distance<={threshold}"] if near else [])


def test_neighbours_are_eligible_and_full(spark):
    rng = random.Random(9)
    pick = lambda *xs: rng.choice([None, "", *xs])
    names = [c.split()[0] for c in MANIFEST.split(", ") if c != "patient_reliable boolean"]
    made = [dict(record_id=f"r{k}", patient_id=pick("1", "2", "3"), patient_key=pick("d:1", "d:2"), study_id=pick("s", "t", "u"), image_id=f"i{k}", image_sha256=pick("x", "y"), report_sha256=pick("a", "b", "c", "d"), hi=rng.choice([None, 0, 5]), lo=rng.choice([None, 0, 7, 255])) for k in range(60)]
    vector = [[rng.gauss(0, 1) for _ in range(4)] for _ in made]
    ddl = ", ".join(f"{{0}}_{n} {'long' if n in ('hi', 'lo') else 'string'}" for n in names)
    side = lambda t, v, some: spark.createDataFrame([(k, vector[k], *[made[k][n] for n in names]) for k in some], f"{t}_id long, {v} array<double>, {ddl.format(t)}")
    queries, gallery = side("query", "q", range(6)), side("gallery", "g", range(60))
    got = {}
    for r in retrieval.safe_top_k(queries, gallery, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["gallery_id"]))
    score = lambda a, b: sum(x * y for x, y in zip(vector[a], vector[b], strict=True))
    for q in range(6):
        best = sorted((g for g in range(60) if not brute_reasons(made[q], made[g])), key=lambda g: (-score(q, g), g))[:3]
        assert [g for _, g in sorted(got[q])] == best
    for bad, message in (((queries, gallery, 0), "positive"), ((queries, gallery.limit(2), 3), "fewer than 3 rows"), ((queries, gallery, 59), "fewer than 59 eligible")):
        with pytest.raises(Exception, match=message):
            retrieval.safe_top_k(*bad).collect()
    raw = retrieval.top_k(queries, gallery, 3)
    audit = {r["query_id"]: r["reasons"] for r in retrieval.neighbor_audit(queries, raw, gallery, 3).collect()}
    for q in range(6):
        near = [r["gallery_id"] for r in raw.collect() if r["query_id"] == q]
        assert audit.get(q, []) == sorted({x for g in near for x in brute_reasons(made[q], made[g])})
    assert retrieval.neighbor_audit(queries, retrieval.safe_top_k(queries, gallery, 3), gallery, 3).count() == 0
    assert retrieval.neighbor_audit(queries, raw.where("query_id <> 2 or rank < 3"), gallery, 3).where("query_id = 2").first()["n_neighbors"] == 2


def test_evidence_and_records_hold_whole_texts(spark, tmp_path, monkeypatch):
    import hashlib
    import json

    import numpy as np

    from cohortlens.operators import records
    from cohortlens.plans import fixtures, queries

    rng = random.Random(5)
    texts = {k: f"begin{k} " + "word " * rng.randrange(1, 90) + f'"quoted" \\ end{k}' for k in range(40)} | {3: "long " * 100_000 + "end3"}
    vectors = {k: [rng.gauss(0, 1) for _ in range(6)] for k in texts}
    spark.createDataFrame([(k, t, f"s{k % 5}", "en") for k, t in texts.items()], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, v, k % 4) for k, v in vectors.items()], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))

    got = {r["query_id"]: (r["n_neighbors"], r["prompt_hash"]) for r in queries.QUERIES["evidence_prompt"](spark, str(tmp_path)).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in vectors.items()}
    wanted, named = {}, {r["doc_id"]: r for r in fixtures.manifest(spark, str(tmp_path)).collect()}
    for q in (0, 20):
        near = sorted(((float(unit[q] @ unit[g]), g) for g in texts if not brute_reasons(named[q], named[g])), reverse=True)[:10]
        prompt = "\n\n".join(f"REFERENCE {i} (similarity={round(s, 3):.6f}):\n{texts[g]}" for i, (s, g) in enumerate(near, 1))
        wanted[q] = (10, hashlib.sha256(prompt.encode()).hexdigest())
    assert got == wanted

    seen, standardize = [], records.standardize
    monkeypatch.setattr(records, "standardize", lambda df: seen.append(df) or standardize(df))
    assert sum(r["n"] for r in queries.QUERIES["verifier_records"](spark, str(tmp_path)).collect()) == len(texts)
    raw = [r["raw"] for r in seen[0].collect()]
    assert len(raw) == len(texts)
    # the mark at the end of each text is in one record
    assert sorted(int(m) for x in raw for m in re.findall(r"end(\d+)", x)) == sorted(texts)


@pytest.mark.parametrize("fractions", [(0.8, 0.1, 0.1), (0.5, 0.5), (0.1, 0.2, 0.3, 0.4), (1.0,)])
def test_levels_of_equal_sizes_are_the_greedy_fold(fractions):
    rng = random.Random(3)
    for _ in range(300):
        levels = [(n, rng.choice((1, 2, 7, 40))) for n in rng.sample(range(1, 30), rng.randrange(0, 6))] + [(rng.choice((31, 200, 2000)), 1)]
        wanted = sampling.greedy_split([((n, i), n) for n, c in levels for i in range(c)], fractions, lambda g: g[1])
        got = {(n, i): turns[(i - a) % len(turns)] for n, a, b, turns in sampling.level_turns(levels, fractions) for i in range(a, b)}
        assert got == wanted


def test_grouped_split_is_one_rule_at_all_sizes(spark):
    import hashlib

    sizes = {f"g{k}": 1 + k % 4 for k in range(300)} | {"hot": 375, None: 3, "big": 40}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, n int").repartition(7)
    wanted = sampling.greedy_split(list(sizes.items()), (0.8, 0.1, 0.1), lambda g: hashlib.md5(f"20260831|{g}".encode()).hexdigest())
    for limit in (100_000, 10):
        done = sampling.grouped_split(df, "g", broadcast_bytes=limit)
        assert done.columns == ["g", "n", "split"] and done.count() == sum(sizes.values())
        assert {r["g"]: ("train", "validation", "test").index(r["split"]) for r in done.select("g", "split").distinct().collect()} == wanted
        n = {r["split"]: r["count"] / sum(sizes.values()) for r in done.groupBy("split").count().collect()}
        assert all(abs(n[k] - f) < 0.005 for k, f in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert sampling.grouped_split(df.limit(0), "g").count() == 0


def test_rouge_counts_inflected_forms_as_matches(spark, tmp_path):
    from cohortlens.functions.stemming import rouge_stem
    from cohortlens.plans import queries

    df = spark.createDataFrame([("the lungs are cleared", "the lung are clearing")], "r string, h string")
    assert df.select(text_metrics.rouge_l(F.col("r"), F.col("h"))).first()[0] == 1.0
    assert df.select(text_metrics.rouge_l(F.col("r"), F.col("h"), None)).first()[0] == 0.5
    texts = ["lungs lung clear clears cleared lung", "heart hearts enlarging enlarged x1 hearts heart"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["rouge_l"] for r in queries.QUERIES["rouge_l"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        a = [rouge_stem(w) for w in text.split()]
        b = [rouge_stem("x" if i % 5 == 4 else w) for i, w in enumerate(text.split())]
        assert got[k] == round(2 * lcs(a, b) / (len(a) + len(b)), 6)

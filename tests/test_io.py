import json

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.gates import GateError
from cohortlens.sources import readers, sinks
from cohortlens.streaming import incremental


def test_jsonl(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": null}\n')
    assert readers.read_jsonl(spark, str(good)).count() == 2
    assert readers.read_fields(spark, str(good), "id long", ["id"]).count() == 2
    with pytest.raises(GateError, match="lacks a field"):
        readers.read_fields(spark, str(good), "id long, t string", ["id"])
    bad = tmp_path / "b.jsonl"
    for text in ('{"id": 1}\n{"id": 2', '{"id": 1}\n[1]\n'):
        bad.write_text(text)
        with pytest.raises(GateError, match="not a JSON object"):
            readers.read_jsonl(spark, str(bad), "id long")
    bad.write_text('{"id": 1}\n{"id": 1}\n')
    with pytest.raises(GateError, match="repeated"):
        readers.read_fields(spark, str(bad), "id long", ["id"])


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": 1, "records": [{"a": 1}, {"a": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1}]))
    (tmp_path / "c.csv").write_text('a,b\n1,"x, ""y"""\n')
    (tmp_path / "d.tsv").write_text("a\tb\n1\tx\n")
    spark.range(3).write.parquet(str(tmp_path / "e.parquet"))
    read = lambda name: readers.read_table(spark, str(tmp_path / name))
    assert read("a.json").count() == 2 and read("b.json").count() == 1 and read("c.csv").first()["b"] == 'x, "y"' and read("d.tsv").first()["b"] == "x" and read("e.parquet").count() == 3
    with pytest.raises(ValueError):
        read("f.xls")


def test_pairs_and_inventory(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("x/1.jpg", "x/1.json", "x/2.PNG", "x/2.json"):
        (tmp_path / name).write_text('{"labels": []}' if name.endswith("json") else name)
    pairs = readers.asset_pairs(spark, str(tmp_path))
    assert {r["record"] for r in pairs.collect()} == {"1", "2"}
    assert pairs.where(readers.labels_key_present(F.col("metadata"))).count() == 2
    (tmp_path / "x/3.jpg").write_text("z")
    with pytest.raises(GateError, match="without JSON"):
        readers.asset_pairs(spark, str(tmp_path))
    assert readers.asset_pairs(spark, str(tmp_path), strict=False).count() == 3
    assert readers.inventory(spark, str(tmp_path), r".*\.json$").count() == 2


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<double>")
    sinks.write_vectors(df, str(tmp_path / "v.parquet"))
    assert {r["id"]: r["embedding"] for r in readers.read_embeddings(spark, str(tmp_path / "v.parquet"), "id").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    with pytest.raises(GateError):
        readers.read_embeddings(spark, str(tmp_path / "text_v.parquet"), "id")
    spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema).write.parquet(str(tmp_path / "w.parquet"))
    with pytest.raises(GateError, match="several lengths"):
        readers.read_embeddings(spark, str(tmp_path / "w.parquet"), "id")


def test_documents(tmp_path):
    path = str(tmp_path / "f.json")
    sinks.freeze_document({"a": 1}, path)
    sinks.freeze_document({"a": 1}, path)
    with pytest.raises(GateError):
        sinks.freeze_document({"a": 2}, path)
    with pytest.raises(ValueError):
        sinks.write_document({"a": float("nan")}, path)
    assert readers.read_document(path) == {"a": 1}
    assert readers.choose_file(["x/b", "x/a"], ("a",), "file") == "x/a"
    with pytest.raises(GateError):
        readers.choose_file(["x/b", "x/c"], ("a",), "file")


def test_pending_and_resume(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    log = spark.createDataFrame([("a", True), ("b", False)], "id string, ok boolean")
    done, again = incremental.resume_audit(log, "id", plan, F.col("ok"))
    assert [r["id"] for r in done.collect()] == ["a"] and [r["id"] for r in again.collect()] == ["b"]
    assert {r["id"] for r in incremental.pending(plan, done, ["id"]).collect()} == {"b", "c"}
    with pytest.raises(GateError, match="outside the plan"):
        incremental.resume_audit(spark.createDataFrame([("z", True)], log.schema), "id", plan, F.col("ok"))


def test_append_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: incremental.append_once(spark, source, "id long", lambda df: df.withColumn("x", F.col("id") * 2), "id", target, checkpoint).awaitTermination()
    spark.range(3).write.parquet(source)
    run()
    spark.range(2, 5).write.mode("append").parquet(source)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "a", 4.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["total"] for r in incremental.windowed_counts(df, "t", ["k"], "v").collect()) == [3.0, 4.0]


def test_statistics_frame(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    row = lambda i, c, v=None, score="0.5": json.dumps({"generation_record_id": str(i), "query_record_id": "q", "condition": c, "reference_vector": [0] * 13, "prediction_vector": v or [1] * 13, "score": score})
    path.write_text("\n".join([row(1, "A"), row(2, "B", score="x")]))
    assert [r["score"] for r in readers.read_statistics(spark, str(path), ("A", "B")).orderBy("generation_record_id").collect()] == [0.5, None]
    for lines, conditions in (([row(1, "A")], ("A", "B")), ([row(1, "A"), row(1, "A")], ("A",)), ([row(1, "A", [2] * 13)], ("A",))):
        path.write_text("\n".join(lines))
        with pytest.raises(GateError):
            readers.read_statistics(spark, str(path), conditions)


def test_close_and_equal_sets(spark):
    from cohortlens.functions.sequences import causal_features
    from cohortlens.operators import gates

    a = spark.createDataFrame([("x", 1.0), ("y", None)], "k string, v double")
    gates.require_close(a, spark.createDataFrame([("x", 1.0 + 1e-12), ("y", None)], a.schema), ["k"], "v")
    for other in ([("x", 1.1), ("y", None)], [("x", 1.0)], [("x", 1.0), ("y", 0.0)], [("x", 1.0), ("x", 1.0), ("y", None)]):
        with pytest.raises(GateError):
            gates.require_close(a, spark.createDataFrame(other, a.schema), ["k"], "v")
    assert {tuple(r) for r in gates.set_differences(a, spark.createDataFrame([("x",), ("z",)], "k string"), ["k"]).collect()} == {("y", "left"), ("z", "right")}
    df = spark.createDataFrame([([1, 2, 3], [7, 8]), (None, [7]), ([1], list(range(9)))], "p array<int>, t array<int>")
    got = [tuple(r["f"]) for r in df.select(causal_features(F.col("p"), F.col("t"), 4).alias("f")).collect()]
    assert got == [([2, 3, 7, 8], [-100, -100, 7, 8]), ([7], [7]), ([0, 1, 2, 3], [0, 1, 2, 3])]

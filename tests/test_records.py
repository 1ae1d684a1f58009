import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import images
from cohortlens.operators import provenance, records
from cohortlens.operators.gates import GateError


def standardize(spark, *rows):
    return records.standardize(spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string"))


def test_records_of_several_shapes(spark):
    flat = {"id": "a", "patient_id": "p", "report": " r ", "label": 1, "task": "t"}
    nested = {"meta": {"subject_id": "s"}, "input": "i", "ground_truth": {"answer": "TRUE"}, "provenance": {"file_name": "f"}}
    chat = {"file_name": "f.jpg", "messages": [{"role": "human", "content": [{"type": "text", "text": "one"}, {"content": ["two"]}]}, {"from": "gpt", "content": "Answer: false"}]}
    prompt = {"uid": "u", "harmony_prompt": json.dumps([{"role": "user", "content": {"text": "q"}}]), "output": True}
    got = {r["source_record_id"] or r["verifier_record_id"]: r for r in standardize(spark, flat, nested, chat, prompt).collect()}
    assert (got["a"]["report_text"], got["a"]["verdict"], got["a"]["verdict_source"], got["a"]["grouping_level"], got["a"]["task"]) == ("r", True, "label", "patient", "t")
    assert (got["f"]["patient_or_source_group"], got["f"]["verdict_source"]) == ("s", "ground_truth.answer")
    c = got["f.jpg"]
    assert (c["report_text"], c["verdict"], c["verdict_source"], c["grouping_level"], c["patient_id"]) == ("one\ntwo", False, "messages.assistant", "source_report_or_image", None)
    assert (got["u"]["report_text"], got["u"]["verdict"], got["u"]["patient_id"]) == ("q", True, "u")
    assert got["f"]["verifier_record_id"].startswith("verifier:")


@pytest.mark.parametrize(("row", "message"), [({"report": "r", "label": 1}, "lacks patient and source"), ({"uid": "u", "label": 1, "report": " "}, "has no text"), ({"uid": "u", "report": "r", "label": "maybe"}, "unrecognized verdict"), ({"uid": "u", "report": "r"}, "unrecognized verdict")])
def test_unusable_records_raise(spark, row, message):
    with pytest.raises(Exception, match=message):
        standardize(spark, row).collect()


def test_identifiers(spark):
    rows = [("mimic", {"subject_id": 7, "study_id": "s"}), ("other", {"patient_id": "p"}), ("other", {"uid": "u"}), ("other", {}), ("MIMIC-CXR", {"patient_id": "p"})]
    df = spark.createDataFrame([(k, d, json.dumps(r)) for k, (d, r) in enumerate(rows)], "k int, d string, raw string")
    got = [tuple(r["x"]) for r in df.select("k", records.identifiers(F.col("raw"), F.col("d")).alias("x")).orderBy("k").collect()]
    assert got == [("7", "subject_id", True, "s"), ("p", "patient_id", True, None), ("u", "uid_assumed_group", False, "u"), (None, "missing", False, None), ("p", "patient_id", True, None)]


def png(pixels):
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_perceptual_hash(spark, tmp_path):
    rng = np.random.default_rng(1)
    smooth = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 20))).astype(np.uint8)
    for name, image in (("a", smooth), ("b", np.clip(smooth.astype(int) + 3, 0, 255).astype(np.uint8)), ("c", rng.integers(0, 255, (90, 70)).astype(np.uint8))):
        (tmp_path / f"{name}.png").write_bytes(png(image))
    rows = spark.read.format("image").load(str(tmp_path)).select(F.regexp_extract("image.origin", r"(\w)\.png$", 1).alias("n"), images.perceptual_hash(F.col("image")).alias("h")).collect()
    found = {r["n"]: int(r["h"], 16) for r in rows}
    assert (found["a"] ^ found["b"]).bit_count() <= 4 < (found["a"] ^ found["c"]).bit_count()
    assert images.hash_of(smooth) == f"{found['a']:016x}"
    assert images.grey(np.array([[[0, 0, 255], [255, 255, 255]]], dtype=np.uint8)).tolist() == [[76, 255]]


def test_plans_and_status(spark, tmp_path):
    path = str(tmp_path / "plan.json")
    plan = provenance.freeze_plan({"seed": 1, "models": ["a"]}, path)
    assert provenance.load_plan(path) == plan == provenance.freeze_plan({"seed": 1, "models": ["a"]}, path)
    with pytest.raises(GateError):
        provenance.freeze_plan({"seed": 2}, path)
    (tmp_path / "plan.json").write_text(json.dumps(plan | {"seed": 3}))
    with pytest.raises(GateError, match="changed"):
        provenance.load_plan(path)
    first, second = str(tmp_path / "1.json"), str(tmp_path / "2.json")
    provenance.write_status(first, "one", {"t": "x"})
    provenance.write_status(second, "two", {}, upstream=first)
    assert provenance.read_status(second, first)["stage"] == "two"
    provenance.write_status(first, "one", {"t": "y"})
    with pytest.raises(GateError, match="another upstream"):
        provenance.read_status(second, first)
    provenance.write_status(first, "one", {}, ready=False)
    with pytest.raises(GateError, match="isn't ready"):
        provenance.read_status(first)
    assert provenance.run_metadata(spark, {"a": 1})["config_sha256"] == provenance.digest({"a": 1})


def test_sentinels(spark):
    rows = spark.createDataFrame([("a", "x")], "id string, text string")
    known = spark.createDataFrame([("s1", "no edema", 0)], "id string, text string, want int")
    batch = provenance.with_sentinels(rows, known.drop("want"))
    scored = batch.withColumn("score", F.lit(0))
    expected = known.select("id", F.col("want").alias("score"))
    assert [r["id"] for r in provenance.without_sentinels(scored, expected, "id", "score").collect()] == ["a"]
    for bad in (scored.withColumn("score", F.lit(1)), scored.where("id <> 's1'")):
        with pytest.raises(GateError, match="sentinel"):
            provenance.without_sentinels(bad, expected, "id", "score")
    provenance.require_reproduced(spark.createDataFrame([(0.995,)], "s double"), "s")
    with pytest.raises(GateError):
        provenance.require_reproduced(spark.createDataFrame([(0.9,)], "s double"), "s")

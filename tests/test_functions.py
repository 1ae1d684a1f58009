import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import hashing as H
from cohortlens.functions import labels as L
from cohortlens.functions import text as X


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def test_text_normalization_and_hashes(spark):
    assert one(spark, X.clean(F.lit("  a \t b\n"))) == "a b"
    assert one(spark, X.normalize(F.lit("A,b--C é 1"))) == "a b c 1"
    assert one(spark, X.text_hash(F.lit("A b!"))) == hashlib.sha256(b"a b").hexdigest()
    assert one(spark, X.text_hash(F.lit(" .. "))) is None
    assert one(spark, X.text_hash(F.lit(None).cast("string"))) is None


def test_labels(spark):
    raw = F.array(F.lit("Pleural_Effusion"), F.lit(" EDEMA "), F.lit("edema"), F.lit("what"))
    assert one(spark, L.normalize_labels(raw)) == ["pleural effusion", "edema"]
    assert one(spark, L.normalize_labels(F.lit(None).cast("array<string>"))) == []
    vector = one(spark, L.label_vector(F.array(F.lit("atelectasis"), F.lit("Pleural_effusion"), F.lit("support devices")), strict=True))
    assert [i for i, x in enumerate(vector) if x] == [0, 8, 12]
    assert one(spark, L.label_vector(F.lit(None).cast("array<string>"), strict=True)) == [0] * 13
    with pytest.raises(Exception, match="unknown labels"):
        one(spark, L.label_vector(F.array(F.lit("what")), strict=True))


def test_states(spark):
    given = F.create_map(F.lit("Edema"), F.lit(-1), F.lit("No Finding"), F.lit(1), F.lit("fracture"), F.lit(None).cast("int"), F.lit("pneumonia"), F.lit(-1))
    assert one(spark, L.vector_of_states(given)) == [1 if x == "edema" else 0 for x in L.LABELS]
    with pytest.raises(Exception, match="state of edema"):
        one(spark, L.vector_of_states(F.create_map(F.lit("edema"), F.lit(7))))
    with pytest.raises(ValueError):
        L.vector_of_states(given, {"edema": 1})


def brute_flags(text, labels):
    out = set()
    for label in labels:
        for m in re.finditer(rf"\b{label}\b", text):
            before = " ".join(text[max(0, m.start() - 80) : m.start()].split()[-8:])
            if re.search(L.NEGATION, before):
                out.add(label)
    return sorted(out)


def test_negation_flags(spark):
    rng = random.Random(1)
    words = ["no", "not", "edema", "fracture", "seen", "free", "of", "negative", "for", "averyveryverylongwordindeed", "x", "evidence"]
    texts = ["no pleural effusion", "effusion absent edema", "no a b c d e f g h edema", ""] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    labels = ["edema", "fracture", "pleural effusion"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", L.negation_flags(F.col("t"), F.array(*[F.lit(x) for x in labels])).alias("f")).collect()
    assert {r["k"]: r["f"] for r in rows} == {k: brute_flags(t, labels) for k, t in enumerate(texts)}


def test_hamming_and_bands(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    hashes += [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << 63) for h in hashes]
    df = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(hashes)], "id int, h string")
    hi, lo = H.halves(F.col("h"))
    from cohortlens.operators.cohort import near_hash_pairs

    rows = df.select("id", hi.alias("hi"), lo.alias("lo"))
    for threshold in (0, 4):
        found = {(r["id_a"], r["id_b"]) for r in near_hash_pairs(rows, rows, threshold).where("id_a < id_b").collect()}
        assert found == {(a, b) for a, b in itertools.combinations(range(len(hashes)), 2) if (hashes[a] ^ hashes[b]).bit_count() <= threshold}
    assert one(spark, H.hamming(*H.halves(F.lit("x")), *H.halves(F.lit("0" * 16)))) is None


def test_verdicts(spark):
    for text, value in (("TRUE", True), ("answer: false", False), ("uncertain", None), ("false then true", False), ("untrue", None)):
        assert one(spark, X.parse_verdict(F.lit(text))) is value
    assert one(spark, X.parse_target(F.lit(" Supported "))) is True
    assert one(spark, X.parse_target(F.lit("verdict = FALSE"))) is False
    with pytest.raises(Exception, match="unrecognized verdict"):
        one(spark, X.parse_target(F.lit("maybe")))


def test_chat_messages(spark):
    df = spark.createDataFrame([([("Human", " hi "), ("gpt", "a"), ("bot", "b"), ("system", " "), (None, "x")],)], "m array<struct<role:string,content:string>>")
    m = df.select(X.chat_messages(F.col("m")).alias("m"))
    assert [tuple(x) for x in m.first()["m"]] == [("user", "hi"), ("assistant", "a"), ("assistant", "b")]
    assert m.select(X.last_content(F.col("m"), "assistant").alias("x")).first()["x"] == "b"
    assert m.select(X.last_content(F.col("m"), "system").alias("x")).first()["x"] is None


def test_evidence_and_shortening(spark):
    df = spark.createDataFrame([([(" r1 ", None, None, 0.5), ("", "", "cap", None)],)], "n array<struct<report_text:string,report:string,caption:string,score:double>>")
    assert df.select(X.evidence_block(F.col("n")).alias("x")).first()["x"] == "REFERENCE 1 (similarity=0.500000):\nr1\n\nREFERENCE 2 (similarity=0.000000):\ncap"
    long = "".join(chr(97 + i % 26) for i in range(5000))
    cut = one(spark, X.shortened(F.lit(long), 1000, "<end>", "<cut>"))
    payload = 1000 - 5 - 5
    assert cut == long[: payload // 3] + "<cut>" + long[-(payload - payload // 3) :] + "<end>"
    assert one(spark, X.shortened(F.lit("short"), 1000, "<end>", "<cut>")) == "short<end>"
    with pytest.raises(ValueError):
        X.shortened(F.lit("x"), 999, "", "")


def test_stable_key(spark):
    assert one(spark, X.stable_key({"record_id": F.lit(" "), "uid": F.lit("7")})) == "uid:7"
    with pytest.raises(Exception, match="no stable identifier"):
        one(spark, X.stable_key({"record_id": F.lit(None)}))

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import fingerprint as P


def words_of(text):
    return text.lower().split()


def sets(text, width=5):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def corpus(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["a", "b", "c", "dd", "É"]) for _ in range(rng.choice((0, 1, 3, 4, 5, 6, 40, 300)))) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 6])
def test_sketches_are_exact_below_k(spark, width):
    texts = corpus(1, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("s", P.sketch(F.col("t"), 10000, width))
    rows = {r["k"]: r["s"] for r in df.collect()}
    assert all(s == sorted(set(s)) and len(s) == len(sets(texts[k], width)) for k, s in rows.items())
    for a in range(0, 60, 7):
        for b in range(0, 60, 5):
            assert len(set(rows[a]) & set(rows[b])) == len(sets(texts[a], width) & sets(texts[b], width))


def test_estimates(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    pairs = [(" ".join(base), " ".join(base[2000:] + [f"v{i}" for i in range(2000)])), (" ".join(base[:3000]), " ".join(base)), ("", ""), ("a", ""), ("a b", "A  B")]
    df = spark.createDataFrame(pairs, "a string, b string").select("*", P.sketch(F.col("a"), 512).alias("x"), P.sketch(F.col("b"), 512).alias("y"))
    got = df.select("a", "b", P.resemblance(F.col("x"), F.col("y"), 512).alias("r"), P.containment(F.col("x"), F.col("y"), 512).alias("c"), P.cardinality(F.col("x"), 512).alias("n")).collect()
    for r, (a, b) in zip(got, pairs, strict=True):
        s, t = sets(a), sets(b)
        if len(s) > 512:
            assert abs(r["r"] - len(s & t) / len(s | t)) < 0.08 and abs(r["c"] - len(s & t) / len(s)) < 0.15 and abs(r["n"] / len(s) - 1) < 0.15
    assert [r["r"] for r in got[2:]] == [1.0, 0.0, 1.0] and got[2]["n"] == 0


def test_sketches_merge(spark):
    texts = corpus(3, 40)
    df = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "g int, t string").withColumn("s", P.sketch(F.col("t"), 16))
    merged = {r["g"]: r["s"] for r in P.merged(df, ["g"], "s", 16).collect()}
    whole = {}
    for r in df.collect():
        whole.setdefault(r["g"], set()).update(r["s"])
    assert merged == {g: sorted(s)[:16] for g, s in whole.items()}
    two = df.select(P.merge(F.col("s"), F.reverse("s"), 16).alias("m"), "s").collect()
    assert all(r["m"] == r["s"] for r in two)


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_edited_texts(spark, docs_of, parts):
    texts = [*corpus(4, 30), None, "", "é😀" * 50, "z " * 30000]
    ids = [random.Random(5).randrange(-50, 10**5) + 7 * k for k in range(len(texts))]
    ids[4] = None
    ids[9] = ids[10]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = P.fingerprints(docs_of(texts, ids)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(zip(ids, [t or "" for t in texts], strict=True), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    wanted = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(wanted, key=str)
    same = {}
    for r in got:
        same.setdefault(r["fingerprint"], set()).add(r["n_shingles"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in same.values())


def test_small_tables(docs_of):
    assert P.fingerprints(docs_of(["x"]).limit(0)).count() == 0
    one = P.fingerprints(docs_of(["abc def"])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest()


def test_text_ids(docs_of, spark):
    texts = [*corpus(6, 60), None]
    ids = [None if k == 7 else f"id{k * 37 % 61:02d}" for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string").repartition(3)
    got = {r["doc_id"]: r["edited_sha256"] for r in P.fingerprints(df).collect()}
    order = sorted(zip(ids, [t or "" for t in texts], strict=True), key=lambda x: (x[0] is None, [-ord(c) for c in x[0] or ""]))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + following[: len(t) // 3]).encode()).hexdigest()
    assert P.fingerprints(df.limit(0)).count() == 0

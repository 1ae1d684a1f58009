import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, lang, n):
    syllables = {"en": ["the", "ing", "and", "er", "st"], "de": ["ung", "sch", "ich", "ein", "keit"]}[lang]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents whose fate is known: toxic, without letters, copies, test items, clean."""
    rng = random.Random(1)
    folder = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(words(rng, "en", 30))
    rows, labels, fate = [], [], {}
    for k in range(300):
        lang = rng.choice(["en", "de"])
        text = words(rng, lang, 60)
        kind = ("clean", "clean", "clean", "toxic", "clean", "letters", "copy", "leak")[k % 8]
        if kind == "toxic":
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["vermin", "scumbag"]))
        if kind == "letters":
            noise = "".join(rng.choice("qxzjvkwqp") for _ in range(200)).upper()
            text = ["12", "34", "!!"] if k % 16 < 8 else [noise[i : i + 7] for i in range(0, 200, 7)]
            lang = None if k % 16 >= 8 else lang
        if kind == "leak":
            text[20:20] = item.split()
        text = " ".join(text)
        if kind == "copy":
            text = rows[k - 2][1] + " more" if fate[k - 2] == "clean" else text
            kind = "copy" if fate[k - 2] == "clean" else "clean"
        rows.append((k, text, lang, "s0", len(text), "extra"))
        labels.append((k, 1, int(kind == "toxic")))
        fate[k] = kind
    rows.append((900, None, None, "s1", None, "extra"))
    fate[900] = "letters"
    write = lambda data, schema, name: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    write(rows, "doc_id long, text string, lang string, source string, n_chars long, score string", "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write([(1, item)], "item_id long, text string", "benchmark")
    return folder, fate


def test_stages_take_what_they_should(spark, tables, tmp_path):
    folder, fate = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    removed = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        following = spark.read.parquet(str(tmp_path / name))
        removed.append({r["doc_id"] for r in docs.select("doc_id").exceptAll(following.select("doc_id")).collect()})
        docs = following
    assert removed == [{k for k, f in fate.items() if f == x} for x in ("toxic", "letters", "copy", "leak")] + [set()]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in docs.collect()} == {k for k, f in fate.items() if f == "clean"}


def test_run(spark, tables):
    folder, fate = tables
    assert {r["doc_id"] for r in pipeline.run(spark, folder).collect()} == {k for k, f in fate.items() if f == "clean"}


def test_empty_documents(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.limit(0) if name == "documents" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeats_long_texts_and_no_items(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(words(rng, "en", 60_000))
    rows = [(k, " ".join(words(rng, "en", 40)), "en") for k in range(60)] + [(5, "the ing and erst the and", "en"), (70, long, "en"), (71, long + " the", "en"), (72, "", "en"), (None, "the and ing er st", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, k % 2) for k in range(4)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([*range(60), 5, 70, None], key=str)

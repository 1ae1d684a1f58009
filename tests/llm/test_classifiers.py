import random
import time

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import language_id, quality, sampling, toxicity

SYLLABLES = {"aa": ["the", "ing", "and", "er", "th"], "bb": ["der", "ung", "sch", "ich", "ein"], "cc": ["el", "ción", "que", "os", "la"]}


def text_in(lang, rng, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_profiles_by_brute_force(spark, docs_of):
    rng = random.Random(1)
    rows = [(k, lang, text_in(lang, rng)) for k, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(90))]
    labelled = spark.createDataFrame([*rows, (900, None, "x"), (901, "aa", None)], "doc_id long, lang string, text string")
    profiles = language_id.fit(labelled, "doc_id", "text", "lang")
    assert sorted(profiles) == ["aa", "bb", "cc"]

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        counts = {}
        for w in words:
            padded = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g.strip() and not (n == 2 and g == "  ") and not (n == 3 and g[1] == " "):
                        counts[g] = counts.get(g, 0) + 1
        return counts

    def key(g):
        out = 0
        for c in g:
            out = out << 21 | ord(c)
        return out

    def top(counts, n):
        return [key(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:n]]

    for lang in SYLLABLES:
        total = {}
        for _, x, t in rows:
            if x == lang:
                for g, n in grams(t).items():
                    total[g] = total.get(g, 0) + n
        assert profiles[lang].tolist() == top(total, 400)

    tests = [text_in(x, rng, n) for x in SYLLABLES for n in (1, 5, 60)] + [None, "", " 12 !!", "The ÉING", "x" * 50000, "日本"]
    got = {r["doc_id"]: r for r in language_id.identify(docs_of(tests), profiles).collect()}
    for k, t in enumerate(tests):
        mine = top(grams(t or ""), 300)
        if not mine:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        place = {x: {g: i for i, g in enumerate(p.tolist())} for x, p in profiles.items()}
        cost = sorted((sum(abs(place[x][g] - i) if g in place[x] else 400 for i, g in enumerate(mine)), x) for x in profiles)
        assert got[k]["lang_pred"] == cost[0][1]
        assert abs(got[k]["score"] - (cost[1][0] - cost[0][0]) / max(cost[1][0], 1)) < 1e-12


def test_language_without_training_rows(docs_of, spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    profiles = language_id.fit(empty, "doc_id", "text", "lang")
    assert [r["lang_pred"] for r in language_id.identify(docs_of(["the"]), profiles).collect()] == ["und"]
    assert language_id.identify(docs_of(["the"]).limit(0), profiles).count() == 0


def test_bounded_sample(spark):
    df = spark.createDataFrame([(k, k % 3 if k % 7 else None) for k in range(300)], "id long, c int")
    got = {r["c"]: r["count"] for r in sampling.bounded(df, "id", "c", 20).groupBy("c").count().collect()}
    assert got == {0: 20, 1: 20, 2: 20}
    assert sampling.bounded(df, "id", "c", 1000).count() == df.where("c is not null").count()


def test_bounded_sample_takes_the_smallest_hashes(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') as c").union(spark.sql("select cast(null as long), 'a'"))
    hashes = df.selectExpr("c", "xxhash64(id) & 9223372036854775807 as h").collect()
    want = {c: sorted(r["h"] for r in hashes if r["c"] == c)[:500] for c in "ab"}
    got = sampling.bounded(df, "id", "c", 500).selectExpr("c", "xxhash64(id) & 9223372036854775807 as h").collect()
    assert {c: sorted(r["h"] for r in got if r["c"] == c) for c in "ab"} == want
    assert sampling.bounded(df.limit(0), "id", "c", 5).count() == 0


def test_terms_are_taken_while_they_gain():
    terms = [f"{k:03d}x" for k in range(700)]
    rows = [[k] for k in range(700) for _ in range(5)]
    assert len(toxicity.select(terms, rows, np.zeros(700))) == 700  # each stands in four rows or more
    rows = [[k] for k in range(200) for _ in range(5)]
    assert sorted(toxicity.select(terms, rows, np.zeros(700))) == list(range(200))


def test_exception_phrases_are_learned(spark, docs_of):
    rng = random.Random(6)
    rows, labels = toxic_corpus(rng)
    rows = [t + " pond scum here" if not y and k % 20 == 0 else t for t, (k, y) in zip(rows, labels, strict=True)]
    lexicon = toxicity.fit(docs_of(rows), spark.createDataFrame([(k, y) for k, y in labels], "doc_id long, toxic int"))
    assert toxicity.phrases("Pond  scum, pond scum here", toxicity.automaton([("scu", True)])) == {"pond scum", "scum here"}
    assert "scum" in {t[0] for t in lexicon.terms} and {"pond scum", "scum here"} <= set(lexicon.exceptions)
    got = [r["hits"] for r in toxicity.score(docs_of(["a pond scum here", "you scum"]), lexicon).orderBy("doc_id").collect()]
    assert got == [0, 1]


def test_phrases_and_hits_of_very_long_texts():
    made = toxicity.automaton([("scu", True), ("pond", False)])
    long = "x" * 200_000
    start = time.process_time()
    assert toxicity.phrases(f"{long} scum {long}", made) == {f"{long} scum", f"scum {long}"}
    many = "pond scum, scum " * 20_000
    assert toxicity.phrases(many, made) == {"pond scum", "scum pond"}
    assert toxicity.hits(many, toxicity.automaton([("scu", True), ("pond", False)], ("pond scum",)), [1, 1]) == {0: 20_000}
    assert time.process_time() - start < 10
    assert toxicity.phrases("scum", made) == set() and toxicity.phrases(" scum_x scum ", made) == {"scum_x scum"}


def test_rare_terms_are_learned():
    """A term of four toxic rows counts however many rows there are."""
    rows = [[0]] * 3990 + [[1]] * 4 + [[2]] * 3
    assert sorted(toxicity.select(["vermin", "scumbag", "seldom"], rows, np.zeros(3))) == [0, 1]


def test_folding():
    lexicon = [("idiot", False), ("moron", False), ("bad", True)]
    made = toxicity.automaton(lexicon, ("moron bird",))
    count = lambda text: toxicity.hits(text, made, [1, 1, 1])
    for text in ("IDIOT", "1d10t!", "іdіоt", "ｉｄｉｏｔ", "id​iot", "ídiòt", "an idiot.", "(idi0t)"):
        assert count(text) == {0: 1}, text
    for text in ("idiots", "xidiot", "idio", "", "4644348", "diot"):
        assert count(text) == {}, text
    assert count("badly bad sobad") == {2: 2}
    assert count("a moron bird and a moron") == {1: 1}
    assert toxicity.hits("bad", made, [1, 1, 2]) == {}


def toxic_corpus(rng, n=400):
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "vermin", "zorbly" + rng.choice("abcde")]))
        rows.append(" ".join(words))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_is_learned(spark, docs_of):
    rows, labels = toxic_corpus(random.Random(2))
    docs = docs_of(rows)
    table = spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, table.where("doc_id % 5 <> 0 or doc_id is null"))
    assert {"scum", "vermin"} <= {t[0] for t in lexicon.terms}
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    held = [(got[k]["predicted"], y) for k, y in labels if k % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    extra = {r["doc_id"]: r for r in toxicity.score(docs_of([None, "", "scum", "ѕсum " * 3, "w1 " * 60000]), lexicon).collect()}
    assert [extra[k]["predicted"] for k in range(5)] == [0, 0, 1, 1, 0] and extra[0]["score"] == extra[1]["score"]


def test_one_label_only(spark, docs_of):
    docs = docs_of(["a", None])
    for value in (0, 1):
        labels = spark.createDataFrame([(0, value, value)], "doc_id long, toxic int, quality int")
        assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {value}
        assert {r["predicted"] for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {value}
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_discriminant_by_brute_force():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(2, 0.5, (120, 3))])
    y = np.repeat([0, 1], [80, 120])
    model = quality.train(x, y, 0.6)
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / (len(y) - 2)
    density = []
    for c in (0, 1):
        z = x[y == c]
        s = 0.9 * np.cov(z.T) + 0.1 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-2 * np.diag(np.diag(pooled))
        d = x - z.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.difference(x), density[1] - density[0])
    assert ((model.probability(x) > 0.5) == (y == 1)).mean() > 0.95


def test_quality_is_learned(spark, docs_of):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "sea", "was", "blue", "and", "calm."]) + rng.choice(["", "ly", "s"]) for _ in range(rng.randrange(20, 90))).capitalize()
    bad = lambda: " ".join(rng.choice(["BUY", "NOW"]) + "!!" for _ in range(rng.randrange(20, 90)))
    labels = [(k, int(rng.random() < 0.7)) for k in range(200)]
    docs = docs_of([good() if y else bad() for _, y in labels] + [None, "", "x" * 40000])
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int").where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert np.mean([got[k]["predicted"] == y for k, y in labels if k % 5 == 0]) > 0.95
    assert all(0 <= got[k]["score"] <= 1 for k in got) and got[200]["score"] == got[201]["score"]


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "A b", "!! ||", "x | y\nx | y", "é1"]
    assert np.allclose(quality.statistics(texts), np.concatenate([quality.statistics([t]) for t in texts]))
    assert quality.statistics([]).shape == (0, len(quality.STATISTICS))


def test_columns_pass_through(docs_of):
    docs = docs_of(["scum", "fine"])
    lexicon = toxicity.Lexicon((("scum", False, 1, 3.0),), (3.0, 0.0), -2.0)
    kept = docs.where(toxicity.toxicity(docs, F.col("text"), lexicon)["score"] < 0.5)
    assert kept.columns == docs.columns and [r["text"] for r in kept.collect()] == ["fine"]


def test_profiles_and_the_farthest_document_come_from_all_rows(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(9000)]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    profiles = language_id.fit(rows, "doc_id", "text", "lang", profile=50)
    assert profiles["x"].tolist() == language_id.ranked(language_id.ngrams(texts)[0], 50).tolist()
    assert language_id.farthest(rows, profiles, "doc_id", "text", "lang") == max(language_id.predictor(profiles)(texts)[2].to_pylist())

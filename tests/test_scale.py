"""Operators that count, sample or search in blocks, against plain computations over whole inputs."""

import itertools
import json
import math
import os
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import labels, nested
from cohortlens.functions.hashing import draw, spread
from cohortlens.operators import audits, cohort, experiment, inference, manifest, metrics, ordering, quantiles, records, resampling, retrieval, revision, sampling, skew, text_metrics
from cohortlens.operators.gates import GateError
from cohortlens.sources import commits, shared
from cohortlens.streaming import incremental

# Numbers of whole tables


@pytest.fixture()
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize(("rows", "files"), [(100_000, 4), (1_000_000, 32)])
def test_numbers_of_large_tables_keep_every_row(spark, tmp_path, no_reuse, rows, files):
    key = F.format_string("k%09d", F.col("id") * 7919 % rows)
    spark.range(rows).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("x"), (F.col("id") % 7).alias("y")).repartition(files).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        done = ordering.numbered(spark.read.parquet(str(tmp_path / "t")), ["k"], "at")
        r = done.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("at").alias("d"), F.min("at").alias("a"), F.max("at").alias("b"), F.count_if(F.format_string("k%09d", F.col("at")) == F.col("k")).alias("right")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(r) == (rows, rows, 0, rows - 1, rows) and done.columns == ["k", "x", "y", "at"]


def test_numbers_of_small_tables(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    got = {r["v"]: r["at"] for r in ordering.numbered(df, ["k", "v"], "at").collect()}
    assert got == {2: 0, 3: 1, 4: 2, 1: 3}
    assert sorted(r["at"] for r in ordering.numbered(df.select("k"), ["k"], "at").collect()) == [0, 1, 2, 3]
    assert ordering.numbered(df.limit(0), ["k"], "at").collect() == []


def test_manifests_keep_their_rows(spark, no_reuse):
    pairs = spark.range(30_000).repartition(8).select(
        F.format_string("p%06d", "id").alias("record"), F.format_string("/x/%06d.png", "id").alias("image_path"), F.format_string("/x/%06d.json", "id").alias("json_path"),
        F.sha2(F.col("id").cast("string"), 256).alias("image_sha256"), F.concat(F.lit('{"uid":"u'), F.col("id").cast("string"), F.lit('","report":"some text"}')).alias("metadata"),
    )
    done = manifest.describe(pairs, "set", "all")
    wrong = done.where(F.concat(F.lit("set:all:00"), F.substring("image_path", 4, 6)) != F.col("record_id")).count()
    assert (done.count(), done.select("record_id").distinct().count(), wrong) == (30_000, 30_000, 0)


# Resampling by products of blocks


def mixed(df, *parts):
    return [r["x"] for r in spread(df, "x", *parts).orderBy("id").select("x").collect()]


def test_draws_are_those_of_the_column_expressions(spark):
    weights, odd = resampling.draws(7)
    slots = spark.range(5 * 11)
    b, slot = F.floor(F.col("id") / 11) + 3, F.col("id") % 11
    hits = np.array(mixed(slots, F.lit(7), b, slot)).reshape(5, 11) % 11
    assert (weights(3, 5, 11) == [[Counter(row.tolist())[i] for i in range(11)] for row in hits]).all()
    hashes = np.array([1, 5, 2**32 - 1, 77])
    flips = mixed(spark.range(12), F.lit(7), F.floor(F.col("id") / 4) + 3, F.element_at(F.array(*[F.lit(int(h)) for h in hashes]), (F.col("id") % 4 + 1).cast("int")))
    assert (odd(3, 3, hashes) == np.array(flips).reshape(3, 4) % 2).all()


def cluster_rows(spark):
    rng = random.Random(4)
    rows = [(s, f"c{k}", rng.randrange(50), rng.randrange(5), rng.randrange(64) / 64) for s, n in (("x", 23), ("y", 7), (None, 1)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "s string, cluster string, hits long, n long, part double").repartition(3)


def test_replicates_by_brute_force(spark, monkeypatch):
    rows, df = cluster_rows(spark)
    for name, value in (("BLOCK", 13), ("CLUSTERS", 5), ("CELLS", 40)):
        monkeypatch.setattr(resampling, name, value)
    names = {f"c{k}": h for k, h in enumerate(r["h"] for r in spark.range(23).select(draw(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("h"), "id").orderBy("id").collect())}
    weights, odd = resampling.draws(resampling.SEED)
    got = {(r["s"], r["b"]): (r["hits"], r["n"], r["part"]) for r in resampling.weighted_totals(df, ["s"], "cluster", ["hits", "n", "part"], 30).collect()}
    signs = resampling.sign_flip(df.where("s is not null"), ["s"], "cluster", ["hits"], 30).collect()
    for s in ("x", "y", None):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (names[r[1]] >> 22, r[1]))
        w = weights(0, 30, len(own))
        for b in range(30):
            assert got[s, b] == tuple(sum(int(w[b, i]) * r[c] for i, r in enumerate(own)) for c in (2, 3, 4))
        if s:
            net = sum(r[2] for r in own)
            flips = 2 * odd(0, 30, np.array([names[r[1]] for r in own])) - 1
            large = sum(abs(sum(int(f) * r[2] for f, r in zip(row, own, strict=True))) >= net for row in flips)
            assert {r["s"]: r["p_value"] for r in signs}[s] == (large + 1) / 31


def test_whole_numbers_stay_exact_beyond_doubles(spark):
    df = spark.createDataFrame([("s", f"c{k}", 2**55 + k) for k in range(5)], "s string, cluster string, big long")
    got = resampling.weighted_totals(df, ["s"], "cluster", ["big"], 8).collect()
    weights, _ = resampling.draws(resampling.SEED)
    assert {r["b"]: r["big"] % 2**55 < 40 and r["big"] // 2**55 == 5 for r in got} == dict.fromkeys(range(8), True) and weights(0, 8, 5).sum() == 40


def test_optional_metrics(spark):
    zero = [0] * metrics.SIZE
    rows = [("A", "p", 0.5), ("A", "p", None), ("A", "q", float("nan")), ("A", "q", float("inf")), ("B", "p", 0.25), ("B", "q", 0.75), ("B", "q", -1.0)]
    df = spark.createDataFrame([(a, c, zero, zero, v) for a, c, v in rows], "arm string, cluster string, reference array<int>, prediction array<int>, score double")
    got = {r["arm"]: (r["n_records"], r["score"]) for r in metrics.grouped_metrics(df, ["arm"], ["score"]).collect()}
    assert got == {"A": (4, 0.5), "B": (3, 0.0)}
    sums, values = metrics.sums(["score"]), lambda of: {"score": metrics.metrics(of, ["score"])["score"]}
    stats = metrics.totals(df, ["arm", "cluster"], means=["score"])
    assert {(r["arm"], r["cluster"]): (r["sum_score"], r["finite_score"]) for r in stats.collect()} == {("A", "p"): (0.5, 1), ("A", "q"): (0.0, 0), ("B", "p"): (0.25, 1), ("B", "q"): (-0.25, 2)}
    ci = {r["arm"]: r for r in resampling.bootstrap(stats, ["arm"], "cluster", sums, values, 400).collect()}
    assert 200 < ci["A"]["n_valid"] < 380 and (ci["A"]["ci_low"], ci["A"]["ci_high"]) == (0.5, 0.5)  # q alone is drawn in a quarter
    assert ci["B"]["n_valid"] == 400 and ci["B"]["ci_low"] == -0.125 and ci["B"]["ci_high"] == 0.25
    a, b = (stats.where(F.col("arm") == x).select("cluster", F.lit("s").alias("s"), *[F.col(c).alias(f"{t}_{c}") for c in sums]) for t, x in (("a", "A"), ("b", "B")))
    r = resampling.paired_permutation(a.join(b, ["cluster", "s"]), ["s"], "cluster", sums, values, 300).first()
    assert r["difference"] == -0.5 and r["valid"] == 300 and 0 < r["p_value"] <= 1
    none = metrics.totals(df.withColumn("score", F.lit(None).cast("double")), ["arm", "cluster"], means=["score"])
    assert {(r["estimate"], r["n_valid"], r["ci_low"]) for r in resampling.bootstrap(none, ["arm"], "cluster", sums, values, 20).collect()} == {(None, 0, None)}


# Search in blocks


def nearest(queries, gallery, k, same=lambda q, g: True):
    dot = lambda a, b: reduce(lambda s, x: s + x, (float(x) * float(y) for x, y in zip(a, b, strict=True)), 0.0)  # noqa: E731  (sum() compensates)
    return {q: sorted((-dot(v, w), g) for g, w in gallery if same(q, g))[:k] for q, v in queries}


def test_block_search_by_brute_force():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    gallery = np.concatenate([centres[rng.integers(0, 12, 3000)] + 0.05 * rng.normal(size=(3000, 16)), np.repeat(centres, 4, axis=0)])
    queries = np.concatenate([centres[:5] + 0.01, rng.normal(size=(5, 16)), np.zeros((1, 16))])
    for k in (1, 7):
        search, best = retrieval.block_search(queries, k)
        taken = sum(search(list(range(a, min(a + 1000, len(gallery)))), gallery[a : a + 1000]) for a in range(0, len(gallery), 1000))
        got = {}
        for q, g, score in best():
            got.setdefault(q, []).append((-score, g))
        assert got == nearest(list(enumerate(queries)), list(enumerate(gallery)), k)
        assert taken < 0.8 * len(queries) * len(gallery)  # blocks are left out
    search, best = retrieval.block_search(queries, 3, ["a"] * 5 + ["b"] * 6)
    search(list(range(len(gallery))), gallery, ["a" if i % 2 else "c" for i in range(len(gallery))])
    got = best()
    assert {q for q, _, _ in got} == set(range(5)) and all(g % 2 for _, g, _ in got)


def test_ineligible_neighbours_are_looked_up_further(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SPARE", 2)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    rng = random.Random(5)
    vectors = [(k, [rng.randrange(-4, 5) / 4 for _ in range(3)]) for k in range(150)]
    gallery = spark.createDataFrame([(k, v, k % 10) for k, v in vectors] + [(900, None, 1), (901, [1.0], 1)], "gallery_id long, g array<double>, gallery_mark int").repartition(3)
    queries = spark.createDataFrame([(k, v, k % 10) for k, v in vectors[:12]] + [(99, None, 1)], "query_id long, q array<double>, query_mark int")
    for condition, same in ((F.col("query_mark") != F.col("gallery_mark"), lambda q, g: q % 10 != g % 10), (F.col("gallery_mark") == 3, lambda q, g: g % 10 == 3), (F.col("gallery_mark") == 30, lambda q, g: False)):
        want = nearest(vectors[:12], vectors, 4, same)
        got = {}
        for r in retrieval.top_k(queries, gallery, 4, condition).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["gallery_id"]))
        assert got == {q: found for q, found in want.items() if found}
    within = retrieval.top_k(queries, gallery, 4, None, within="mark")
    assert {(r["query_id"] % 10, r["gallery_id"] % 10) for r in within.collect()} == {(k, k) for k in range(10)}
    assert retrieval.top_k(queries.limit(0), gallery, 4).count() == 0 and retrieval.top_k(queries, gallery.limit(0), 4, F.lit(True)).count() == 0


# Exact quantiles of large groups


def test_quantiles_by_selection(spark, monkeypatch):
    rng = random.Random(6)
    special = [0.0, -0.0, 1e-300, -1e300, float("inf"), float("-inf"), 5e-324, 7.0]
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [float(rng.randrange(3)) for _ in range(2001)], "c": [rng.choice(special) for _ in range(700)], "d": [4.0] * 900, "e": [1.5], None: [rng.expovariate(1e-9) for _ in range(1234)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    levels = [0.0, 0.25, 0.5, 0.77, 1.0]
    whole = {r["g"]: r["q"] for r in quantiles.quantiles(df, "v", ["g"], levels).collect()}
    monkeypatch.setattr(quantiles, "WHOLE", 40)
    got = {r["g"]: r["q"] for r in quantiles.quantiles(df, "v", ["g"], levels).collect()}
    assert set(got) == set(whole) == set(groups) and all(got[g] == pytest.approx(whole[g], rel=1e-14) for g in groups)
    for g, values in groups.items():
        ordered = sorted(values)
        assert got[g][2] == pytest.approx(float(np.quantile(ordered, 0.5)), nan_ok=True) and got[g][0] == ordered[0] and got[g][4] == ordered[-1]
    assert quantiles.quantiles(df.limit(0), "v", ["g"], levels).collect() == []
    assert [r["q"] for r in quantiles.quantiles(df.where("g = 'd'"), "v", [], [0.5]).collect()] == [[4.0]]
    summary = {r["g"]: r for r in metrics.runtime_summary(df, "v", ["g"]).collect()}
    assert summary["f"]["n"] == 0 and summary["f"]["median"] is None and summary["b"]["median"] == whole["b"][2]


# CIDEr


def brute_cider(pairs, n=4, sigma=6.0):
    grams = lambda text: Counter(tuple(w[i : i + k]) for w in [text.split()] for k in range(1, n + 1) for i in range(len(w) - k + 1))
    known = [(grams(r or ""), grams(h or "")) for r, h in pairs]
    df = Counter(g for r, _ in known for g in r)
    idf = lambda g: math.log(len(pairs)) - math.log(max(df[g], 1))
    out = []
    for r, h in known:
        total = 0.0
        for k in range(1, n + 1):
            wr, wh = ({g: c * idf(g) for g, c in x.items() if len(g) == k} for x in (r, h))
            norms = [math.sqrt(sum(v * v for v in w.values())) for w in (wr, wh)]
            if all(norms):
                total += sum(min(v, wr.get(g, 0)) * wr.get(g, 0) for g, v in wh.items()) / (norms[0] * norms[1])
        delta = sum(c for g, c in h.items() if len(g) == 2) - sum(c for g, c in r.items() if len(g) == 2)
        out.append(10 * total / n * math.exp(-(delta**2) / (2 * sigma**2)))
    return out


@pytest.mark.parametrize("common", [1 << 19, 30, 0])
def test_cider_by_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(text_metrics, "COMMON", common)
    monkeypatch.setattr(text_metrics, "WORDS", 50)
    rng = random.Random(8)
    words = ["the"] * 6 + [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs = [(t, " ".join(w if rng.random() < 0.8 else rng.choice(words) for w in t.split())) for t in (text(rng.randrange(0, 30)) for _ in range(120))]
    pairs += [(None, "the"), ("the", None), (None, None), ("", " \t"), (text(400), text(300)), ("the the", "the the")]
    df = spark.createDataFrame([(k, r, h, "x") for k, (r, h) in enumerate(pairs)], "k long, r string, h string, id string").repartition(3)
    got = {r["k"]: r["cider"] for r in text_metrics.cider(df, "k", "r", "h").collect()}
    assert [got[k] for k in range(len(pairs))] == pytest.approx(brute_cider(pairs), abs=1e-9)
    assert text_metrics.cider(df.limit(0), "k", "r", "h").collect() == []


# Nested JSON


def test_content_nests_to_any_depth(spark):
    deep = "deep"
    for k in range(50):
        deep = {"content": [{"text": deep}]} if k % 2 else [deep, None, {"other": 1}]
    contents = ["plain ", ["a", {"text": "b"}, [["c"], {"content": {"text": " d "}}], None, 3, {"text": None, "content": "no"}], deep, {"x": 1}, None, [], "  "]
    assert [nested.leaf_text(c, records.CONTENT_KEYS) for c in contents] == ["plain", "a\nb\nc\nd\n3", "deep", "", "", "", ""]
    raw = json.dumps({"messages": [{"role": "Human", "content": c} for c in contents]})
    df = spark.createDataFrame([(raw,), ('{"messages": []}',), ("{}",), (None,), ("no json",)], "raw string")
    got = [r["m"] for r in df.select(records.messages(F.col("raw")).alias("m")).collect()]
    assert [(m["role"], m["content"]) for m in got[0]] == [("user", "plain"), ("user", "a\nb\nc\nd\n3"), ("user", "deep")] and got[1:] == [[], [], [], []]


def test_fields_are_dropped_from_the_parsed_value(spark):
    deep = {"seconds": 1, "kept": "x"}
    for k in range(50):
        deep = {"v": deep, "seconds": k} if k % 2 else [deep]
    raws = [json.dumps({"a": 'x "seconds": 1, y', "seconds": [1, {"b": 2}], "d": deep}), "[]", "3", "no json", None, '{"seconds": "{"}']
    got = [r["x"] for r in spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").select("k", nested.dropped(F.col("raw"), ("seconds",)).alias("x")).orderBy("k").collect()]
    cleaned = json.loads(got[0])
    assert cleaned["a"] == 'x "seconds": 1, y' and set(cleaned) == {"a", "d"} and got[0].count("seconds") == 1 and got[1:] == ["[]", "3", "no json", None, "{}"]
    rows = spark.createDataFrame([("a", [(1.0, "x")]), ("a", [(2.0, "x")])], "generation_record_id string, passes array<struct<seconds:double,text:string>>")
    assert {r["c"] for r in rows.select(audits._content(rows).alias("c")).collect()} == {'{"generation_record_id":"a","passes":[{"text":"x"}]}'}


# Commits and streams


def test_two_appends_are_one_commit(spark, tmp_path, monkeypatch):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    both = lambda a, b: {good: spark.range(a), bad: spark.range(b)}
    counts = lambda: tuple(spark.read.schema("id long").parquet(p).count() if commits.names(spark, p) else 0 for p in (good, bad))
    commits.append(good, both(3, 2))
    assert counts() == (3, 2)

    class Killed(Exception):
        pass

    def killed(*_):
        raise Killed

    # before the commit: nothing of it stays
    with monkeypatch.context() as m:
        m.setattr(commits.json, "dumps", killed)
        with pytest.raises(Killed):
            commits.append(good, both(10, 10))
    assert counts() == (3, 2)
    commits.recover(spark, good, [good, bad])
    assert counts() == (3, 2) and not [x for p in (good, bad) for x in commits.names(spark, p) if x.startswith(commits.NEW)]
    # behind it, between the two tables: the next writer finishes it
    publish, calls = commits._publish, []

    def once(*args):
        if calls:
            raise Killed
        calls.append(args)
        publish(*args)

    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", once)
        with pytest.raises(Killed):
            commits.append(good, both(5, 7))
    assert counts() == (8, 2)
    commits.recover(spark, good, [good, bad])
    assert counts() == (8, 9)
    commits.recover(spark, good, [good, bad])
    assert counts() == (8, 9)


def test_a_killed_run_leaves_no_half_state(spark, tmp_path, monkeypatch):
    target, failures = str(tmp_path / "done"), str(tmp_path / "failed")
    work = spark.range(10).select(F.col("id").cast("string").alias("k"))
    run = lambda: experiment.run_pending(work, "k", lambda df: df.select("k", F.lit("x").alias("report"), F.when(F.col("k") > "6", "broken").alias("error")), target, failures)
    publish, calls = commits._publish, []

    def once(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        publish(*args)

    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", once)
        with pytest.raises(RuntimeError):
            run()
    assert run() == 3
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == [str(k) for k in range(7)]
    assert Counter(r["k"] for r in spark.read.parquet(failures).collect()) == {"7": 2, "8": 2, "9": 2}
    assert not [x for x in os.listdir(tmp_path) if "staging" in x]


def test_streams_look_up_their_own_keys(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: incremental.append_once(spark, source, "id long, v int", lambda df: df.withColumn("x", F.col("id") * 2), "id", target, checkpoint)
    for first, last in ((0, 4), (2, 9), (0, 9)):
        spark.range(first, last).withColumn("v", F.lit(1)).write.mode("append").parquet(source)
        query = run()
        query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(9))
    # the last batch read its own rows alone
    assert query.recentProgress[-1]["numInputRows"] == 9 and all("in" in s["description"] for s in query.recentProgress[-1]["sources"])
    with pytest.raises(GateError, match="another stream"):
        incremental.append_once(spark, source, "id long, v int", lambda df: df, "id", target, str(tmp_path / "new"))
    assert spark.conf.get(incremental.STATE[0], "") != incremental.STATE[1]


# Cases and hot keys


def test_cases_are_those_of_whole_rankings(spark):
    rng = random.Random(10)
    tags = ["strict_rescue", "strict_harm", "dominant_rescue", "dominant_harm", "strict_harm;dominant_rescue"]
    rows = [(f"k{i}", rng.choice(tags), "m0" if rng.random() < 0.7 else f"m{rng.randrange(1, 4)}", f"l{rng.randrange(2)}") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t string, m string, l string").repartition(3)
    hashes = {r["k"]: r["h"] for r in df.select("k", draw(20260831, F.col("k")).alias("h")).collect()}
    for n, some in ((20, rows), (61, rows), (40, [r for r in rows if "rescue" not in r[1]][:30] + [r for r in rows if "rescue" in r[1]][:5])):
        work = [("rescue" if "rescue" in t else "harm", 0 if "strict_" in t else 1, m, x, hashes[k], k) for k, t, m, x in some]
        ranks = {}
        for key, group in itertools.groupby(sorted(work, key=lambda w: (w[0], w[2], w[3], w[4], w[5])), key=lambda w: (w[0], w[2], w[3])):
            for at, w in enumerate(group, 1):
                ranks[w[5]] = at
        ordered = {d: sorted((w for w in work if w[0] == d), key=lambda w: (w[1], ranks[w[5]], *w[2:])) for d in ("rescue", "harm")}
        rescue = min((n + 1) // 2, len(ordered["rescue"]))
        harm = min(n - rescue, len(ordered["harm"]))
        picked = ordered["rescue"][:rescue] + ordered["harm"][:harm]
        picked += sorted((w for w in work if w not in picked), key=lambda w: (w[1], w[4], w[5]))[: n - len(picked)]
        got = sampling.case_sample(df.where(F.col("k").isin([w[5] for w in work])), "k", "t", ["m", "l"], n).collect()
        assert {r["k"] for r in got} == {w[5] for w in picked}
        assert [r["case_number"] for r in sorted(got, key=lambda r: (r["direction"], r["strict"], hashes[r["k"]]))] == [f"QR-{i:04d}" for i in range(1, len(picked) + 1)]


def test_hot_keys_are_joined_where_their_rows_are(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 4)
    rows = spark.range(100).select(F.when(F.col("id") < 60, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), (F.col("id") % 2).alias("l"), "id")
    facts = rows.groupBy("k", "l").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    assert {(r["k"], r["l"]) for r in skew.hot_keys(facts, "n", 100)} == {(None, 0), (None, 1)}
    top = {(r["k"], r["l"]): r["top"] for r in facts.collect()}
    got = skew.one_for_each(rows, facts, ["k", "l"], "n").collect()
    assert len(got) == 100 and all(r["top"] == top[r["k"], r["l"]] for r in got)
    assert skew.one_for_each(rows.limit(0), facts.limit(0), ["k", "l"], "n").collect() == []


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = shared.written(spark.range(5))
    assert df.count() == 5 and shared.checkpoint_dir(spark) and "ExistingRDD" in df._jdf.queryExecution().toString() or "Scan" in df._jdf.queryExecution().toString()


def test_cider_writes_no_table_of_ngrams(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(text_metrics, "COMMON", 0)
    monkeypatch.setattr(text_metrics, "SENT", 3, raising=False)
    monkeypatch.setattr(text_metrics, "written", lambda df: tables.append(df.columns) or shared.written(df))
    pairs = [("a b c d e a b", "a b c x e"), ("a b c d", "a b c d"), ("", "a"), ("q r s a b", "q r a b s"), ("z", "")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, r string, h string")
    got = {r["k"]: r["cider"] for r in text_metrics.cider(df, "k", "r", "h").collect()}
    assert [got[k] for k in range(len(pairs))] == pytest.approx(brute_cider(pairs), abs=1e-9)
    assert tables == [["g", "n"]]


# Near hashes


def test_no_side_of_near_hashes_is_broadcast(spark, capsys):
    """Each hash becomes 70 rows, which Spark's size of a side doesn't know."""
    rows = spark.range(500).select("id", (F.col("id") * 7919).alias("hi"), F.lit(5).cast("long").alias("lo"))
    near = cohort.near_hashes(rows, rows)
    assert near.where("hi_a = hi_b").count() == 500
    near.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# Labels of a row


def test_what_labels_are_read_from_is_made_once(spark, capsys):
    made = lambda name: F.md5(F.concat(F.lit(name), F.col("id").cast("string")))
    states = F.create_map(F.lit("Edema"), F.when(made("s") > "8", 1).otherwise(-1), F.lit("FRACTURE"), F.lit(-1))
    text = F.concat_ws(" ", F.lit("no evidence of"), F.lit("edema"), made("t"))
    df = spark.range(40).select(labels.vector_of_states(states).alias("v"), labels.negation_flags(text, F.array(F.lit("fracture"), F.lit("edema"))).alias("f"))
    df.explain()
    assert capsys.readouterr().out.count("md5(") == 2
    assert {(tuple(r["v"]), tuple(r["f"])) for r in df.collect()} == {((0, 0, 0, 1) + (0,) * 9, ("edema",))}
    bad = spark.range(1).select(labels.vector_of_states(F.create_map(F.lit("edema"), F.lit(7))).alias("v"))
    with pytest.raises(Exception, match="state of edema: 7"):
        bad.collect()


def _counting(spark):
    """An identity that counts the rows it is computed for, and the count."""
    count = spark.sparkContext.accumulator(0)

    def seen(x):
        count.add(1)
        return x

    return F.udf(seen, "string").asNondeterministic(), count


def test_case_sample_computes_its_cases_once(spark):
    seen, count = _counting(spark)
    cases = spark.range(200).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "strict_rescue").when(F.col("id") % 3 == 1, "dominant_harm").otherwise("strict_harm").alias("t"), F.concat(F.lit("m"), F.col("id") % 2).alias("m"))
    got = sampling.case_sample(cases.withColumn("m", seen("m")), "k", "t", ["m"], 150).collect()
    assert len(got) == 150 and len({r["k"] for r in got}) == 150
    assert count.value == 200


def test_ensemble_tests_compute_their_totals_once(spark):
    seen, count = _counting(spark)
    rows = [(f"c{k % 5}", m, [int((k + i) % 4 == 0) for i in range(13)], [int((k * i + m) % 3 == 0) for i in range(13)]) for k in range(40) for m in range(3)]
    df = spark.createDataFrame(rows, "cluster string, model int, reference array<int>, prediction array<int>").withColumns({"s": F.lit("A"), "model": F.col("model").cast("string")})
    singles = metrics.totals(df.withColumn("model", seen("model")), ["s", "model", "cluster"])
    got = inference.ensemble_tests(singles, metrics.totals(df, ["s", "cluster"]), ["s"], "model", "cluster", metrics.metrics, 50).collect()
    assert len({(r["model"], r["metric"]) for r in got}) == len(got) == 3 * 24 and sum(r["is_best"] for r in got) == 24
    assert count.value == len(rows)


def test_revision_gets_batches_of_bounded_size(spark, monkeypatch):
    """64 rows of half a megabyte are not one batch."""
    df = spark.range(64).coalesce(1).select(F.col("id").cast("string").alias("record_id"), F.lit(revision.CONDITIONS[0]).alias("condition"), F.repeat(F.lit("a"), F.lit(500_000)).alias("evidence"))
    large, whole, limit = spark.sparkContext.accumulator(0), type(df).mapInPandas, 16 << 20

    def spied(self, function, schema):
        def run(batches):
            def each():
                for batch in batches:
                    large.add(int(batch["evidence"].str.len().sum() > limit))
                    yield batch

            yield from function(each())

        return whole(self, run, schema)

    monkeypatch.setattr(type(df), "mapInPandas", spied)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    models = revision.Models(lambda prompt: "report", lambda report, evidence, condition: True, lambda evidence: "first", lambda report, evidence, k: "next")
    assert revision.run_all(df, models).where("n_reports = 1").count() == 64
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert large.value == 0


def test_a_task_stems_a_word_once(spark):
    count = spark.sparkContext.accumulator(0)

    def stem(word):
        count.add(1)
        return word.rstrip("s")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    df = spark.range(100).coalesce(1).select(F.lit("two words here").alias("r"), F.lit("two word x there").alias("h"))
    got = {r[0] for r in df.select(text_metrics.rouge_l(F.col("r"), F.col("h"), stem)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {4 / 7} and count.value == 6

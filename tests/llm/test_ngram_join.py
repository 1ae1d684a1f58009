import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ngram_join, pairs
from cohortlens.llm.hashing import shingles
from cohortlens.operators import skew

from test_near_dedup import brute, corpus


def found(df, **parameters):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.classes(df, **parameters).collect()), key=str)


@pytest.mark.parametrize(("seed", "width", "percent", "subset"), [(1, 5, 80, 2), (3, 3, 60, 3)])
def test_classes_are_those_of_all_pairs(docs_of, seed, width, percent, subset):
    texts = corpus(seed)
    assert found(docs_of(texts), width=width, percent=percent, subset=subset) == brute(list(enumerate(texts)), width, percent)


@pytest.mark.parametrize("heavy", [12, 10**6])
def test_any_boundary_gives_the_same_classes(docs_of, monkeypatch, heavy):
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: heavy)
    texts = [t for t in corpus(4) if heavy < 100 or len(t.split()) < 60]
    assert found(docs_of(texts), width=2) == brute(list(enumerate(texts)), 2, 80)


def test_common_shingles_hubs_and_blocks(docs_of, monkeypatch):
    """Lists in many parts, no hub that decides, and blocks of a few members give the same classes."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(40)]
    texts = [" ".join(base[:k] + [rng.choice(words)] + base[k + 1 :]) for k in range(40) for _ in range(2)]
    texts += [" ".join(base[:30] + [rng.choice(words) for _ in range(8)]) for _ in range(40)]
    for module, name, value in ((ngram_join, "UNIT", 500), (ngram_join, "REPEATS", 2), (ngram_join, "SLICE", 3), (pairs, "SLICE", 3), (skew, "SHARE", 5)):
        monkeypatch.setattr(module, name, value)
    assert found(docs_of(texts)) == brute(list(enumerate(texts)), 5, 80)


def test_near_copies_without_a_centre_make_few_pairs(docs_of, monkeypatch):
    """Copies of one text with two other words each: few link with any hub, but hubs join them all before pairs are made."""
    rng, made, one_by_one = random.Random(5), [], ngram_join.one_by_one
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]

    def copy(edits):
        text = list(base)
        for k in edits:
            text[k] = rng.choice(words)
        return " ".join(text)

    texts = [copy(range(75, 87))] + [copy(rng.sample(range(150), 2)) for _ in range(500)]

    def counted(members, percent):
        made.append(one_by_one(members, percent))
        return made[-1]

    monkeypatch.setattr(ngram_join, "OPEN", 0.1, raising=False)
    monkeypatch.setattr(ngram_join, "drop", lambda df: None)
    monkeypatch.setattr(ngram_join, "one_by_one", counted)
    assert found(docs_of(texts)) == brute(list(enumerate(texts)), 5, 80)
    assert sum(df.count() for df in made) < 10 * len(texts)


def test_near_copies_whose_centre_has_no_low_id_take_one_hub(docs_of, monkeypatch):
    """Copies of one text with one to three other words each, the text itself last: one hub joins them, few pairs are left."""
    rng, rounds, made, by_hub, one_by_one = random.Random(8), [], [], ngram_join._by_hub, ngram_join.one_by_one
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    edits = [rng.sample(range(150), 1 + k % 3) for k in range(400)]
    texts = [" ".join(rng.choice(words) if k in some else w for k, w in enumerate(base)) for some in edits] + [" ".join(base)]
    monkeypatch.setattr(ngram_join, "drop", lambda df: None)
    monkeypatch.setattr(ngram_join, "_by_hub", lambda *a: rounds.append(by_hub(*a)) or rounds[-1])
    monkeypatch.setattr(ngram_join, "one_by_one", lambda *a: made.append(one_by_one(*a)) or made[-1])
    assert found(docs_of(texts)) == brute(list(enumerate(texts)), 5, 80)
    assert len(rounds) == 1 and sum(df.count() for df in made) < len(texts)


def test_two_sets_in_different_parts_of_a_list_link(docs_of, monkeypatch):
    """A list that was seen often but has two members, one alone in its first part."""
    texts = [" ".join([f"p{k // 2}w{i}" for i in range(20)] + [f"x{k}"]) for k in range(32)]
    items = np.unique(np.concatenate(shingles(texts, 5)))
    monkeypatch.setattr(ngram_join, "common_order", lambda *_: ngram_join.Order(items, np.ones(len(items), dtype=np.int64)))
    monkeypatch.setattr(ngram_join, "SLICE", 1)
    assert [c for _, _, c in sorted(found(docs_of(texts)))] == [k // 2 * 2 for k in range(32)]


def test_nulls_repeats_and_empty_tables(spark):
    long = " ".join(f"x{i % 900}" for i in range(30_000))
    texts = ["a b c d e f", "A b\tc d e f", None, "", " \n", "a", "a", "a b c d e f", long, long + " y"]
    rows = [(10 - k, t) for k, t in enumerate(texts)] + [(None, "a b c d e f"), (None, None), (5, "a"), (3, "one more set of words here"), (3, ""), (20, "one more set of words here")]
    df = spark.createDataFrame([(*r, "n", 1, [2]) for r in rows], "doc_id int, text string, node string, n int, items array<int>").repartition(3)
    got = found(df)
    want = {10: 3, 9: 3, 3: 3, 20: 3, 8: 8, 7: 7, 6: 6, 5: 4, 4: 4, 2: 1, 1: 1}
    assert {k: c for k, _, c in got if k is not None} == want and len(got) == len(rows)
    assert [c for k, _, c in got if k is None] == [None, None]
    assert found(df.limit(0)) == []
    assert found(df.where("text is null")) == [(8, 0, 8), (None, 0, None)]


def test_linked_sets_share_a_key():
    """The subsets of c among the first n - t + c: equal for two sets that reach the threshold, whatever the order."""
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randrange(2, 40)
        a = rng.sample(range(100), n)
        b = [x for x in a if rng.random() > 0.1] + rng.sample(range(100, 140), rng.randrange(0, 4))
        both = len(set(a) & set(b))
        for c in (1, 2, 3):
            if 5 * both >= 4 * len(set(a) | set(b)) and ngram_join.least_overlap(max(len(a), len(b)), 80) >= c:
                first = [set(sorted(s)[: min(len(s), len(s) - ngram_join.least_overlap(len(s), 80) + c)]) for s in (a, b)]
                assert len(first[0] & first[1]) >= c


def test_order_and_boundary(spark, docs_of):
    order = ngram_join.Order(np.array([9, 3], dtype=np.uint64), np.array([5, 7]))
    assert order.seen(np.array([3, 4, 9, 10], dtype=np.uint64)).tolist() == [7, 0, 5, 0]
    texts = ["a b c d e f g"] * 9 + [f"a b c d e f {k}" for k in range(9)]
    common = ngram_join.common_order(docs_of(texts).select("text"), 5)
    passage = shingles(["a b c d e"], 5)[0]
    assert common.seen(passage)[0] >= 4 and common.seen(shingles(["p q r s t"], 5)[0])[0] == 0
    # few distinct lists: subsets pay only where lists are long
    rows = [(f"d{k}", k, n, [0]) for k, n in enumerate([10] * 400)]
    nodes = spark.createDataFrame(rows, "digest string, node int, n long, probe array<long>")
    light, heavy = 400 * math.comb(4, 2), 400 * 3 + ngram_join.PROBE * 399 * 400
    assert ngram_join.boundary(nodes, 80, 2) == 11 and light < heavy
    assert ngram_join.boundary(nodes.withColumn("probe", F.array(F.col("node").cast("long"))), 80, 2) == 0
    assert ngram_join.boundary(nodes.limit(0), 80, 2) == 0

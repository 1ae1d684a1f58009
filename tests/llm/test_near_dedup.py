import random

import numpy as np
import pytest

from cohortlens.llm import near_dedup
from cohortlens.llm.hashing import shingles


def brute(rows, width, percent):
    """(id, n, component) of each row, by comparing all pairs."""

    def shingle_set(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])

    made = [shingle_set(t) for _, t in rows]
    root = {k: k for k, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            if a is not None and b is not None and made[i] and made[j] and a < b and 100 * len(made[i] & made[j]) >= percent * len(made[i] | made[j]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((k, len(m), None if k is None else find(k)) for (k, _), m in zip(rows, made, strict=True)), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.choice((1, 2, 3, 6, 30, 80)))] for _ in range(12)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2:
            text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        elif kind < 0.4:
            text = passage + [rng.choice(words) for _ in range(rng.randrange(0, 25))]
        else:
            text = [w if rng.random() > rng.choice((0, 0.02, 0.06)) else rng.choice(words) for w in rng.choice(bases)]
        out.append(" ".join(text).replace("w1", rng.choice(("w1", "W1"))))
    return out


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5), (3, 2)])
def test_classes_are_those_of_all_pairs(docs_of, seed, width):
    texts = corpus(seed)
    got = near_dedup.near_duplicates(docs_of(texts), width=width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(list(enumerate(texts)), width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_undecided_members_are_joined_exactly(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    texts = corpus(7)
    got = near_dedup.near_duplicates(docs_of(texts), width=2, bands=20, rows=1).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(list(enumerate(texts)), 2, 80)


def test_pairs_of_a_large_hub_are_dealt_to_several_tasks(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "SLICE", 5)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(base) if rng.random() < 0.02 else w for w in base) for _ in range(60)] + corpus(12, 40)
    got = near_dedup.near_duplicates(docs_of(texts), width=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(list(enumerate(texts)), 2, 80)


def test_null_empty_repeated_and_long_rows(docs_of):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (None, "a b c"), (8, "a b c"), (9, "A B  c"), (9, "A B  c"), (9, "other words here"), (4, "other words here"), (1, long), (2, long + " end"), (3, "a")]
    got = near_dedup.near_duplicates(docs_of([t for _, t in rows], [k for k, _ in rows]), width=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 2, 80)
    kept = near_dedup.drop_duplicates(docs_of([t for _, t in rows], [k for k, _ in rows]), width=2)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7]
    assert kept.columns == ["doc_id", "text", "id", "score", "found", "digest"]


def test_empty_table(docs_of):
    assert near_dedup.near_duplicates(docs_of(["x"]).limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = random.Random(5)
    a, b = ({f"s{i}" for i in range(lo, lo + 400)} for lo in (0, 100))
    sets = [np.unique(np.concatenate([shingles([w], 1)[0] for w in s])) for s in (a, b, {"one"}, {str(rng.random()) for _ in range(3)})]
    made = near_dedup.sketch(sets, 420)
    assert not (made == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    assert abs((made[0] == made[1]).mean() - 300 / 500) < 0.08
    assert (near_dedup.sketch([sets[2]], 420)[0] == made[2]).all()


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (20, 30), (30, 20), (5, 5)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(edges).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 30: 20} | {101 + i: 100 for i in range(40)}

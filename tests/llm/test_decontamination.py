import random
import time

import numpy as np
import pytest

from cohortlens.llm import decontamination as D
from cohortlens.llm.hashing import words


def brute_align(item, text):
    best = 0
    rows = [[0] * (len(text) + 1)]
    for x in item:
        row = [0]
        for j, y in enumerate(text):
            row.append(max(0, rows[-1][j] + (D.MATCH if x == y else D.MISMATCH), rows[-1][j + 1] + D.GAP, row[j] + D.GAP))
            best = max(best, row[-1])
        rows.append(row)
    return best


def test_alignment_is_smith_watermans():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, n))], dtype=np.uint64) for n in (9, 25))
        assert D.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def test_words():
    found, owner = D.word_hashes(["It's A-b, É!", "", "it s a B é"])
    assert owner.tolist() == [0, 0, 0, 0, 0, 2, 2, 2, 2, 2] and (found[:5] == found[5:]).all()
    assert len(words(["a b"])[0]) == 2


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 20
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(12, 50))] for _ in range(25)]
    texts, truth = [], set()
    for k in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if k % 3 == 0:
            item = rng.randrange(len(items))
            copy = [w for w in (rng.choice(vocabulary) if rng.random() < (0, 0.1, 0.15)[k % 9 // 3] else w for w in items[item]) if rng.random() > 0.03 or k % 2]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," if k % 5 == 0 else w for w in copy]
            truth.add((k, item))
        texts.append(" ".join(text))
    return [" ".join(x) for x in items], texts, truth


@pytest.mark.parametrize("limit", [D.BLOCK_WORDS, 100])
def test_planted_copies_are_found(spark, docs_of, planted, limit):
    items, texts, truth = planted
    benchmark = spark.createDataFrame([*[(k, t, "x") for k, t in enumerate(items)], (90, None, "x"), (91, "", "x"), (92, "the of", "x")], "item_id long, text string, score string")
    rows = [*texts, None, "", "The, of and"]
    short = {(k, 92) for k, t in enumerate(rows) if " the of " in " " + (t or "").lower().replace(",", "") + " "}
    got = D.contaminated(docs_of(rows), benchmark, block_words=limit).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth | short and {r["score"] for r in got if r["item_id"] == 92} == {1.0}
    benchmark = benchmark.where("item_id <> 92")
    for r in got:
        if r["item_id"] == 92:
            continue
        run = D.word_hashes([texts[r["doc_id"]]])[0][r["first_word"] : r["after_word"]]
        item = D.word_hashes([items[r["item_id"]]])[0]
        assert abs(brute_align(item.tolist(), run.tolist()) / (2 * len(item)) - r["score"]) < 1e-12
    kept = D.remove(docs_of([*texts, None]), benchmark, block_words=limit)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts) + 1)) - {d for d, _ in truth}
    assert kept.columns == docs_of(["x"]).columns


def test_a_passage_that_most_documents_hold(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(30))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of([f"{item} end{k}" if k % 4 else f"clean text {k} of its own" for k in range(100)], [None if k == 1 else k for k in range(100)])
    got = D.contaminated(docs, benchmark).collect()
    assert len(got) == 75 and sum(r["doc_id"] is None for r in got) == 1
    assert D.contaminated(docs_of([f"{item} " * 3000]), benchmark).first()["score"] == 1.0


EDITS = {
    "replaced": lambda k, w: ["other%d" % k] if k % 4 == 3 else [w],
    "deleted": lambda k, w: [] if k % 4 == 3 else [w],
    "inserted": lambda k, w: [w, "more%d" % k] if k % 3 == 2 else [w],
}


@pytest.mark.parametrize("beside", [False, True])
@pytest.mark.parametrize("edit", sorted(EDITS))
def test_a_copy_with_an_edit_in_most_seeds(spark, docs_of, edit, beside):
    item = [f"q{i}" for i in range(38)]
    copy = [x for k, w in enumerate(item) for x in EDITS[edit](k, w)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = docs_of(["clean text of its own", "so " + " ".join(copy) + " end", *([" ".join(item)] if beside else [])])
    wanted = {1: brute_align(item, copy) / 76} | ({2: 1.0} if beside else {})
    got = {r["doc_id"]: r["score"] for r in D.contaminated(docs, benchmark).collect()}
    assert got == pytest.approx(wanted) and min(wanted.values()) > 0.5
    assert [r["doc_id"] for r in D.remove(docs, benchmark).collect()] == [0]


def test_short_items_and_text_ids(spark, docs_of):
    benchmark = spark.createDataFrame([("p", "a b"), ("q", "zulu"), (None, "c d e")], "item_id string, text string")
    docs = docs_of(["x A, b c d", "b a", "zulu zulus", "c d x e", "a c d e"])
    got = {(r["doc_id"], r["item_id"], r["score"], r["first_word"], r["after_word"]) for r in D.contaminated(docs, benchmark).collect()}
    assert got == {(0, "p", 1.0, 1, 3), (2, "q", 1.0, 0, 1), (4, None, 1.0, 1, 4)}
    assert sorted(r["doc_id"] for r in D.remove(docs, benchmark).collect()) == [1, 3]


def test_a_block_is_mapped_as_built(tmp_path):
    block = D.Block.of_items(["a b c d", "", "x", "a b c"])
    (tmp_path / "x").write_bytes(block.payload())
    back = D.Block.map(str(tmp_path / "x"))
    assert [back.item(k).tolist() for k in range(4)] == [D.word_hashes([t])[0].tolist() for t in ("a b c d", "", "x", "a b c")]
    assert (back.seeds == block.seeds).all() and (back.of == block.of).all() and (back.at == block.at).all() and back.short.tolist() == [1]
    empty = D.Block.of_items([])
    assert len(empty.found(*D.word_hashes(["a b c"]))[0]) == 0


def test_empty_tables(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.contaminated(docs_of(["x"]).limit(0), benchmark).count() == 0
    assert D.contaminated(docs_of(["x"]), benchmark.limit(0)).count() == 0
    assert D.remove(docs_of(["x"]), benchmark.limit(0)).count() == 1


def test_a_seed_of_many_items():
    """Items that begin alike are looked up at once: the result is that of each by itself, at a fraction of its time."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(5000)]
    opening = "which of the following statements about".split()
    items = [" ".join(opening + [rng.choice(vocabulary) for _ in range(rng.choice((20, 32, 40)))]) for _ in range(20_000)]
    own = [" ".join(rng.choice(vocabulary) for _ in range(38)) for _ in range(20_000)]
    copy = [w for k, w in enumerate(items[77].split()) if k % 5]
    texts = [" ".join([*opening, *(rng.choice(vocabulary) for _ in range(60))]) for _ in range(30)] + [" ".join(["so", *copy, "end"]), items[5], " ".join(opening)]
    seconds = []
    for some in (own, items):
        block = D.Block.of_items(some)
        assert len(block.vocabulary[0]) <= 5006 and block.filter.any()
        start = time.process_time()
        found = list(D._matches(block, texts, D.THRESHOLD))
        seconds.append(time.process_time() - start)
    assert seconds[1] < 2 * seconds[0] + 2  # 20 s a text when each pair was looked at by itself
    assert {(d, k) for d, k, *_ in found} >= {(30, 77), (31, 5)}
    few = sorted({k for _, k, *_ in found} | set(range(0, 20_000, 400)))
    hashes = [D.word_hashes([t])[0].tolist() for t in texts]
    whole = {(d, k) for k in few for d, h in enumerate(hashes) for w in [D.word_hashes([items[k]])[0].tolist()] if brute_align(w, h) >= D.THRESHOLD * 2 * len(w)}
    assert whole == {(d, k) for d, k, *_ in found}


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.25])
def test_recall_of_edited_copies(rate):
    rng = random.Random(int(100 * rate))
    vocabulary = [f"w{k}" for k in range(3000)] + ["the", "of", "a"] * 300
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))] for _ in range(200)]
    block, hit = D.Block.of_items([" ".join(x) for x in items]), 0
    for k, item in enumerate(items):
        copy = []
        for word in item:
            edit = rng.choice(("replace", "delete", "insert")) if rng.random() < rate else ""
            copy += {"": [word], "replace": [rng.choice(vocabulary)], "delete": [], "insert": [word, rng.choice(vocabulary)]}[edit]
        text = [rng.choice(vocabulary) for _ in range(30)]
        text[15:15] = copy
        hit += any(i == k for _, i, *_ in D._matches(block, [" ".join(text)], D.THRESHOLD))
    assert hit >= 0.9 * len(items)

import random

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.operators import ngrams, text_metrics
from tests.test_scale import brute_cider


def test_keys_that_differ_in_low_bits_only():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 4, 5000, dtype=np.uint64) | (rng.integers(0, 300, 5000, dtype=np.uint64) << np.uint64(52))
    order, dense = ngrams.numbered(keys)
    assert (order == np.argsort(keys, kind="stable")).all() and (dense == np.unique(keys, return_inverse=True)[1][order]).all()
    assert [len(x) for x in ngrams.numbered(keys[:0])] == [0, 0] and ngrams.numbered(keys[:1])[0].tolist() == [0]


@pytest.mark.parametrize("values", [[], [0, 0], [1, 255, 256, 0], [2**40, 3], [-1, 2**63 - 1, 0]])
def test_packed_numbers(values):
    assert ngrams.unpacked(ngrams.packed(np.array(values, dtype=np.int64))).tolist() == values


def test_words_between_white_space():
    texts = ["", " a\tb \x0bc\n", "é\x1c ü", "\r\n", "d"]
    words, sizes = ngrams.split_words(pa.array(["left out", *texts]).slice(1))
    assert words.to_pylist() == ["a", "b", "c", "é\x1c", "ü", "d"] and sizes.tolist() == [0, 3, 2, 0, 1]


@pytest.mark.parametrize("n", [1, 3, 6])
def test_sizes_in_rounds(spark, monkeypatch, n):
    monkeypatch.setattr(text_metrics, "WORDS", 40)
    rng = random.Random(n)
    text = lambda k: " ".join(rng.choice("abcd") for _ in range(k))
    pairs = [(t, t[2:] if k % 3 else t) for k, t in enumerate(text(rng.randrange(0, 20)) for _ in range(60))]
    df = spark.createDataFrame([(f"d{k}", *p) for k, p in enumerate(pairs)], "k string, r string, h string").repartition(2)
    got = {r["k"]: r["cider"] for r in text_metrics.cider(df, "k", "r", "h", n).collect()}
    # a length is a number of bigrams, so there is none without them
    wanted = brute_cider(pairs, n) if n > 1 else brute_cider(pairs, n, 1e9)
    assert [got[f"d{k}"] for k in range(len(pairs))] == pytest.approx(wanted, abs=1e-9)


def test_no_row_for_an_ngram_is_shuffled(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(text_metrics, "written", lambda df: rows.append(df.count()) or ngrams.written(df))
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(100)]
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "k long, r string, h string").coalesce(1)
    assert all(abs(r["cider"] - 10) < 1e-9 for r in text_metrics.cider(df, "k", "r", "h").collect())
    assert rows[0] < 100  # 100 texts of more than 100,000 n-grams


def test_shuffle_files_go_round_by_round(spark, monkeypatch):
    modes = []
    for module in (ngrams, text_metrics):
        monkeypatch.setattr(module, "written", lambda df, f=module.written: modes.append(str(df._jdf.queryExecution().shuffleCleanupMode())) or f(df))
    df = spark.createDataFrame([(k, "a b c d e", "a b x d e") for k in range(20)], "k long, r string, h string")
    assert text_metrics.cider(df, "k", "r", "h", 6).count() == 20
    assert modes[0] != modes[1] and len(set(modes[1:])) == 1 and len(modes) == 4  # the blocks, made without a shuffle, then each round

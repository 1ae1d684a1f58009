import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from cohortlens.llm import common, periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute(words, length=6, exponent=4):
    """(start, length, period) of every run, by comparing all words a period apart."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def sequence(rng, n, letters):
    s = []
    while len(s) < n:
        kind = rng.random()
        if kind < 0.3 or not s:
            s += [rng.randrange(letters) for _ in range(rng.randrange(1, 8))]
        elif kind < 0.7:
            p = [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
            s += [p[i % len(p)] for i in range(rng.randrange(3, 40))]
        else:
            a = rng.randrange(len(s))
            s += s[a : a + rng.randrange(1, 120)]
    return s[:n]


@pytest.mark.parametrize("exponent", [3, 4, 5])
def test_all_runs_by_brute_force(exponent):
    rng = random.Random(exponent)
    for _ in range(250):
        s = sequence(rng, rng.randrange(1, 220), rng.choice((1, 2, 3, 10)))
        got = [(a, b - a, q) for a, b, q in periodic_runs.all_runs(np.array([*s, -1]), 6, exponent)]
        assert sorted(got) == sorted(brute(s, 6, exponent)) and got == sorted(got, key=lambda r: (r[0], r[2]))


def test_longest_previous_factors_and_blocks():
    rng = random.Random(7)
    for _ in range(60):
        s = [*sequence(rng, rng.randrange(1, 80), 3), -1]
        order, levels = periodic_runs.suffix_array(np.array(s))
        assert [s[i:] for i in order] == sorted(s[i:] for i in range(len(s)))
        lpf, source = periodic_runs.previous_factors(order, levels)
        for i in range(len(s)):
            longest = max((next(k for k in range(len(s) + 1) if i + k >= len(s) or s[j + k] != s[i + k]) for j in range(i)), default=0)
            assert lpf[i] == (longest if longest > 1 else 0)
            assert not lpf[i] or (source[i] < i and s[source[i] : source[i] + lpf[i]] == s[i : i + lpf[i]])
        starts, i = [], 0
        while i < len(s):
            starts.append(i)
            i += lpf[i] or 1
        assert periodic_runs.blocks(lpf).tolist() == starts


def test_runs_of_documents(docs_of):
    rng = random.Random(3)
    texts = [" ".join(f"w{x}" for x in sequence(rng, rng.randrange(0, 150), rng.choice((2, 5)))) for _ in range(60)]
    texts += [None, "", " \t\n ", "a", " a a", " x  y\tx y x\ny x y x y ", texts[0], "b " * 20_000, "ü ü ü ü ü ü"]
    got = {r["doc_id"]: r for r in periodic_runs.runs(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert sorted(tuple(r) for r in got[k]["runs"]) == want and got[k]["n_words"] == len(words)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert got[k]["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_empty_table_null_ids_and_parameters(spark):
    df = spark.createDataFrame([(None, "a a a a a a"), (None, None), (1, "a a a a a a"), (1, "b")], "doc_id int, text string")
    assert sorted((r["doc_id"] or 0, len(r["runs"])) for r in periodic_runs.runs(df).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    empty = periodic_runs.runs(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert [len(r["runs"]) for r in periodic_runs.runs(df, length=7).collect()] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        periodic_runs.runs(df, exponent=2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_against_its_contract(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    documents = common.table(spark, SF, "documents", "doc_id", "text").collect()
    assert len(got) == len(documents)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for k, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(k).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        want, r = sorted(brute(words), key=lambda x: (x[0], x[2])), got[k]
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert r["n_runs"] == len(want) and r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in want))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        best = None
        for s, m, q in want:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)

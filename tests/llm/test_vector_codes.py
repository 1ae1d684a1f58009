import hashlib
import math
import os
import random

import numpy as np
import pytest

from cohortlens.llm import common, queries, vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, error string, code int, id string"


def brute(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error)}, label sums and the digest, by comparing every part with every entry."""
    kept = {k: [math.floor(256 * x) for x in v] for k, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = max(len(v) for v in kept.values()) // parts
    kept = {k: v for k, v in kept.items() if len(v) == width * parts}
    piece = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, kept[k]))[:entries]
    books = [[list(piece(kept[k], p)) for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [[] for _ in book]
            for v in kept.values():
                mine[nearest(piece(v, p), book)[1]].append(piece(v, p))
            books[p] = [[sum(x) // len(some) for x in zip(*some, strict=True)] if some else c for c, some in zip(book, mine, strict=True)]
    out = {}
    for k, v in kept.items():
        found = [nearest(piece(v, p), books[p]) for p in range(parts)]
        out[k] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    sums = {}
    for k, (_, error) in out.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + error
    return out, sums, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def test_partial_distances_give_the_nearest_entry():
    rng = np.random.default_rng(5)
    for width, spread in ((1, 3), (4, 4), (4, 300), (7, 2)):
        vectors, entries = rng.integers(-spread, spread + 1, (500, width)), rng.integers(-spread, spread + 1, (64, width))
        whole = ((vectors[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        index, error, taken = vector_codes.nearest(vectors, entries)
        assert (index == whole.argmin(axis=1)).all() and (error == whole.min(axis=1)).all()
        if (width, spread) == (4, 300):
            assert taken < 0.6 * whole.size * width  # most entries are dropped before their last dimension
    one = vector_codes.nearest(np.zeros((3, 2), dtype=np.int64), np.array([[1, 0], [0, 1], [1, 0]]))
    assert one[0].tolist() == [0, 0, 0] and one[1].tolist() == [1, 1, 1]


@pytest.mark.parametrize(("count", "width"), [(150, 2), (40, 1)])
def test_codes_by_brute_force(spark, count, width):
    rng = random.Random(count)
    value = lambda: rng.choice((0.0, rng.uniform(-1, 1), rng.uniform(-1, 1), -0.004))
    rows = [(rng.randrange(count), [value() for _ in range(16 * width)], rng.choice((None, 1, 2, 2, 2))) for _ in range(count)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (7, None, 1), (8, [], 1), (9, [None] * 16 * width, 1), (10, [float("nan")] * 16 * width, 2), (11, [float("inf")] + [0.0] * (16 * width - 1), 1), (12, [1.0] * 16, 3) if width > 1 else (12, [0.5] * 8, 3)]
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for k, v, x in rows]
    df = spark.createDataFrame([(*r, "e", 3, "i") for r in rows], SCHEMA).repartition(4)
    books = vector_codes.fit(df, "vec_id", "embedding")
    got = vector_codes.encode(df, books, "vec_id", "embedding", "label").collect()
    codes, sums, digest = brute(rows)
    text = lambda xs: sorted(map(str, xs))
    assert text((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got) == text((rows[k][0], rows[k][2], *codes[k], sums[rows[k][2]]) for k in codes)
    assert books.digest() == digest


def test_no_vectors_and_parameters(spark):
    df = spark.createDataFrame([(1, None, 1, "", 1, ""), (2, [None], None, "", 1, "")], SCHEMA)
    for some in (df, df.limit(0)):
        assert vector_codes.fit(some, "vec_id", "embedding") is None
        assert vector_codes.encode(some, None, "vec_id", "embedding", "label").collect() == []
    blank = spark.createDataFrame([(1, [], 1, "", 1, "")], SCHEMA)
    assert [(r["code"], r["error"]) for r in vector_codes.encode(blank, vector_codes.fit(blank, "vec_id", "embedding"), "vec_id", "embedding", "label").collect()] == [("00" * 16, 0)]
    odd = spark.createDataFrame([(1, [1.0] * 17, 1, "", 1, "")], SCHEMA)
    with pytest.raises(ValueError):
        vector_codes.fit(odd, "vec_id", "embedding")
    with pytest.raises(ValueError):
        vector_codes.fit(odd, "vec_id", "embedding", entries=257)
    large = spark.createDataFrame([(1, [1e30] * 16, 1, "", 1, ""), (2, [1.0] * 16, 1, "", 1, "")], SCHEMA)
    assert [r["vec_id"] for r in vector_codes.encode(large, vector_codes.fit(large, "vec_id", "embedding"), "vec_id", "embedding", "label").collect()] == [2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_against_its_contract(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "embeddings", "vec_id", "embedding", "label").collect()]
    codes, sums, digest = brute(rows)
    got = queries.op12_vector_codes(spark, SF).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted((rows[k][0], *codes[k], sums[rows[k][2]]) for k in codes)
    assert {r["codebooks_sha256"] for r in got} == {digest}
